"""Command lines of the loader and the exporter.

    python -m gristdex.commands load --output-type=TYPE [options] TABLE INPUT...
    python -m gristdex.commands dump [options] TABLE

``load`` reads delimited text, columnar files or tables and publishes a table;
several input tables are merged.  ``dump`` prints a table as text, rows fetched
as they are printed.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristdex.functions.text import escape_tsv
from gristdex.model import PERCENTILES, Index
from gristdex.sources import export, load, merge, tables
from gristdex.sources.catalog import load_catalog

TYPES = {"index": "keyword", "time-series": "key", "summaries": "key", "summary": "key"}


def load_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristdex load")
    p.add_argument("--output-type", "--output-format", dest="kind", choices=TYPES, default="time-series")
    p.add_argument("--input-format", choices=("auto", "csv", "table", "columnfile"), default="auto")
    p.add_argument("--schema", help="catalog whose summary tables resolve document names")
    p.add_argument("--date-format", default=load.DATE_FORMAT)
    p.add_argument("--delimiter", default="\t")
    p.add_argument("--no-unescape", action="store_true")
    p.add_argument("--input-unsorted", action="store_true", help="accepted; tables are always sorted on writing")
    p.add_argument("--base", type=lambda s: int(s, 0), default=0, help="first document number of a summary table")
    p.add_argument("--threshold", type=int)
    p.add_argument("--key-filter")
    p.add_argument("--strip-key-prefix")
    p.add_argument("--add-key-prefix")
    p.add_argument("--shard-count", type=int, default=1)
    p.add_argument("--shard-index", type=int, default=0)
    p.add_argument("--merge-mode", choices=merge.MODES, default="union")
    p.add_argument("--output-compression", choices=("default", "none", "zstd"), default="default")
    p.add_argument("--output-compression-level", type=int)
    p.add_argument("table")
    p.add_argument("inputs", nargs="+")
    return p


def _postings_of(rows: DataFrame, args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """(keyword, name, score ...) to postings, names resolved by the catalog's summary tables."""
    if not args.schema:
        raise ValueError("an index needs --schema")
    index = tables.open_index(spark, load_catalog(spark, args.schema))
    return load.to_postings(load.resolve_documents(rows, index.summaries)).drop("table_seq")


def _read(spark: SparkSession, path: str, args: argparse.Namespace) -> DataFrame:
    kind, text = args.kind, args.input_format in ("auto", "csv")
    if not text and args.input_format == "table":
        return spark.read.parquet(path)
    if kind.startswith("summar"):
        if text:
            return load.read_delimited(spark, path, ("key", "json"), args.delimiter, not args.no_unescape)
        df = spark.read.parquet(path)
        return df.select(F.col(df.columns[0]).alias("key"), F.col(df.columns[1]).alias("json"))
    if text:
        names = ("keyword", "name", "value") if kind == "index" else ("keyword", "at", "value")
        rows = load.parse_scores(load.read_delimited(spark, path, names, args.delimiter, not args.no_unescape))
    else:
        df = spark.read.parquet(path)
        rows = load.columnar(df, df.columns[0], df.columns[1], df.columns[2] if len(df.columns) > 2 else None)
        rows = rows if kind == "index" else rows.withColumnRenamed("name", "at")
    if kind == "index":
        return _postings_of(rows, args, spark)
    return load.parse_dates(rows, "at", args.date_format).select(F.col("keyword").alias("key"), "ts", "score", *PERCENTILES)


def run_load(spark: SparkSession, argv: list[str]) -> None:
    """Loads, merges, filters, renames and publishes one table."""
    args = load_parser().parse_args(argv)
    key = TYPES[args.kind]
    inputs = [_read(spark, path, args) for path in args.inputs]
    united = reduce(DataFrame.unionByName, inputs)
    if args.kind.startswith("summar"):
        out = merge.merge_summaries([d.select("key", "json") for d in inputs], args.merge_mode) if len(inputs) > 1 and args.input_format == "table" else united.select("key", "json")
    elif len(inputs) > 1 and args.input_format == "table":
        out = merge.merge_index(inputs) if args.kind == "index" else merge.merge_series(inputs, args.merge_mode)
    else:
        out = united
    if args.key_filter:
        out = load.key_filter(out, args.key_filter, key)
    if args.shard_count > 1:
        out = load.shard(out, args.shard_count, args.shard_index, key)
    if args.strip_key_prefix:
        out = load.strip_prefix(out, args.strip_key_prefix, key)
    if args.add_key_prefix:
        out = load.add_prefix(out, args.add_key_prefix, key)
    if args.threshold is not None and "score" in out.columns:
        out = load.threshold(out, args.threshold)
    if args.kind.startswith("summar"):
        out = load.number_documents(out, args.base).select("key", "doc", "json")
    tables.write_table(out, args.table, key, args.output_compression, args.output_compression_level)


def dump_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristdex dump")
    p.add_argument("--format", choices=("index", "summaries", "time-series"), default="time-series")
    p.add_argument("--raw", action="store_true", help="document numbers instead of names")
    p.add_argument("--schema", help="catalog whose summary tables name documents")
    p.add_argument("--date-format", default=load.DATE_FORMAT)
    p.add_argument("--ts-format", choices=("normal", "count"), default="normal")
    p.add_argument("--key-filter")
    p.add_argument("--prefix", help="start at this key")
    p.add_argument("--only-prefix", help="only keys that start so")
    p.add_argument("--keys-only", action="store_true")
    p.add_argument("--count", action="store_true")
    p.add_argument("table")
    return p


def dump_lines(spark: SparkSession, argv: list[str]) -> Iterator[str]:
    """The lines of an export, in key order."""
    args = dump_parser().parse_args(argv)
    key = TYPES[args.format]
    df = export.scoped(spark.read.parquet(args.table), key, args.key_filter, args.prefix, args.only_prefix)
    if args.keys_only:
        yield from (r["key"] for r in export.keys(df, key).orderBy("key").toLocalIterator())
    elif args.count or (args.format == "time-series" and args.ts_format == "count"):
        if args.format != "time-series":
            yield str(df.count())
        else:
            yield from (f"{r['key']}\t{r['n']}" for r in export.series_counts(df).orderBy("key").toLocalIterator())
    elif args.format == "summaries":
        yield from (f"{escape_tsv(r['key'])}\t{escape_tsv(r['json'] or '')}" for r in df.orderBy("key").toLocalIterator())
    elif args.format == "time-series":
        yield from export.series_lines(export.time_series(df.orderBy("key", "ts"), args.date_format).toLocalIterator())
    else:
        summaries = tables.open_index(spark, load_catalog(spark, args.schema)).summaries if args.schema else None
        index = Index(df.withColumn("table_seq", F.lit(0)), summaries)
        if args.raw or summaries is None:
            yield from export.posting_lines(export.raw_postings(index).orderBy("keyword", "doc", "score").toLocalIterator())
        else:
            yield from export.resolved_lines(export.resolved_postings(index).orderBy("keyword", "key", "score").toLocalIterator())


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in ("load", "dump"):
        print(__doc__)
        return 64
    spark = SparkSession.builder.appName("gristdex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if argv[0] == "load":
            run_load(spark, argv[1:])
        else:
            for line in dump_lines(spark, argv[1:]):
                print(line)
    except Exception as e:  # noqa: BLE001 - reported as one line
        print(export.error_line(e))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
