"""Loading: text and columnar rows to summaries, postings and time series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristdex.functions.text import spark_pattern, unescape_tsv_column
from gristdex.model import PERCENTILES
from gristdex.session import placed

DATE_FORMAT = "%Y-%m-%d %H:%M:%S"


def read_delimited(spark: SparkSession, path: str, columns: tuple[str, ...], delimiter: str = "\t", unescape: bool = True, line_end: str | None = None) -> DataFrame:
    """Lines of a text file split at a one-character delimiter; the last column takes the rest of the line.

    ``\\t \\r \\n \\\\`` are unescaped in each field unless told otherwise.  Missing
    fields are null, blank lines are skipped.  Lines end at any line break, or at
    ``line_end`` only.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    parts = F.split("value", re.escape(delimiter), len(columns))
    lines = spark.read.text(path, lineSep=line_end).where(F.length("value") > 0).select(parts.alias("p"))
    fields = [F.get("p", F.lit(i)) for i in range(len(columns))]
    return lines.select(*((unescape_tsv_column(f) if unescape else f).alias(c) for c, f in zip(columns, fields)))


def parse_scores(df: DataFrame, text: str = "value") -> DataFrame:
    """Splits ``score [pct5 pct25 pct75 pct95]`` in ``text``: all four percentiles or none; other counts and junk raise."""
    parts = F.split(F.trim(F.col(text)), " +")
    n = F.size(parts)
    bad = F.raise_error(F.concat(F.lit("bad score field: "), F.col(text))).cast("float")
    at = lambda i: parts.getItem(i).cast("float")
    score = F.when((n == 1) | (n == 5), at(0)).otherwise(bad).alias("score")
    return df.select(*(c for c in df.columns if c != text), score, *(F.when(n == 5, F.get(parts, F.lit(i + 1)).cast("float")).alias(c) for i, c in enumerate(PERCENTILES)))


def columnar(df: DataFrame, key: str, other: str, score: str | None) -> DataFrame:
    """Rows of a columnar source as (keyword, name, score, percentiles); a missing score is 0."""
    value = F.coalesce(F.col(score).cast("float"), F.lit(0.0).cast("float")) if score else F.lit(0.0).cast("float")
    return df.select(F.col(key).alias("keyword"), F.col(other).alias("name"), value.alias("score"), *(F.lit(None).cast("float").alias(c) for c in PERCENTILES))


def number_documents(summaries: DataFrame, base: int = 0, table_seq: int = 0) -> DataFrame:
    """Gives the rows of a summary table (key, json) dense document numbers from ``base`` in key order.

    Places come from a range sort, so no task sees the whole table.  Repeated
    keys are an error, rows without a key are left out.
    """
    rows = summaries.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("json").alias("json"))
    rows = rows.select("key", F.when(F.col("n") == 1, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("duplicate key "), "key"))).alias("json"))
    doc = (F.lit(base) + F.col("place")).cast("bigint")
    return placed(rows, "key").select(F.lit(table_seq).alias("table_seq"), F.lit(base).cast("bigint").alias("base"), doc.alias("doc"), "key", "json")


def resolve_documents(rows: DataFrame, summaries: DataFrame, name: str = "name") -> DataFrame:
    """Replaces document names by numbers: of several summary tables the last has its way; unknown names drop out."""
    last = summaries.where("key IS NOT NULL AND doc IS NOT NULL").groupBy("key").agg(F.max(F.struct("table_seq", "doc")).alias("s")).select(F.col("key").alias(name), F.col("s.doc").alias("doc"))
    return rows.join(last, name).drop(name)


def parse_dates(df: DataFrame, text: str, date_format: str = DATE_FORMAT) -> DataFrame:
    """Turns a strftime-formatted UTC text column into ``ts``; ``%s`` reads seconds.  Junk raises."""
    if date_format == "%s":
        ts = F.timestamp_seconds(F.col(text).cast("bigint"))
    else:
        ts = F.to_timestamp(F.col(text), spark_pattern(date_format))
    ok = F.when(ts.isNotNull(), ts).otherwise(F.raise_error(F.concat(F.lit("bad date "), F.coalesce(F.col(text), F.lit("null")))).cast("timestamp"))
    return df.withColumn("ts", ok).drop(text)


def to_postings(rows: DataFrame, table_seq: int = 0) -> DataFrame:
    """Numbers the postings of each (keyword, doc) and gives them the table's number."""
    order = Window.partitionBy("keyword", "doc").orderBy("score", *PERCENTILES)
    return rows.select(F.lit(table_seq).alias("table_seq"), "keyword", "doc", F.row_number().over(order).alias("seq"), "score", *PERCENTILES)


# Options of the loader, each a narrow step.


def threshold(df: DataFrame, least: float) -> DataFrame:
    """Drops postings below ``least``; NaN is not below anything and stays."""
    return df.where(~F.coalesce(~F.isnan("score") & (F.col("score") < F.lit(float(least))), F.lit(False)))


def literal_prefix(pattern: str) -> str:
    """What every full match of a regex starts with, so far as it is plain text."""
    if "|" in pattern:
        return ""
    head = re.match(r"[A-Za-z0-9_:@/ -]*", pattern)[0]
    return head[:-1] if len(head) < len(pattern) and pattern[len(head)] in "*?{" else head


def key_filter(df: DataFrame, pattern: str, key: str = "keyword") -> DataFrame:
    """Keeps keys that match a regex as a whole; its plain beginning is pushed to the scan."""
    out, head = df.where(F.col(key).rlike(rf"\A(?:{pattern})\z")), literal_prefix(pattern)
    return out.where(F.col(key).startswith(head)) if head else out


def strip_prefix(df: DataFrame, prefix: str, key: str = "keyword") -> DataFrame:
    """Removes a prefix that every key must have."""
    rest = F.substring(F.col(key), F.lit(len(prefix) + 1), F.length(key))
    bad = F.raise_error(F.concat(F.lit(f"key without prefix {prefix!r}: "), F.coalesce(F.col(key), F.lit("null"))))
    return df.withColumn(key, F.when(F.col(key).startswith(prefix), rest).otherwise(bad))


def add_prefix(df: DataFrame, prefix: str, key: str = "keyword") -> DataFrame:
    """Puts a prefix before every key."""
    return df.withColumn(key, F.concat(F.lit(prefix), key))


def shard(df: DataFrame, count: int, index: int, key: str = "keyword") -> DataFrame:
    """Keeps the keys of one of ``count`` shards; shards are disjoint and complete."""
    if not 0 <= index < count:
        raise ValueError("shard index out of range")
    return df.where(_shard_of(F.col(key), count) == index)


def _shard_of(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count))


# Whole loads.


def load_index(spark: SparkSession, path: str, summaries: DataFrame, delimiter: str = "\t", unescape: bool = True, table_seq: int = 0) -> DataFrame:
    """Postings from ``keyword, document name, score [percentiles]`` lines."""
    raw = read_delimited(spark, path, ("keyword", "name", "value"), delimiter, unescape)
    return to_postings(resolve_documents(parse_scores(raw), summaries), table_seq)


def load_time_series(spark: SparkSession, path: str, date_format: str = DATE_FORMAT, delimiter: str = "\t", unescape: bool = True, line_end: str | None = None) -> DataFrame:
    """Time series from ``key, date, score [percentiles]`` lines."""
    raw = read_delimited(spark, path, ("key", "at", "value"), delimiter, unescape, line_end)
    return parse_dates(parse_scores(raw), "at", date_format).select("key", "ts", "score", *PERCENTILES)


def load_summaries(spark: SparkSession, path: str, base: int = 0, delimiter: str = "\t", unescape: bool = True, table_seq: int = 0) -> DataFrame:
    """A summary table from ``name, json`` lines, numbered in key order."""
    return number_documents(read_delimited(spark, path, ("key", "json"), delimiter, unescape), base, table_seq)
