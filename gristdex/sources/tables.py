"""Writing and reading index tables as Parquet, sorted by key and published at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristdex.functions.keywords import KeywordRules
from gristdex.model import Index
from gristdex.session import placed
from gristdex.sources.catalog import Catalog

# Codec names of the option and of Parquet.
CODECS = {"none": "uncompressed", "default": "zstd", "zstd": "zstd", "snappy": "snappy"}


class DuplicateKeyError(ValueError):
    """A table that must have unique keys has a key twice."""


def unique_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """The table, failing when it is read if a key comes twice."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.min(key).alias("twice"))
    guard = by.select(F.when(F.col("twice").isNotNull(), F.raise_error(F.concat(F.lit("duplicate key "), F.col("twice").cast("string"))).cast("boolean")).otherwise(F.lit(True)).alias("ok")).scalar()
    return df.where(guard)


def require_unique(df: DataFrame, key: str = "key") -> None:
    """Raises :class:`DuplicateKeyError` if a key comes twice."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise DuplicateKeyError(f"duplicate key {twice[0][key]!r}")


def write_table(df: DataFrame, path: str, key: str = "key", compression: str = "default", level: int | None = None, mode: str = "errorifexists") -> None:
    """Writes a table sorted by ``key`` across and within files.

    The range partitioning makes file statistics disjoint, so look-ups by key or
    prefix read few row groups.  The job commit publishes all files or none.
    """
    rest = [c for c in df.columns if c != key and dict(df.dtypes)[c] in ("bigint", "int", "timestamp")]
    writer = df.repartitionByRange(key).sortWithinPartitions(key, *rest).write.mode(mode).option("compression", CODECS[compression])
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    writer.parquet(path)


def read_rows(df: DataFrame, key: str, count: int | None = None, skip: int = 0, start: str | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order of the key (and the columns ``then``) from the first key >= ``start``, after ``skip`` rows, at most ``count``.

    Without ``count`` rows are skipped by their places in a range sort, so the
    rest never meets in one task.
    """
    out = df if start is None else df.where(F.col(key) >= start)
    if skip and count is None:
        return placed(out, key, *then).where(F.col("place") >= skip).orderBy("place").drop("place")
    out = out.orderBy(key, *then)
    if skip:
        out = out.offset(skip)
    return out if count is None else out.limit(count)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """List objects (key, data) from the files of a folder; a file's key is its name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.decode("content", "UTF-8").alias("data"))


def open_index(spark: SparkSession, catalog: Catalog, rules: KeywordRules | None = None, objects: DataFrame | None = None) -> Index:
    """An index over the Parquet tables a catalog names; nothing is read yet but their schemas.

    Tables of ``table_seq`` and ``base`` get those from the catalog.
    """

    def united(kind: str) -> DataFrame | None:
        parts = []
        for e in catalog.of(kind):
            df = spark.read.parquet(e.path).drop("table_seq", "base").withColumn("table_seq", F.lit(e.seq))
            parts.append(df.withColumn("base", F.lit(e.base).cast("bigint")) if kind == "summary" else df)
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    postings = united("index")
    if postings is None:
        postings = spark.createDataFrame([], "table_seq INT, keyword STRING, doc BIGINT, seq INT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT")
    tables = tuple(e.seq for e in catalog.of("summary-override"))
    return Index(postings, united("summary"), united("summary-override"), objects, rules or KeywordRules(), override_tables=tables)
