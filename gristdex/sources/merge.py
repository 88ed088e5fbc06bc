"""Merging tables of the same kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristdex.model import PERCENTILES, scored

MODES = ("union", "pick-one", "sum")


def stacked(tables: list[DataFrame]) -> DataFrame:
    """All rows with ``source``, the number of their table."""
    out = tables[0].withColumn("source", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("source", F.lit(i)))
    return out


def _has_percentiles() -> Column:
    return F.coalesce(~F.isnan("pct5") & (F.abs("pct5") < F.lit(float("inf"))), F.lit(False))


def _fail_if(test: Column, message: str, key: Column, value: Column) -> Column:
    kind = "float"
    return F.when(test, F.raise_error(F.concat(F.lit(message + " "), key)).cast(kind)).otherwise(value)


def merge_series(tables: list[DataFrame], mode: str, by: tuple[str, str] = ("key", "ts")) -> DataFrame:
    """Merges time series (or posting lists with ``by=("keyword", "doc")``): one row a key and instant.

    ``union``: repeated instants must have equal scores, else reading fails.
    ``pick-one``: the first table has its way, but a row without percentiles beats
    one with them.  ``sum``: scores are added; an instant merged from several rows
    must have no percentiles in any of them, else reading fails.  Null keys drop
    out; a null score is NaN, as everywhere in an index.
    """
    rows = stacked([t.select(*by, scored(F.col("score")), *PERCENTILES) for t in tables]).where(F.col(by[0]).isNotNull())
    has = _has_percentiles()
    name = F.coalesce(F.col(by[0]), F.lit(""))
    if mode == "pick-one":
        order = Window.partitionBy(*by).orderBy(has.cast("int"), "source", "score", *PERCENTILES)
        return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "source")
    first = F.min(F.struct("source", "score", *PERCENTILES)).alias("first")
    if mode == "union":
        number = F.when(~F.isnan("score"), F.col("score"))
        grouped = rows.groupBy(*by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.max(F.isnan("score")).alias("nan"), F.count(F.lit(1)).alias("n"), first)
        differs = (F.col("lo") != F.col("hi")) | (F.col("nan") & (F.col("n") > 1))
        score = _fail_if(F.coalesce(differs, F.lit(False)), "different scores for", name, F.col("first.score"))
        return grouped.select(*by, score.alias("score"), *(F.col(f"first.{c}").alias(c) for c in PERCENTILES))
    if mode == "sum":
        grouped = rows.groupBy(*by).agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"), F.max(has).alias("has"), first)
        score = _fail_if((F.col("n") > 1) & F.col("has"), "percentiles can't be added for", name, F.col("total").cast("float"))
        return grouped.select(*by, score.alias("score"), *(F.col(f"first.{c}").alias(c) for c in PERCENTILES))
    raise ValueError(f"unknown merge mode {mode!r}")


def merge_summaries(tables: list[DataFrame], mode: str) -> DataFrame:
    """Merges (key, json): ``pick-one`` takes the first table's, ``union`` joins the objects' bodies in table order."""
    rows = stacked([t.select("key", "json") for t in tables]).where("key IS NOT NULL")
    if mode == "pick-one":
        return rows.groupBy("key").agg(F.min(F.struct("source", "json")).alias("s")).select("key", F.col("s.json").alias("json"))
    if mode == "union":
        trimmed = F.trim(F.col("json"))
        body = F.when(trimmed.startswith("{"), F.expr("substr(trim(json), 2, length(trim(json)) - 2)")).otherwise(trimmed)
        bodies = F.array_sort(F.collect_list(F.struct("source", body.alias("body"))))
        texts = F.filter(F.transform(bodies, lambda x: x["body"]), lambda x: x.isNotNull() & (x != ""))
        return rows.groupBy("key").agg(F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")).alias("json"))
    raise ValueError("summaries can't be added" if mode == "sum" else f"unknown merge mode {mode!r}")


def merge_index(tables: list[DataFrame]) -> DataFrame:
    """Puts posting tables together; a keyword in more than one of them fails on reading, rows without one drop out.

    Keywords are counted map-side, so postings aren't shuffled.
    """
    rows = stacked([t.select("keyword", "doc", "seq", "score", *PERCENTILES) for t in tables]).where("keyword IS NOT NULL")
    owners = rows.groupBy("keyword").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).where("lo < hi").agg(F.min("keyword").alias("twice"))
    guard = owners.select(F.when(F.col("twice").isNotNull(), F.raise_error(F.concat(F.lit("duplicate key "), "twice")).cast("boolean")).otherwise(F.lit(True)).alias("ok")).scalar()
    return rows.where(guard).drop("source")
