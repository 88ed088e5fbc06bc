"""Per-key work when a handful of keys holds most rows (problem 5).

Heavy keys are found by a frequent-items sketch, a list whose length is bounded
by the share a key must hold.  Their rows are marked by a broadcast join against
that list and spread over salted groups; all other keys take the ordinary
shuffle; the two results are united.  The sketch only steers the route: a key
wrongly called heavy or light still gets its exact result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristdex.session import shuffle_partitions
from gristdex.sources.tables import unique_keys


def weighed(df: DataFrame, key: str, share: float, *more: Column) -> Column:
    """One pass over ``df`` as a scalar struct: ``n`` (rows), ``top`` (candidates for keys with at least ``share`` of them), ``more`` aggregates.

    The sketch tracks ``32 / share`` items (as a power of two), so its error is
    about ``share / 9``; every key at or above ``share`` is listed, with possibly
    a few lighter ones: at most ``2 / share`` keys and the null key, whatever the
    input size.  However often the struct is used, it is computed once a query.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    k = math.ceil(2 / share) + 1
    tracked = max(1 << math.ceil(math.log2(32 / share)), 2 * k)
    found = df.select("*", F.col(key).cast("string").alias("_text")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_text, {k}, {tracked})").alias("top"), *more)
    names = F.transform("top", lambda t: t["item"])
    return found.select(F.struct("n", names.alias("top"), *(c for c in found.columns if c not in ("n", "top"))).alias("seen")).scalar()


def _listed(df: DataFrame, seen: Column) -> DataFrame:
    """The keys of :func:`weighed` as one STRING column ``heavy_key``; the null key isn't listed."""
    return df.sparkSession.range(1, numPartitions=1).select(seen.alias("seen")).select(F.explode("seen.top").alias("heavy_key")).where("heavy_key IS NOT NULL")


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Candidates for keys holding at least ``share`` of the rows, see :func:`weighed`: one STRING column ``heavy_key``.  An empty table gives no row."""
    return _listed(df, weighed(df.select(key), key, share))


def split_by_weight(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heavy rows, light rows, heavy keys).  Rows with a null key are light.

    The broadcast side has at most ``2 / share`` rows, see :func:`weighed`.
    """
    heavy = heavy_keys(df, key, share)
    on = df[key].cast("string") == heavy["heavy_key"]
    return df.join(F.broadcast(heavy), on, "left_semi"), df.join(F.broadcast(heavy), on, "left_anti"), heavy


def marked(df: DataFrame, key: str, seen: Column) -> DataFrame:
    """``df`` with ``heavy``: true for rows of the keys listed in ``seen``, else null.  The broadcast side has at most ``2 / share`` rows."""
    few = _listed(df, seen).distinct().withColumn("heavy", F.lit(True))
    return df.join(F.broadcast(few), F.col(key).cast("string") == few["heavy_key"], "left").drop("heavy_key")


def per_key(df: DataFrame, key: str, record: str | None = None, value: str | None = None, share: float = 0.01) -> DataFrame:
    """Counts per key without imbalance.

    Columns: ``key`` STRING, ``n_rows`` BIGINT; with ``record`` also
    ``n_records`` (distinct non-null records); with ``value`` also ``value_min``,
    ``value_max`` and ``value_sum`` over non-null, non-NaN values (null if none);
    ``row_share`` of all rows, those with a null key counted.

    Every row counts, repeated rows too.  Rows with a null key are left out, an
    empty key is a key.  An empty table gives no row.  Other columns, whatever
    their names, are not read.

    Plan: two passes over the columns named, one for the sketch and the number
    of rows, one for all counts.  Groups of a heavy key are as many as a shuffle
    has tasks.
    """
    cols = [F.col(key).cast("string").alias("k")]
    if record:
        cols.append(F.col(record).alias("r"))
    if value:
        v = F.col(value).cast("double")
        cols.append(F.when(~F.isnan(v), v).alias("v"))
    slim = df.select(*cols)
    seen = weighed(slim.select("k"), "k", share)
    # Without records one partial row a task and key is all that moves.
    spread = F.xxhash64("r") if record else F.spark_partition_id()
    rows = marked(slim.where(F.col("k").isNotNull()), "k", seen)
    rows = rows.withColumn("salt", F.when(F.col("heavy"), F.pmod(spread, F.lit(shuffle_partitions(df.sparkSession)))))
    # Filters on the aggregate ``salted``, not on the salt, so that both parts read one shuffle.
    rolled = _roll_up(rows, ["k", "salt"], record, value)
    folded = [F.sum("n_rows").alias("n_rows")] + ([F.sum("n_records").alias("n_records")] if record else [])
    if value:
        folded += [F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.sum("value_sum").alias("value_sum")]
    heavy = rolled.where("salted").groupBy("k").agg(*folded)
    light = rolled.where("NOT salted").drop("salt", "salted")
    out = heavy.unionByName(light).withColumnRenamed("k", "key").withColumn("seen", seen)
    return out.withColumn("row_share", F.col("n_rows") / F.col("seen.n")).drop("seen")


def _roll_up(df: DataFrame, by: list[str], record: str | None, value: str | None) -> DataFrame:
    """Counts by ``by``; distinct records through a first level by (by, record), which no key can unbalance."""
    first: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    salted = F.max(F.col("salt").isNotNull()).alias("salted")
    if value:
        first += [F.min("v").alias("value_min"), F.max("v").alias("value_max"), F.sum("v").alias("value_sum")]
    if not record:
        return df.groupBy(*by).agg(*first, salted)
    level = df.groupBy(*by, "r").agg(*first)
    second = [F.sum("n_rows").alias("n_rows"), F.count("r").alias("n_records")]
    if value:
        second += [F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.sum("value_sum").alias("value_sum")]
    return level.groupBy(*by).agg(*second, salted)


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, how: str = "inner") -> DataFrame:
    """``left JOIN right USING (key)`` where few keys hold most of ``left``.

    Rows of heavy keys meet a broadcast of the right rows of those keys; the rest
    is an ordinary shuffled join; the results are united.  ``right`` must have
    one row a heavy key, else reading fails, so at most ``2 / share`` rows are
    broadcast; other keys may repeat.  ``how``: ``inner`` or ``left``.  Null keys
    match nothing (``left`` keeps them).
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    heavy, light, keys = split_by_weight(left, key, share)
    few = unique_keys(right.join(F.broadcast(keys), right[key].cast("string") == keys["heavy_key"], "left_semi"), key)
    return heavy.join(F.broadcast(few), key, how).unionByName(light.join(right, key, how))
