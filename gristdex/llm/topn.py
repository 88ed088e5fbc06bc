"""Top N items within every group (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """The ``n`` items of highest score in every group, ties to the smaller item.

    An item's score is the highest of its scores in the group; null and NaN don't
    count, infinities do, -0.0 ties with 0.0.  Items without a score and rows
    with null group or item are left out; an empty group name is a group; groups
    with fewer items are whole; an empty table gives no row.

    Columns: ``group_key``, ``item``, ``score``, ``rank`` (1 to ``n``).

    Plan: best score per (group, item), combined map-side and shuffled on both,
    so no group sits in one task; then a row_number window with a rank filter,
    from which the optimiser derives group limits before and after the shuffle:
    at most ``n`` rows a group and task move.
    """
    value = F.col(score) + F.lit(0).cast(dict(df.dtypes)[score])
    rows = df.select(F.col(group).alias("group_key"), F.col(item).alias("item"), value.alias("score")).where("group_key IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy("group_key", "item").agg(F.max("score").alias("score"))
    order = Window.partitionBy("group_key").orderBy(F.desc("score"), F.asc("item"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
