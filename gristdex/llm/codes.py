"""64-bit codes for keywords, so that shuffles carry numbers rather than strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code(column: str | Column) -> Column:
    """The code of a keyword.  Two keywords of one code are caught by :func:`dictionary`, never merged in silence."""
    return F.xxhash64(column)


def dictionary(members: DataFrame) -> DataFrame:
    """(code, name, size) of each set, from distinct (name, rec).  Reading it raises if two names share a code."""
    by = members.groupBy(code("name").alias("code")).agg(F.min("name").alias("name"), F.max("name").alias("last"), F.count(F.lit(1)).alias("size"))
    checked = F.when(F.col("name") == F.col("last"), F.col("name")).otherwise(F.raise_error(F.lit("two keywords share a code")).cast("string"))
    return by.select("code", checked.alias("name"), "size")


def name_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Replaces the codes ``a``, ``b`` of pairs by names in bytewise order.

    Adds ``keyword_a`` < ``keyword_b`` with ``size_a`` and ``size_b``; other columns stay.
    """
    left = names.select(F.col("code").alias("a"), F.col("name").alias("name_a"), F.col("size").alias("of_a"))
    right = names.select(F.col("code").alias("b"), F.col("name").alias("name_b"), F.col("size").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    up = F.col("name_a") < F.col("name_b")

    def pick(x: str, y: str, name: str) -> Column:
        return F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)

    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return both.select(pick("name_a", "name_b", "keyword_a"), pick("name_b", "name_a", "keyword_b"), pick("of_a", "of_b", "size_a"), pick("of_b", "of_a", "size_b"), *rest)
