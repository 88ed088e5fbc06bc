"""Overlap sizes between many large sets (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristdex.llm.codes import code, dictionary, name_pairs


def overlap_sizes(df: DataFrame, set_name: str, identifier: str) -> DataFrame:
    """How many identifiers each pair of sets shares: exact counts.

    Columns: ``keyword_a`` < ``keyword_b`` (bytewise), ``size_a``, ``size_b``
    (distinct identifiers), ``shared``.  Pairs sharing nothing have no row.  Null
    sets and null identifiers are left out, repeated rows count once, an empty
    set name is a name, an empty table gives no row, other columns aren't read.

    Plan: (1) rows are deduplicated as (identifier, code), partially before the
    shuffle; the shuffle is on both, so a hot set or identifier is spread.
    (2) Self-join on the identifier with a < b; sorted runs that are skewed by an
    identifier in very many sets are split by the adaptive skew join.  (3) Counts
    by pair, combined map-side in the join's own tasks: no intersection is stored
    or shuffled, one partial count a pair and task is.
    """
    members = df.select(F.col(identifier).alias("rec"), F.col(set_name).cast("string").alias("name")).where("rec IS NOT NULL AND name IS NOT NULL").distinct()
    coded = members.select("rec", code("name").alias("c"))
    pairs = coded.select("rec", F.col("c").alias("a")).join(coded.select("rec", F.col("c").alias("b")), "rec").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return name_pairs(pairs, dictionary(members))


def contained_pairs(overlaps: DataFrame, share: float = 0.5) -> DataFrame:
    """The pairs of :func:`overlap_sizes` sharing at least ``share`` of the smaller set."""
    return overlaps.where(F.col("shared") / F.least("size_a", "size_b") >= share)
