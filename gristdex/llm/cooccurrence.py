"""Items that appear together: basket collapsing (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristdex.llm.codes import code, dictionary, name_pairs


def co_occurrences(df: DataFrame, item: str, record: str, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """Records holding both items of each pair, and how much more often than chance.

    Columns: ``keyword_a`` < ``keyword_b``, ``size_a``, ``size_b`` (records of
    each), ``n`` (records with any item), ``together``, ``lift`` = c n / (a b),
    ``conviction`` of a -> b = (1 - b / n) / (1 - c / a), null where a never
    occurs without b.  Only pairs with ``together`` >= max(min_count, min_share n)
    come out; as no pair outnumbers its items, items below that are left out of
    the baskets, which loses no pair and bounds a basket by the number of items
    that frequent (at most mean basket size / min_share).  Null items or records
    are left out, repeated rows count once, an empty table gives no row.

    Plan: rows are read once.  Distinct (record, item), spread over both, from
    which items, baskets and the number of records come; frequent items by an
    equi-join (the engine broadcasts the item side only if its measured size
    allows); one array a record; equal arrays collapse into one weighted basket;
    each distinct basket unrolls its pairs once, each item with those behind it,
    and weights are summed map-side first.
    """
    members = df.select(F.col(record).alias("rec"), F.col(item).cast("string").alias("name")).where("rec IS NOT NULL AND name IS NOT NULL").distinct()
    names = dictionary(members)
    # With the items counted too, the number of records is read off the shuffle of the members.
    held = members.groupBy("rec").agg(F.count("name").alias("items"))
    whole = held.agg(F.count(F.lit(1)).alias("n"), F.sum("items").alias("items")).select(F.struct("n", "items").alias("whole")).scalar()

    def with_n(df: DataFrame, size: str) -> DataFrame:
        return df.withColumn("whole", whole).where(F.col(size) <= F.col("whole.items")).withColumn("n", F.col("whole.n")).drop("whole")

    def enough(count: str) -> Column:
        return (F.col(count) >= min_count) & (F.col(count) / F.col("n") >= min_share)

    coded = members.select("rec", code("name").alias("c"))
    if min_count > 1 or min_share > 0:
        frequent = with_n(names, "size").where(enough("size")).select(F.col("code").alias("c"))
        coded = coded.join(frequent, "c")
    baskets = coded.groupBy("rec").agg(F.array_sort(F.collect_list("c")).alias("basket")).where(F.size("basket") > 1)
    weighted = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("weight"))
    tails = F.transform(F.sequence(F.lit(1), F.size("basket") - 1), lambda i: F.slice("basket", i, F.size("basket")))
    heads = weighted.select(F.explode(tails).alias("tail"), "weight")
    pairs = heads.select(F.get("tail", F.lit(0)).alias("a"), F.explode(F.slice("tail", F.lit(2), F.size("tail"))).alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("together"))
    scored = with_n(name_pairs(pairs, names), "together").where(enough("together"))
    a, b, c, whole = (F.col(x).cast("double") for x in ("size_a", "size_b", "together", "n"))
    return scored.select("keyword_a", "keyword_b", "size_a", "size_b", "n", "together", (c * whole / (a * b)).alias("lift"), F.when(c < a, (1 - b / whole) / (1 - c / a)).alias("conviction"))


def associated(pairs: DataFrame, lift: int = 4) -> DataFrame:
    """The pairs of :func:`co_occurrences` with at least ``lift`` times the expected count, compared in whole numbers."""
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    return pairs.where(wide("together") * wide("n") >= wide("size_a") * wide("size_b") * lift)
