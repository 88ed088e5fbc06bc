"""The algebra of result bags.

A bag holds postings ordered by document; each operator treats several postings
of one document in its own way, described at it.  Comparisons are IEEE: NaN is
in no relation.  All operators are lazy; joins are equi-joins on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristdex.model import BAG, PERCENTILES, Bag, real
from gristdex.session import placed

SAMPLE_SEED = 1234
#: Postings of a sample that one task gathers at most.
GATHERED = 100_000


def numbered(bag: Bag) -> DataFrame:
    """The bag with ``seq`` counting the postings of each document from 1."""
    if bag.unique:
        return bag.df.withColumn("seq", F.lit(1).cast("bigint"))
    place = Window.partitionBy("doc").orderBy("seq", "score", *PERCENTILES)
    return bag.df.withColumn("seq", F.row_number().over(place).cast("bigint"))


def union(a: Bag, b: Bag) -> Bag:
    """OR: of a document in both, all postings of ``b``, then those of ``a`` beyond their number (so the score of ``b`` wins)."""
    if a.unique and b.unique:
        rest = a.df.join(b.df.select("doc"), "doc", "left_anti")
        return Bag(b.df.select(*BAG).unionByName(rest.select(*BAG)), True)
    counts = b.df.groupBy("doc").agg(F.count(F.lit(1)).alias("taken"))
    rest = numbered(a).join(counts, "doc", "left").where(F.col("seq") > F.coalesce("taken", F.lit(0)))
    return Bag(numbered(b).select(*BAG).unionByName(rest.select(*BAG)))


def intersect(a: Bag, b: Bag) -> Bag:
    """AND: the postings of ``a`` whose document is in ``b``."""
    return Bag(a.df.join(b.df.select("doc"), "doc", "left_semi").select(*BAG), a.unique)


def subtract(a: Bag, b: Bag) -> Bag:
    """AND NOT: the postings of ``a`` whose document is not in ``b``."""
    return Bag(a.df.join(b.df.select("doc"), "doc", "left_anti").select(*BAG), a.unique)


def compare(bag: Bag, op: str, value: float) -> Bag:
    """Postings whose score is =, >, >=, < or <= a number (compared as doubles)."""
    s, v = F.col("score").cast("double"), F.lit(float(value))
    test: Column = {"=": s == v, ">": s > v, ">=": s >= v, "<": s < v, "<=": s <= v}[op]
    return Bag(bag.df.where(real(F.col("score")) & test), bag.unique)


def in_range(bag: Bag, low: float, high: float) -> Bag:
    """Postings whose score is between two numbers, both included; either order."""
    s = F.col("score").cast("double")
    return Bag(bag.df.where(real(F.col("score")) & s.between(min(low, high), max(low, high))), bag.unique)


def _zipped(a: Bag, b: Bag, how: str) -> DataFrame:
    """The k-th posting of a document in ``a`` beside its k-th in ``b``."""
    other = numbered(b).select("doc", "seq", F.col("score").alias("other"), F.lit(True).alias("matched"))
    return numbered(a).join(other, ["doc", "seq"], how)


def join_greater(a: Bag, b: Bag) -> Bag:
    """``A > B``: postings of ``a`` above the one beside them; those without one are dropped."""
    ok = real(F.col("score")) & real(F.col("other")) & (F.col("score") > F.col("other"))
    return Bag(_zipped(a, b, "inner").where(ok).select(*BAG), a.unique)


def join_less(a: Bag, b: Bag) -> Bag:
    """``A < B``: postings of ``a`` below the one beside them; those without one are dropped."""
    ok = real(F.col("score")) & real(F.col("other")) & (F.col("score") < F.col("other"))
    return Bag(_zipped(a, b, "inner").where(ok).select(*BAG), a.unique)


def order_by(a: Bag, b: Bag) -> Bag:
    """``A ORDER BY B``: the score beside each posting of ``a`` replaces its own; -inf where there is none."""
    score = F.when(F.col("matched"), F.col("other")).otherwise(F.lit(float("-inf"))).cast("float")
    return Bag(_zipped(a, b, "left").withColumn("score", score).select(*BAG), a.unique)


def _fold(bag: Bag, pick: str) -> Bag:
    """One posting a document; the percentiles are those of the first, a number wins over NaN."""
    if bag.unique:
        return bag
    number = F.when(real(F.col("score")), F.col("score"))
    best = F.max(number) if pick == "max" else F.min(number)
    first = F.min(F.struct("seq", "score", *PERCENTILES)).alias("first")
    folded = bag.df.groupBy("doc").agg(F.coalesce(best, F.lit(float("nan")).cast("float")).cast("float").alias("score"), first)
    return Bag(folded.select("doc", F.lit(1).cast("bigint").alias("seq"), "score", *(F.col(f"first.{c}").alias(c) for c in PERCENTILES)), True)


def maximum(bag: Bag) -> Bag:
    """MAX: the highest score of each document."""
    return _fold(bag, "max")


def minimum(bag: Bag) -> Bag:
    """MIN: the lowest score of each document."""
    return _fold(bag, "min")


def negate(bag: Bag) -> Bag:
    """``~``: the sign of every score turned; percentiles stay."""
    return Bag(bag.df.withColumn("score", (-F.col("score")).cast("float")), bag.unique)


def sample(bag: Bag, size: int) -> Bag:
    """RANDOM_SAMPLE: all postings if at most ``size``, else exactly ``size``, by a fixed hash.

    Up to ``GATHERED`` postings are gathered in one task; more are taken by their
    places in a range sort.
    """
    order = (F.xxhash64("doc", "seq", F.lit(SAMPLE_SEED)), "doc", "seq")
    n = numbered(bag)
    chosen = n.orderBy(*order).limit(max(size, 0)) if size <= GATHERED else placed(n, *order).where(F.col("place") < size)
    return Bag(chosen.select(*BAG), bag.unique)
