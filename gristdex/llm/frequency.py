"""Frequency of every distinct value or term (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers that share a container, as a power of two: places in it are 16-bit numbers.
CONTAINER_BITS = 16
_HALF = 1 << (CONTAINER_BITS - 1)


def term_bitmaps(df: DataFrame, term: str, record: str) -> DataFrame:
    """Vertical layout: the record-identifier bitmap of every term, as compressed containers.

    Columns: ``term``, ``chunk`` (record >> 16), ``held`` (the set of 16-bit
    places in the chunk that are set, two bytes each) and the occurrence counter
    ``n``.  A chunk without records has no row, so a rare term takes a row a
    record at most, and a row never has more than 65,536 places.  Rows with a null record
    make a container of their own with null ``chunk`` and no places; the null
    term keeps its bitmap.  Both are needed for totals.  Partial containers are
    merged by union before and after the shuffle, which is on term and chunk, so
    a hot term is spread.
    """
    rec = F.col(record).cast("bigint")
    place = (rec.bitwiseAND(2 * _HALF - 1) - _HALF).cast("short")
    rows = df.select(F.col(term).cast("string").alias("term"), F.shiftright(rec, CONTAINER_BITS).alias("chunk"), place.alias("place"))
    return rows.groupBy("term", "chunk").agg(F.collect_set("place").alias("held"), F.count(F.lit(1)).alias("n"))


def merge_bitmaps(*bitmaps: DataFrame) -> DataFrame:
    """Union of bitmaps made over several parts of the data: places as sets, counters by sum."""
    both = bitmaps[0]
    for more in bitmaps[1:]:
        both = both.unionByName(more)
    return both.groupBy("term", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.sum("n").alias("n"))


def cardinality(bitmaps: DataFrame) -> DataFrame:
    """(term, occurrences, docs) of every non-null term; a term without records has 0 docs."""
    docs = F.sum(F.size("held").cast("bigint")).alias("docs")
    # A filter on the key itself would reach the scan, and without the sum its counter would be pruned: the shuffle would be another one than that of the totals.
    found = bitmaps.groupBy("term").agg(F.sum("n").alias("occurrences"), docs, F.max(F.col("term").isNotNull()).alias("named"))
    return found.where("named AND occurrences > 0").select("term", "occurrences", "docs")


def all_records(bitmaps: DataFrame) -> DataFrame:
    """One row, ``docs`` and ``busiest``: the distinct non-null records of the whole collection, by union over the terms.

    The places of all terms meet as 64-bit words, combined map-side first.
    ``busiest`` is the largest counter of a container (null without records).
    """
    places = bitmaps.select("chunk", "n", F.explode("held").alias("place")).select("chunk", "n", F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, place & 63)").alias("bit"))
    words = places.groupBy("chunk", "word").agg(F.bit_or("bit").alias("bits"), F.max("n").alias("n"))
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("docs"), F.max("n").alias("busiest"))


def term_frequencies(df: DataFrame, term: str, record: str, rare: int = 2, common: float = 0.2) -> DataFrame:
    """Occurrences and document frequency of every term, and whether it is of use.

    Columns: ``term``, ``occurrences`` (rows, repeated ones too), ``docs``
    (distinct non-null records) and ``use``: ``rare`` (at most ``rare`` docs),
    ``common`` (more than ``common`` of all distinct records; this wins where both
    hold) or ``useful``.  Null terms have no row but their records count in the
    whole; the empty term is a term.  An empty table gives no row.

    Plan: the rows are read and shuffled once; frequencies and the total are both
    read off the same shuffled containers, as both use all their columns.
    """
    bitmaps = term_bitmaps(df, term, record)
    whole = all_records(bitmaps).select(F.struct("docs", "busiest").alias("whole")).scalar()
    found = cardinality(bitmaps).withColumn("whole", whole)
    # A quotient equals a decimal share exactly where the counts do; a product may miss by a bit.
    many = (F.try_divide(F.col("docs"), F.col("whole.docs")) > F.lit(common)) & (F.col("whole.busiest") > 0)
    return found.select("term", "occurrences", "docs", F.when(many, "common").when(F.col("docs") <= rare, "rare").otherwise("useful").alias("use"))
