"""Packed posting lists: one row a keyword and block of documents, instead of one a posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristdex.model import PERCENTILES

#: Documents, and posting numbers of a document, that share a block, as powers of two.
BLOCK_BITS = 12

_ROW = ("doc", "seq", "score", *PERCENTILES)


def pack(postings: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(table_seq, keyword, block, part, first_doc, last_doc, n, postings) from postings.

    ``postings`` is sorted by (doc, seq, score).  A block holds the postings of
    2^bits neighbouring documents, cut again by posting number, so neither a hot
    keyword nor a hot document makes a row that can't be held; ``first_doc`` and
    ``last_doc`` let a scan skip blocks.  Rows without keyword or document are
    left out, repeated rows are kept.
    """
    rows = postings.where("keyword IS NOT NULL AND doc IS NOT NULL")
    place = [F.shiftright("doc", bits).alias("block"), F.shiftright(F.coalesce("seq", F.lit(0)), bits).alias("part")]
    grouped = rows.groupBy("table_seq", "keyword", *place).agg(
        F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*_ROW))).alias("postings")
    )
    return grouped


def unpack(blocks: DataFrame) -> DataFrame:
    """The postings of packed lists."""
    return blocks.select("table_seq", "keyword", F.explode("postings").alias("p")).select("table_seq", "keyword", *(F.col(f"p.{c}").alias(c) for c in _ROW))


def between(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Postings of documents ``first`` to ``last``; blocks outside are skipped by their bounds."""
    near = blocks.where((F.col("last_doc") >= first) & (F.col("first_doc") <= last))
    return unpack(near).where(F.col("doc").between(first, last))


def counts(blocks: DataFrame) -> DataFrame:
    """(keyword, n_postings, max_doc) without unpacking."""
    return blocks.groupBy("keyword").agg(F.sum("n").alias("n_postings"), F.max("last_doc").alias("max_doc"))
