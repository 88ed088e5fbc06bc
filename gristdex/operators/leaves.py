"""Leaves of expressions: keyword, document, substring and list look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristdex.functions.text import decode_uri, valid_host
from gristdex.model import BAG, BAG_SCHEMA, PERCENTILES, Bag, Index

_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def empty(index: Index) -> Bag:
    return Bag(index.spark.createDataFrame([], BAG_SCHEMA), True)


def _present(docs: DataFrame) -> DataFrame:
    """A bag of documents with score 0."""
    none = [F.lit(None).cast("float").alias(c) for c in PERCENTILES]
    return docs.select("doc", F.lit(1).cast("bigint").alias("seq"), F.lit(0.0).cast("float").alias("score"), *none)


def postings_of(index: Index, keyword: str) -> DataFrame:
    """All rows of one keyword, with ``table_seq``; the filter reaches the scan."""
    return index.rows().where(F.col("keyword") == keyword)


def exists(index: Index, keyword: str) -> bool:
    """Whether any table has the keyword."""
    return not postings_of(index, keyword).limit(1).isEmpty()


def keyword_leaf(index: Index, name: str) -> Bag:
    """Postings of a percent-decoded keyword, from the last table that has it."""
    rows = postings_of(index, decode_uri(name))
    if index.multi_index == "last":
        last = rows.agg(F.max("table_seq").alias("last")).scalar()
        rows = rows.where(F.col("table_seq") == last)
    return Bag(rows.select(*BAG))


def document_leaf(index: Index, name: str) -> Bag:
    """The document of that name in the first summary table that has it, score 0."""
    hits = index.summaries.where((F.col("key") == name) & F.col("doc").isNotNull())
    first = hits.agg(F.min(F.struct("table_seq", "doc")).alias("first")).where("first IS NOT NULL")
    return Bag(_present(first.select(F.col("first.doc").alias("doc"))), True)


def substring_leaf(index: Index, name: str) -> Bag:
    """``in-PREFIX:SUBSTRING``: documents of keywords that start with PREFIX and contain SUBSTRING, ASCII letters in any case; all tables."""
    prefix, colon, part = name[3:].partition(":")
    if not colon:
        return empty(index)
    rows = index.rows()
    lower = F.translate("keyword", *_ASCII)
    hits = rows.where(F.col("keyword").startswith(prefix) & F.contains(lower, F.lit(part.translate(str.maketrans(*_ASCII)))))
    return Bag(_present(hits.select("doc").distinct()), True)


def list_names(text: DataFrame, column: str) -> DataFrame:
    """Host names in list objects, with the header they stand under.

    Columns: ``name``, ``header``, ``header_key`` (six digits; null before any
    header).  Names are runs of ASCII letters, digits, dots and hyphens, in lower
    case, without a leading ``www.``; ``{Header}`` sets the header of what follows
    (letters, digits and `` .,_&-``); one broken off by another character is passed
    over and unsets it.  Of a repeated name the first place counts.
    """
    pieces = F.regexp_extract_all(F.col(column), F.lit(r"(\{[A-Za-z0-9 .,_&-]*\}?|[A-Za-z0-9.-]+)"), F.lit(1))
    tokens = text.select(F.posexplode(pieces).alias("pos", "token"))
    closed = F.when(F.col("token").endswith("}"), F.expr("substr(token, 2, length(token) - 2)"))
    numbered = tokens.withColumn("label", F.when(F.col("token").startswith("{"), F.coalesce(closed, F.lit(""))))
    # One object at a time is read, so one window holds its tokens.
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = numbered.withColumn("header", F.last("label", ignorenulls=True).over(upto)).withColumn("idx", F.count(F.when(F.col("token").endswith("}"), 1)).over(upto))
    name = F.regexp_replace(F.lower("token"), r"^www\.", "")
    names = placed.where("label IS NULL").select("pos", name.alias("name"), "header", "idx").where(valid_host(F.col("name")))
    first = names.groupBy("name").agg(F.min(F.struct("pos", "header", "idx")).alias("first"))
    key = F.when(F.col("first.idx") > 0, F.lpad((F.col("first.idx") - 1).cast("string"), 6, "0"))
    return first.select("name", F.col("first.header").alias("header"), key.alias("header_key"))


def list_leaf(index: Index, name: str) -> Bag:
    """``FIELD-in:OBJECT``: documents of ``FIELD:host`` for the hosts in an object; ``links-in`` looks up ``name:``; all tables.

    The bag carries the headers of its documents: the first by (header_key, name)
    where several names hit a document.
    """
    field, _, key = name.partition(":")
    field = field[:-3]
    field = "name" if field == "links" else field
    if index.objects is None:
        return empty(index)
    names = list_names(index.objects.where(F.col("key") == key).select("data").limit(1), "data")
    wanted = names.select(F.concat(F.lit(f"{field}:"), "name").alias("keyword"), "header", "header_key")
    hits = index.rows().where(F.col("keyword").startswith(f"{field}:")).select("keyword", "doc").join(wanted, "keyword")
    labelled = hits.where("header IS NOT NULL AND header <> ''").groupBy("doc").agg(F.min(F.struct("header_key", "keyword", "header")).alias("h"))
    headers = labelled.select("doc", F.col("h.header").alias("header"), F.col("h.header_key").alias("header_key"))
    return Bag(_present(hits.select("doc").distinct()), True, headers)


def leaf(index: Index, name: str) -> Bag:
    """Any leaf that is a word: list form, substring form or keyword."""
    colon = name.find(":")
    if colon > 3 and name[colon - 3 : colon] == "-in":
        return list_leaf(index, name)
    if name.startswith("in-"):
        return substring_leaf(index, name)
    return keyword_leaf(index, name)
