"""The tables of an index and the shape of result bags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristdex.functions.keywords import KeywordRules

#: Optional percentiles of a posting; all null when it has none.
PERCENTILES = ("pct5", "pct25", "pct75", "pct95")
#: Columns of a result bag: postings of documents, ``seq`` orders those of one document.
BAG = ("doc", "seq", "score", *PERCENTILES)
BAG_SCHEMA = "doc BIGINT, seq BIGINT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT"


def real(score: Column) -> Column:
    """True for scores that compare as numbers: neither null nor NaN."""
    return score.isNotNull() & ~F.isnan(score)


def scored(score: Column) -> Column:
    """The score of a row: a missing one is NaN, so no column mixes the two."""
    return F.coalesce(score.cast("float"), F.lit(float("nan")).cast("float")).alias("score")


@dataclass(frozen=True)
class Index:
    """An index: the tables and their metadata.

    postings(table_seq INT, keyword STRING, doc BIGINT, seq INT, score FLOAT, pct5, pct25, pct75, pct95 FLOAT);
    summaries(table_seq INT, base BIGINT, doc BIGINT, key STRING, json STRING);
    overrides(table_seq INT, key STRING, json STRING); objects(key STRING, data STRING).
    Further columns are allowed and not read.
    """

    postings: DataFrame
    summaries: DataFrame | None = None
    overrides: DataFrame | None = None
    objects: DataFrame | None = None
    rules: KeywordRules = field(default_factory=KeywordRules)
    #: "last": the last table holding a keyword supplies it; "union": all tables do.
    multi_index: str = "last"
    #: Numbers of the override tables in catalog order; None: those found in ``overrides``.
    override_tables: tuple[int, ...] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def rows(self) -> DataFrame:
        """Postings in the shape of a bag plus ``table_seq`` and ``keyword``.

        Rows without keyword or document are no postings.  A null score is NaN,
        which is in no range; percentiles count only if the first is finite.
        """
        p = self.postings
        has = F.coalesce(~F.isnan("pct5") & (F.abs("pct5") < F.lit(float("inf"))), F.lit(False))
        percentiles = [F.when(has, F.col(c)).cast("float").alias(c) for c in PERCENTILES]
        return p.where("keyword IS NOT NULL AND doc IS NOT NULL").select("table_seq", "keyword", "doc", F.col("seq").cast("bigint").alias("seq"), scored(F.col("score")), *percentiles)

    def keyword_dict(self) -> DataFrame:
        """(table_seq, keyword, n_postings, cont): size of each list and whether any score isn't 0."""
        return self.rows().groupBy("table_seq", "keyword").agg(F.count(F.lit(1)).alias("n_postings"), F.max(F.isnan("score") | (F.col("score") != 0)).alias("cont"))

    def forward(self, docs: DataFrame | None = None) -> DataFrame:
        """One summary row a document: the lowest (table_seq, key, json) where rows repeat.

        With ``docs``, only of those: a page of results then meets the summaries in
        a semi-join before anything is grouped.
        """
        s = self.summaries.where("doc IS NOT NULL").select("table_seq", "doc", "key", "json")
        if docs is not None:
            s = s.join(docs.select("doc"), "doc", "left_semi")
        first = s.groupBy("doc").agg(F.min(F.struct("table_seq", "key", "json")).alias("s"))
        return first.select("doc", F.col("s.key").alias("key"), F.col("s.json").alias("json"))


@dataclass(frozen=True)
class Bag:
    """A lazy result bag; ``unique`` promises one row a document, which spares windows."""

    df: DataFrame
    unique: bool = False
    #: Labels of documents, from list objects: (doc, header, header_key).
    headers: DataFrame | None = None
