"""The pN_ queries of the llm operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristdex.llm import cooccurrence, distinctive, encode, frequency, mixing, overlap, topn, toxicity
from gristdex.session import table


def _family(spark: SparkSession, d: str, prefix: str) -> DataFrame:
    return table(spark, d, "postings").where(F.col("keyword").startswith(prefix))


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_sizes(_family(spark, d, "group:"), "keyword", "doc")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.contained_pairs(p1_overlaps(spark, d)).select("keyword_a", "keyword_b")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, d, "postings"), "keyword", "doc").select(F.col("term").alias("keyword"), "occurrences", "docs", "use")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("use <> 'useful'").select("keyword")


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    weights = distinctive.log_entropy(_family(spark, d, "word:"), "keyword", "doc", "seq")
    return weights.select(F.col("rec").alias("doc"), F.col("term").alias("keyword"), "tf", "docs", F.round("weight", 6).alias("weight"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    weights = distinctive.log_entropy(_family(spark, d, "word:"), "keyword", "doc", "seq")
    return distinctive.distinctive_terms(weights).select(F.col("rec").alias("doc"), F.col("term").alias("keyword"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.co_occurrences(_family(spark, d, "tag:"), "keyword", "doc")
    return pairs.select("keyword_a", "keyword_b", "together", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.co_occurrences(_family(spark, d, "tag:"), "keyword", "doc", min_count=5, min_share=0.001)
    return cooccurrence.associated(pairs).select("keyword_a", "keyword_b")


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_family(spark, d, "rank:"), "keyword", "doc", "score", 5).select(F.col("group_key").alias("keyword"), F.col("item").alias("doc"), "score", "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select("keyword", "doc")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().where("capped").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).records()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.train(documents, table(spark, d, "labels")).score(documents, keep=("source",))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_overlaps, p2_found, p2_terms, p3_found, p3_weights, p4_found, p4_pairs, p6_found, p6_top, p8_ids, p9_found, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}


_MEMBERS = "SELECT DISTINCT keyword, doc FROM postings WHERE doc IS NOT NULL AND keyword LIKE '{}:%'"

_OVERLAP = f"""
WITH m AS ({_MEMBERS.format("group")}), s AS (SELECT keyword, count(*) AS n FROM m GROUP BY 1),
pairs AS (SELECT a.keyword AS keyword_a, b.keyword AS keyword_b, count(*) AS shared FROM m a JOIN m b ON a.doc = b.doc AND a.keyword < b.keyword GROUP BY 1, 2)
"""

_TERMS = """
WITH n AS (SELECT count(DISTINCT doc) AS n FROM postings),
t AS (SELECT keyword, count(*) AS occurrences, count(DISTINCT doc) AS docs FROM postings WHERE keyword IS NOT NULL GROUP BY 1),
terms AS (SELECT keyword, occurrences, docs, CASE WHEN docs > 0.2 * n THEN 'common' WHEN docs <= 2 THEN 'rare' ELSE 'useful' END AS "use" FROM t, n)
"""

_WORDS = """
WITH o AS (SELECT DISTINCT keyword, doc, seq FROM postings WHERE keyword LIKE 'word:%' AND doc IS NOT NULL),
f AS (SELECT keyword, doc, count(*) AS tf FROM o GROUP BY 1, 2),
d AS (SELECT doc, sum(tf) AS total FROM f GROUP BY 1),
n AS (SELECT count(*) AS n FROM d),
k AS (SELECT keyword, count(*) AS docs, sum(tf) AS gf, sum(tf * ln(tf)) AS s FROM f GROUP BY 1)
"""

_TAGS = f"""
WITH m AS ({_MEMBERS.format("tag")}), s AS (SELECT keyword, count(*) AS n FROM m GROUP BY 1), n AS (SELECT count(DISTINCT doc) AS n FROM m),
p AS (SELECT a.keyword AS keyword_a, b.keyword AS keyword_b, count(*) AS together FROM m a JOIN m b ON a.doc = b.doc AND a.keyword < b.keyword GROUP BY 1, 2),
q AS (SELECT p.*, a.n AS size_a, b.n AS size_b, n.n AS n FROM p JOIN s a ON a.keyword = keyword_a JOIN s b ON b.keyword = keyword_b CROSS JOIN n)
"""

_TOP = """
WITH b AS (SELECT keyword, doc, max(score) AS score FROM postings WHERE keyword LIKE 'rank:%' AND doc IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
r AS (SELECT keyword, doc, score, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, doc) AS rank FROM b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _OVERLAP + "SELECT keyword_a, keyword_b FROM pairs JOIN s a ON a.keyword = keyword_a JOIN s b ON b.keyword = keyword_b WHERE 2 * shared >= least(a.n, b.n)",
        "p1_overlaps": _OVERLAP + "SELECT keyword_a, keyword_b, a.n AS size_a, b.n AS size_b, shared FROM pairs JOIN s a ON a.keyword = keyword_a JOIN s b ON b.keyword = keyword_b",
        "p2_found": _TERMS + "SELECT keyword FROM terms WHERE \"use\" <> 'useful'",
        "p2_terms": _TERMS + 'SELECT keyword, occurrences, docs, "use" FROM terms',
        "p3_found": _WORDS + "SELECT f.doc, f.keyword FROM f JOIN d USING (doc) JOIN k USING (keyword) CROSS JOIN n WHERE 5 * tf >= total AND (docs <= 3 OR docs < 0.005 * n)",
        "p3_weights": _WORDS + "SELECT f.doc, f.keyword, CAST(tf AS BIGINT) AS tf, docs, round(ln(1 + tf) * greatest(0.0, least(1.0, CASE WHEN n > 1 THEN 1 - (ln(gf) - s / gf) / ln(n) ELSE 1.0 END)), 6) AS weight FROM f JOIN k USING (keyword) CROSS JOIN n",
        "p4_found": _TAGS + "SELECT keyword_a, keyword_b FROM q WHERE together >= 5 AND 1000 * together >= n AND together * n >= 4 * size_a * size_b",
        "p4_pairs": _TAGS + "SELECT keyword_a, keyword_b, together, round(CAST(together AS DOUBLE) * n / (CAST(size_a AS DOUBLE) * size_b), 6) AS lift, CASE WHEN together < size_a THEN round((1 - CAST(size_b AS DOUBLE) / n) / (1 - CAST(together AS DOUBLE) / size_a), 6) END AS conviction FROM q",
        "p6_found": _TOP + "SELECT keyword, doc FROM r WHERE rank <= 5",
        "p6_top": _TOP + "SELECT keyword, doc, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    }
