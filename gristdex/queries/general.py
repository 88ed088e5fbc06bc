"""The pN_ queries of the general operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristdex.operators.orphans import orphan_report, orphans
from gristdex.operators.skew import per_key
from gristdex.session import table

#: Tables of problem 5 and their key column.
KEYED = {"postings": "keyword", "time_series": "key"}


def _heavy(spark: SparkSession, d: str, name: str, share: float = 0.02) -> DataFrame:
    counted = per_key(table(spark, d, name), KEYED[name], share=share / 2)
    return counted.where(F.col("row_share") >= share).select(F.lit(name).alias("ref_table"), "key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _heavy(spark, d, "postings").unionByName(_heavy(spark, d, "time_series"))


def p5_per_keyword(spark: SparkSession, d: str) -> DataFrame:
    return per_key(table(spark, d, "postings"), "keyword", record="doc", value="score").select("key", "n_rows", "n_records", "value_min", "value_max")


def p5_per_series(spark: SparkSession, d: str) -> DataFrame:
    return per_key(table(spark, d, "time_series"), "key", record="ts", value="score").select("key", "n_rows", "n_records", "value_min", "value_max")


def _missed(spark: SparkSession, d: str) -> DataFrame:
    summaries = table(spark, d, "summaries")
    by_doc = orphans(table(spark, d, "postings"), "doc", "loaded_at", summaries, "doc", "added_at", "removed_at", "postings")
    return by_doc.unionByName(orphans(table(spark, d, "overrides"), "key", "loaded_at", summaries, "key", "added_at", "removed_at", "overrides"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _missed(spark, d).select("ref_table", "ref", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_missed(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p5_found, p5_per_keyword, p5_per_series, p7_found, p7_report)}


_PER_KEY = """SELECT {key} AS key, count(*) AS n_rows, count(DISTINCT {rec}) AS n_records,
 CAST(min(CASE WHEN NOT isnan(score) THEN score END) AS DOUBLE) AS value_min, CAST(max(CASE WHEN NOT isnan(score) THEN score END) AS DOUBLE) AS value_max
 FROM {table} WHERE {key} IS NOT NULL GROUP BY 1"""

_MISSED = """
WITH refs AS (SELECT 'postings' AS ref_table, CAST(doc AS VARCHAR) AS ref, loaded_at FROM postings WHERE doc IS NOT NULL
 UNION ALL SELECT 'overrides', key, loaded_at FROM overrides WHERE key IS NOT NULL),
olds AS (SELECT 'postings' AS ref_table, CAST(doc AS VARCHAR) AS ref, added_at, removed_at FROM summaries WHERE doc IS NOT NULL
 UNION SELECT 'overrides', key, added_at, removed_at FROM summaries WHERE key IS NOT NULL),
missed AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.ref_table = r.ref_table AND o.ref = r.ref
 AND (o.added_at IS NULL OR o.added_at <= r.loaded_at) AND (o.removed_at IS NULL OR o.removed_at > r.loaded_at)))
"""


def oracle_sql() -> dict[str, str]:
    heavy = "SELECT '{0}' AS ref_table, {1} AS key FROM {0} GROUP BY 2 HAVING {1} IS NOT NULL AND 50 * count(*) >= (SELECT count(*) FROM {0})"
    return {
        "p5_found": " UNION ALL ".join(heavy.format(t, k) for t, k in KEYED.items()),
        "p5_per_keyword": _PER_KEY.format(key="keyword", rec="doc", table="postings"),
        "p5_per_series": _PER_KEY.format(key="key", rec="ts", table="time_series"),
        "p7_found": _MISSED + "SELECT DISTINCT ref_table, ref, strftime(loaded_at, '%Y-%m') AS period FROM missed",
        "p7_report": _MISSED + "SELECT ref_table, strftime(loaded_at, '%Y-%m') AS period, count(DISTINCT ref) AS n_refs, CAST(count(*) AS BIGINT) AS n_rows FROM missed GROUP BY 1, 2",
    }
