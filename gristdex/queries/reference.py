"""Queries for the operators of the query language, loader and exports, each with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristdex.engine import Engine
from gristdex.functions.keywords import KeywordRules
from gristdex.functions.text import escape_tsv_column, valid_host
from gristdex.model import PERCENTILES, Index
from gristdex.operators.leaves import list_leaf, list_names
from gristdex.queries.sqlgen import BASE, body, cell, correlated, expression, folded, ranked
from gristdex.session import table
from gristdex.sources import blocks, catalog, export, load, merge, tables

RULES = KeywordRules(ephemeral=("acctbal", "/quality:[01]/"), timestamped=("event:",))
#: A list object with headers, for the list leaves.
HOSTS = "{Group One} kudivanemo.example, www.sufomitana.example; {Group-Two} vasegerele.example no.such.example {bad!} SUFOMITANA.example x. {Last_3}kudivanemo.example"
NOW = 20100.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def index_of(spark: SparkSession, d: str, multi_index: str = "last") -> Index:
    """The test tables as an index.

    Its catalog names the delta before the main table: of a keyword in both, the
    last has its way, which would else be the few rows of the delta.
    """
    objects = spark.createDataFrame([("hosts", HOSTS)], "key STRING, data STRING")
    postings = table(spark, d, "postings").withColumn("table_seq", F.lit(1) - F.col("table_seq"))
    return Index(postings, table(spark, d, "summaries"), table(spark, d, "overrides"), objects, RULES, multi_index)


def engine_of(spark: SparkSession, d: str, multi_index: str = "last") -> Engine:
    return Engine(index_of(spark, d, multi_index), now=NOW)


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bag(name: str, expr: str, sql: str | None = None, multi_index: str = "last") -> None:
    """A query whose rows are the (doc, score) of an expression's bag; ``sql`` follows the common tables."""
    QUERIES[name] = lambda spark, d: Engine(index_of(spark, d, multi_index)).evaluate(expr).df.select("doc", "score")
    SQL[name] = f"WITH {BASE}{sql}" if sql else f"WITH {BASE} SELECT doc, score FROM {expression(expr, multi_index == 'union')}"


def _of(keyword: str, table: str = "Q") -> str:
    return f"(SELECT doc, seq, score FROM {table} WHERE keyword = '{keyword}')"


def _nth(keyword: str, score: str = "score", where: str = "true") -> str:
    """The postings of each document in order, for SQL written by hand."""
    return f"(SELECT doc, {score} AS score, row_number() OVER (PARTITION BY doc ORDER BY seq, {score}) AS k FROM Q WHERE keyword = '{keyword}' AND {where})"


_HIGHEST = "coalesce(max(score) FILTER (WHERE NOT isnan(score)), CAST('NaN' AS FLOAT))"

bag("leaf_lookup", "status:open", f" SELECT doc, score FROM {_of('status:open')}")
bag("leaf_union", "status:open", f" SELECT doc, score FROM {_of('status:open', 'P')}", "union")
bag("leaf_uri_decoded", "%73tatus%3Ao%70en", f" SELECT doc, score FROM {_of('status:open')}")
bag("leaf_dup_events", "event:vote")
bag("doc_key", "KEY=p0000000001")
bag("substring_leaf", "in-lang:EN")
bag("op_or", "status:open + lang:fr")
bag("op_or_union", "status:open + lang:fr", multi_index="union")
bag("op_or_dups", "event:vote + event:edit", f", e AS {_nth('event:edit')}, v AS {_nth('event:vote')} SELECT doc, score FROM e UNION ALL SELECT v.doc, v.score FROM v ANTI JOIN e ON v.doc = e.doc AND v.k = e.k")
bag("op_and", "price AND status:open", f" SELECT a.doc, a.score FROM {_of('price')} a SEMI JOIN {_of('status:open')} b ON a.doc = b.doc")
bag("op_and_union", "price AND status:open", multi_index="union")
bag("op_and_juxtaposed", "event:view kind:item has:link", f" SELECT a.doc, a.score FROM {_of('event:view')} a SEMI JOIN {_of('kind:item')} b ON a.doc = b.doc SEMI JOIN {_of('has:link')} c ON a.doc = c.doc")
bag("op_subtract", "event:edit - status:hidden", f" SELECT a.doc, a.score FROM {_of('event:edit')} a ANTI JOIN {_of('status:hidden')} b ON a.doc = b.doc")
bag("op_and_not", "event:edit AND NOT lang:en", f" SELECT a.doc, a.score FROM {_of('event:edit')} a ANTI JOIN {_of('lang:en')} b ON a.doc = b.doc")
bag("op_chain", "event:edit + event:vote - lang:en kind:item", f""", v AS {_nth('event:vote')}, e AS {_nth('event:edit')},
u AS (SELECT doc, score FROM v UNION ALL SELECT e.doc, e.score FROM e ANTI JOIN v ON e.doc = v.doc AND e.k = v.k)
SELECT u.doc, u.score FROM u ANTI JOIN {_of('lang:en')} a ON u.doc = a.doc SEMI JOIN {_of('kind:item')} b ON u.doc = b.doc""")
bag("cmp_eq", "words = 120", f" SELECT doc, score FROM {_of('words')} WHERE score = 120")
bag("cmp_gt", "price > 100.5", f" SELECT doc, score FROM {_of('price')} WHERE CAST(score AS DOUBLE) > 100.5 AND NOT isnan(score)")
bag("cmp_ge", "event:ping >= 2024-06-01", f" SELECT doc, score FROM {_of('event:ping')} WHERE CAST(score AS DOUBLE) >= date_diff('day', DATE '1970-01-01', DATE '2024-06-01') AND NOT isnan(score)")
bag("cmp_lt", "acctbal < -10")
bag("cmp_le", "words <= 0x40", f" SELECT doc, score FROM {_of('words')} WHERE score <= 64")
bag("in_range", "price[80, 20]", f" SELECT doc, score FROM {_of('price')} WHERE CAST(score AS DOUBLE) BETWEEN 20 AND 80")
bag("gt_join", "event:edit > event:vote", f", e AS {_nth('event:edit')}, v AS {_nth('event:vote')} SELECT e.doc, e.score FROM e JOIN v ON e.doc = v.doc AND e.k = v.k WHERE e.score > v.score AND NOT isnan(e.score) AND NOT isnan(v.score)")
bag("gt_join_union", "event:edit > event:vote", multi_index="union")
bag("lt_join", "event:edit < event:vote")
bag("order_by", "event:vote ORDER BY price", f", v AS {_nth('event:vote')}, b AS {_nth('price')} SELECT v.doc, CASE WHEN b.doc IS NULL THEN CAST('-inf' AS FLOAT) ELSE b.score END AS score FROM v LEFT JOIN b ON v.doc = b.doc AND v.k = b.k")
bag("order_by_union", "event:vote ORDER BY price", multi_index="union")
bag("op_max", "MAX(event:vote + event:edit)")
bag("op_min", "MIN(price)", f" SELECT doc, coalesce(min(score) FILTER (WHERE NOT isnan(score)), CAST('NaN' AS FLOAT)) AS score FROM {_of('price')} GROUP BY doc")
bag("negate", "~acctbal", f" SELECT doc, -score AS score FROM {_of('acctbal')}")
bag("nested_expr", "MAX((event:edit > 19900) + event:vote) (status:open + status:pinned) - lang:de ORDER BY ~words", f""", e AS {_nth('event:edit', where='NOT isnan(score) AND CAST(score AS DOUBLE) > 19900')}, v AS {_nth('event:vote')},
m AS (SELECT doc, {_HIGHEST} AS score FROM (SELECT doc, score FROM v UNION ALL SELECT e.doc, e.score FROM e ANTI JOIN v ON e.doc = v.doc AND e.k = v.k) GROUP BY doc),
s AS (SELECT DISTINCT doc FROM Q WHERE keyword IN ('status:open', 'status:pinned')), w AS {_nth('words', '-score')}
SELECT m.doc, CASE WHEN w.doc IS NULL THEN CAST('-inf' AS FLOAT) ELSE w.score END AS score FROM m SEMI JOIN s ON m.doc = s.doc ANTI JOIN {_of('lang:de')} d ON m.doc = d.doc LEFT JOIN w ON m.doc = w.doc AND w.k = 1""")


@query("SELECT doc, coalesce(score, CAST('NaN' AS FLOAT)) AS score FROM postings WHERE keyword = 'event:vote' AND doc IS NOT NULL AND table_seq = 1")
def leaf_lookup_delta(spark: SparkSession, d: str) -> DataFrame:
    """A keyword of both tables, the delta last."""
    return Engine(Index(table(spark, d, "postings"))).evaluate("event:vote").df.select("doc", "score")


for _pick in ("max", "min"):
    QUERIES[f"dedupe_{_pick}"] = lambda spark, d, p=_pick: _dedupe(spark, d, p)
    SQL[f"dedupe_{_pick}"] = f"WITH {BASE} SELECT doc, score FROM {folded(expression('price', True), _pick)}"


def _dedupe(spark: SparkSession, d: str, pick: str) -> DataFrame:
    from gristdex.operators.evaluate import Evaluator

    return Evaluator(index_of(spark, d, "union")).result("price", use_max=pick == "max").df.select("doc", "score")


@query(f"WITH {BASE}, n AS (SELECT count(*) AS n FROM P WHERE keyword = 'event:view') SELECT least(n, 500) AS n_rows, least(n, 500) AS n_known FROM n")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    e = engine_of(spark, d, "union")
    whole = e.evaluate("event:view").df.select("doc", "seq", "score").distinct().withColumn("known", F.lit(1))
    chosen = e.evaluate("RANDOM_SAMPLE(event:view, 500)").df.select("doc", "score")
    known = whole.select("doc", "score", "known").distinct()
    return chosen.join(known, ["doc", "score"], "left").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.isnan("score"), 1).otherwise(F.col("known"))).alias("n_known"))


_LIST = """hosts AS (SELECT * FROM (VALUES ('kudivanemo.example', 'Group One', '000000'), ('sufomitana.example', 'Group One', '000000'), ('vasegerele.example', 'Group-Two', '000001'), ('no.such.example', 'Group-Two', '000001')) AS t(name, header, header_key)),
hits AS (SELECT p.doc, p.keyword, h.header, h.header_key FROM P p JOIN hosts h ON p.keyword = 'name:' || h.name)"""


@query(f"WITH {BASE}, {_LIST} SELECT DISTINCT doc, CAST(0 AS FLOAT) AS score FROM hits")
def list_leaf_docs(spark: SparkSession, d: str) -> DataFrame:
    return engine_of(spark, d).evaluate("links-in:hosts").df.select("doc", "score")


@query(f"WITH {BASE}, {_LIST} SELECT doc, header, header_key FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY header_key, keyword) AS rn FROM hits) WHERE rn = 1")
def list_headers(spark: SparkSession, d: str) -> DataFrame:
    return list_leaf(index_of(spark, d), "name-in:hosts").headers.select("doc", "header", "header_key")


# QUERY


def _page(spark: SparkSession, d: str, statement: str) -> DataFrame:
    return engine_of(spark, d).query(statement).rows


_TOPK = f"""a AS {_nth('price')}, w AS {_nth('words')},
matched AS (SELECT doc, {_HIGHEST} AS score FROM (SELECT a.doc, CASE WHEN w.doc IS NULL THEN CAST('-inf' AS FLOAT) ELSE w.score END AS score FROM a SEMI JOIN {_of('status:open')} s ON a.doc = s.doc LEFT JOIN w ON a.doc = w.doc AND a.k = w.k) GROUP BY doc),
page AS (SELECT *, row_number() OVER (ORDER BY isnan(score), score DESC, doc) AS n FROM matched QUALIFY n <= 25)"""


@query(f"WITH {BASE}, {_TOPK} SELECT page.doc, score, key, json FROM page LEFT JOIN F USING (doc)")
def query_topk(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (price AND status:open ORDER BY words) LIMIT 25").select("doc", "score", "key", "json")


@query(f"WITH {BASE} SELECT r.doc, score, key, json FROM {ranked('price AND status:open ORDER BY words', 25, union=True)} r LEFT JOIN F USING (doc)")
def query_topk_union(spark: SparkSession, d: str) -> DataFrame:
    return engine_of(spark, d, "union").query("QUERY (price AND status:open ORDER BY words) LIMIT 25").rows.select("doc", "score", "key", "json")


@query(f"WITH {BASE} SELECT r.doc, score, key FROM {ranked('event:vote', -1, 15)} r LEFT JOIN F USING (doc)")
def query_offset_only(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (event:vote) OFFSET 15").select("doc", "score", "key")


@query(f"WITH {BASE} SELECT r.doc, score, key FROM {ranked('event:vote', 20, 15)} r LEFT JOIN F USING (doc)")
def query_offset(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (event:vote) LIMIT 20 OFFSET 15 ROWS").select("doc", "score", "key")


@query(f"WITH {BASE} SELECT key FROM {ranked('price', 30)} r LEFT JOIN F USING (doc)")
def query_keys_only(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY KEYS FOR (price) FETCH FIRST 30 ROWS ONLY").select("key")


@query(f"WITH {BASE} SELECT count(*) AS n FROM {ranked('lang:en + lang:fr')}")
def query_result_count(spark: SparkSession, d: str) -> DataFrame:
    return engine_of(spark, d).query("QUERY (lang:en + lang:fr) LIMIT 3").matches.agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT doc, score FROM {ranked('~acctbal', 40)}")
def negate_asc_topk(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (~acctbal) LIMIT 40").select("doc", "score")


_OVERRIDE = f"""O AS (SELECT key, table_seq, min(json) AS json, dense_rank() OVER (ORDER BY table_seq) AS nth FROM overrides WHERE key IS NOT NULL GROUP BY 1, 2),
run AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY nth) AS rn FROM O),
X AS (SELECT key, string_agg({body("json")}, ',' ORDER BY nth) AS extra FROM run WHERE nth = rn GROUP BY 1)"""


@query(f"""WITH {BASE}, {_OVERRIDE}
SELECT r.doc, concat_ws(',', '"_key":"' || coalesce(F.key, '') || '"', {body("F.json")}, X.extra) AS object FROM {ranked("kind:item + lang:fr")} r LEFT JOIN F USING (doc) LEFT JOIN X ON F.key = X.key""")
def query_overrides(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (kind:item + lang:fr)").select("doc", "object")


def _thresholds(edges: list[float], headers: list[str], keys: list[str], key: str, expr: str, column: str = "score") -> str:
    cases = lambda out: "CASE " + " ".join(f"WHEN {column} >= {lo} AND {column} < {hi} THEN '{t}'" for lo, hi, t in zip(edges, edges[1:], out)) + " END"
    chain = f"(SELECT doc FROM {folded(expression(expr), 'max')})"
    out = f"SELECT p.doc, p.score, {cases(headers)} AS header, {cases(keys)} AS header_key FROM P p JOIN {chain} r USING (doc)"
    # Each table holding the keyword filters what the ones before left; the last supplies the scores.
    return f"""WITH {BASE}, inside AS (SELECT doc, score, table_seq FROM P WHERE keyword = '{key}' AND NOT isnan(score) AND score >= {edges[0]} AND score < {edges[-1]}),
one AS (SELECT i.doc FROM inside i JOIN {chain} r USING (doc) WHERE table_seq = 0), two AS (SELECT i.doc, i.score FROM inside i JOIN one USING (doc) WHERE table_seq = 1)
""" + out.replace("FROM P p JOIN " + chain + " r USING (doc)", "FROM two p")


@query(_thresholds([0, 20, 50.5, 100], ["0–20", "20–50.5", "50.5–100"], ["AAAAB", "AAAAC", "AAAAD"], "price", "status:open + kind:item + event:view"))
def thresholds_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (status:open + kind:item + event:view) THRESHOLDS 50.5, 0, 20, 100 FOR KEY 'price'").select("doc", "score", "header", "header_key")


@query(_thresholds([0, 20, 50.5, 100], ["0–20", "20–50.5", "50.5–100"], ["AAAAD", "AAAAC", "AAAAB"], "price", "event:view"))
def thresholds_reversed(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (event:view) THRESHOLDS 0, 20, 50.5, 100 FOR KEY '~price'").select("doc", "score", "header", "header_key")


@query(_thresholds([19783, 19784, 19900, 20100], ["March 1, 2024", "March 2, 2024–June 26, 2024", "June 26, 2024–January 12, 2025"], ["AAAAB", "AAAAC", "AAAAD"], "event:view", "lang:en"))
def thresholds_dates(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, "QUERY (lang:en) THRESHOLDS 19783, 19784, 19900, 20100 FOR KEY 'event:view'").select("doc", "score", "header", "header_key")


# SELECT

def _matrix(fields: list[str], last: str = "", union: bool = False) -> str:
    names = [f"f{i + 1}" for i in range(len(fields))]
    cells = ", ".join(f"coalesce({n}, CAST('NaN' AS FLOAT)) AS {n}" for n in names)
    joins = " ".join(f"LEFT JOIN {cell(f, n, union)} USING (doc)" for f, n in zip(fields, names))
    rows = folded(expression("status:open + kind:item", union), "min")
    return f"WITH {BASE} SELECT doc, key, {cells}{last} FROM {rows} r LEFT JOIN F USING (doc) {joins}"


@query(_matrix(["price", "words", "acctbal", "event:view"]))
def select_fields(spark: SparkSession, d: str) -> DataFrame:
    return engine_of(spark, d).select("SELECT price, words, acctbal, event:view FROM (status:open + kind:item)")


@query(_matrix(["price", "words", "acctbal", "event:view"], union=True))
def select_fields_union(spark: SparkSession, d: str) -> DataFrame:
    return engine_of(spark, d, "union").select("SELECT price, words, acctbal, event:view FROM (status:open + kind:item)")


@query(_matrix(["lang:en", "lang:fr", "has:link + has:image", "MAX(price) > 50"]))
def select_presence(spark: SparkSession, d: str) -> DataFrame:
    return engine_of(spark, d).select("SELECT PARALLEL 4 lang:en, lang:fr, has:link + has:image, MAX(price) > 50 FROM (status:open + kind:item)")


@query(_matrix(["quality:0", "~price"], ", json"))
def select_with_summaries(spark: SparkSession, d: str) -> DataFrame:
    return engine_of(spark, d).select("SELECT quality:0, ~price FROM (status:open + kind:item) WITH SUMMARIES")


# CORRELATE


def _correlate(spark: SparkSession, d: str, statement: str, multi_index: str = "last") -> DataFrame:
    found = engine_of(spark, d, multi_index).correlate(statement)
    return found.select("table_seq", "keyword", "low", "high", "n_a", "n_b", F.round("log_odds", 6).alias("log_odds"))


_TIMED, _EPHEMERAL = "starts_with(keyword, 'event:')", "(starts_with(keyword, 'acctbal') OR regexp_full_match(keyword, 'quality:[01]'))"


@query(correlated("kind:item", "in-lang:e"))
def correlate_boolean(spark: SparkSession, d: str) -> DataFrame:
    return _correlate(spark, d, "CORRELATE QUERY (kind:item), (in-lang:e)")


@query(correlated("words > 200", "words <= 200"))
def correlate_continuous(spark: SparkSession, d: str) -> DataFrame:
    return _correlate(spark, d, "CORRELATE QUERY (words > 200), (words <= 200)")


@query(correlated("words > 200", "words <= 200", union=True))
def correlate_continuous_union(spark: SparkSession, d: str) -> DataFrame:
    return _correlate(spark, d, "CORRELATE QUERY (words > 200), (words <= 200)", "union")


@query(correlated("event:vote", "words", _TIMED, _EPHEMERAL, now=NOW, union=True))
def correlate_timestamped_union(spark: SparkSession, d: str) -> DataFrame:
    return _correlate(spark, d, "CORRELATE QUERY (event:vote), (words)", "union")


@query(correlated("event:vote", "words", _TIMED, _EPHEMERAL, now=NOW))
def correlate_timestamped(spark: SparkSession, d: str) -> DataFrame:
    return _correlate(spark, d, "CORRELATE QUERY (event:vote), (words)")


@query(correlated("event:vote", "event:edit", _TIMED, _EPHEMERAL, both=True))
def correlate_both_timestamped(spark: SparkSession, d: str) -> DataFrame:
    return _correlate(spark, d, "CORRELATE QUERY (event:vote), (event:edit)")


# Catalog, keyword dictionary, loading


@query("SELECT line_type AS kind, path, coalesce(base_offset, 0) AS base, CAST(row_number() OVER (PARTITION BY line_type ORDER BY line_no) - 1 AS INT) AS seq FROM schema_lines")
def catalog_entries(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_lines(table(spark, d, "schema_lines"))


@query(f"WITH {BASE} SELECT table_seq, keyword, count(*) AS n_postings, bool_or(isnan(score) OR score <> 0) AS cont FROM P GROUP BY 1, 2")
def keyword_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).keyword_dict()


@query(f"WITH {BASE} SELECT keyword, count(*) AS n_postings, max(doc) AS max_doc FROM P GROUP BY 1")
def posting_stats(spark: SparkSession, d: str) -> DataFrame:
    """Read off packed lists, without unpacking them."""
    return blocks.counts(blocks.pack(table(spark, d, "postings")))


@query("SELECT keyword, doc, seq, score FROM postings WHERE keyword IS NOT NULL AND doc BETWEEN 100 AND 1000000100")
def posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.between(blocks.pack(table(spark, d, "postings")), 100, 1000000100).select("keyword", "doc", "seq", "score")


@query("SELECT table_seq, keyword, doc, seq, score, pct5, pct25, pct75, pct95 FROM postings WHERE keyword IS NOT NULL AND doc IS NOT NULL")
def posting_blocks_all(spark: SparkSession, d: str) -> DataFrame:
    return blocks.unpack(blocks.pack(table(spark, d, "postings")))


@query("SELECT key, doc FROM summaries WHERE key >= 'd' ORDER BY key, doc LIMIT 40 OFFSET 10")
def table_seek_skip(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_rows(table(spark, d, "summaries").select("key", "doc"), "key", 40, skip=10, start="d", then=("doc",))


@query("WITH s AS (SELECT key, doc, row_number() OVER (PARTITION BY key ORDER BY table_seq DESC, doc DESC) AS rn FROM summaries WHERE key IS NOT NULL AND doc IS NOT NULL) SELECT o.json, s.doc FROM overrides o JOIN s ON o.key = s.key AND rn = 1")
def load_resolve_docs(spark: SparkSession, d: str) -> DataFrame:
    return load.resolve_documents(table(spark, d, "overrides").select("key", "json"), table(spark, d, "summaries"), "key").select("json", "doc")


@query("SELECT keyword, count(*) AS n FROM postings WHERE keyword IS NOT NULL AND (score IS NULL OR isnan(score) OR score >= 19900) GROUP BY 1")
def load_threshold(spark: SparkSession, d: str) -> DataFrame:
    kept = load.threshold(table(spark, d, "postings"), 19900)
    return kept.where("keyword IS NOT NULL").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT keyword, doc, seq FROM postings WHERE regexp_full_match(keyword, 'event:(vote|edit)|status:.*n')")
def load_key_filter(spark: SparkSession, d: str) -> DataFrame:
    return load.key_filter(table(spark, d, "postings"), "event:(vote|edit)|status:.*n").select("keyword", "doc", "seq")


@query("SELECT 'foo:' || substr(keyword, 8) AS keyword, count(*) AS n FROM postings WHERE starts_with(keyword, 'status:') GROUP BY 1")
def load_prefix_rewrite(spark: SparkSession, d: str) -> DataFrame:
    rows = load.key_filter(table(spark, d, "postings"), "status:.*")
    return load.add_prefix(load.strip_prefix(rows, "status:"), "foo:").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT keyword) AS n_keywords, count(*) AS n_rows, count(DISTINCT keyword) AS n_pairs FROM postings WHERE keyword IS NOT NULL")
def shard_complete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "postings").where("keyword IS NOT NULL")
    shards = load.shard(rows, 4, 0).withColumn("shard", F.lit(0))
    for i in range(1, 4):
        shards = shards.unionByName(load.shard(rows, 4, i).withColumn("shard", F.lit(i)))
    by = shards.groupBy("keyword", "shard").agg(F.count(F.lit(1)).alias("n"))
    per_key = by.groupBy("keyword").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"))
    return per_key.agg(F.count(F.lit(1)).alias("n_keywords"), F.sum("n").alias("n_rows"), F.sum("shards").alias("n_pairs"))


# Merging

_CLEAN = "SELECT key, ts, min(score) AS score FROM time_series WHERE key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """One row a key and instant, as union takes no differing scores: the one of the lowest score, with its percentiles."""
    rows = table(spark, d, "time_series").where("key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("key", "ts").agg(F.min(F.struct("score", *PERCENTILES)).alias("one")).select("key", "ts", "one.*")


def _plain(rows: DataFrame) -> DataFrame:
    """Without percentiles, which can't be added."""
    return rows.select("key", "ts", "score", *(F.lit(None).cast("float").alias(c) for c in PERCENTILES))


def overlapping(rows: DataFrame) -> list[DataFrame]:
    """Two tables that share the middle third of the time ``rows`` cover, both ends included; no row is in neither."""
    at = rows.crossJoin(rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    parts = at.where("coalesce((ts - lo) * 3 <= (hi - lo) * 2, true)"), at.where("(ts - lo) * 3 >= hi - lo")
    return [p.drop("lo", "hi") for p in parts]


#: The same two tables, of rows ``c``.
_OVERLAPPING = """t AS (SELECT *, 3 * (epoch_us(ts) - epoch_us(min(ts) OVER ())) AS thrice, epoch_us(max(ts) OVER ()) - epoch_us(min(ts) OVER ()) AS span FROM c),
u AS (SELECT 0 AS source, * FROM t WHERE coalesce(thrice <= 2 * span, true) UNION ALL SELECT 1, * FROM t WHERE thrice >= span)"""


@query(_CLEAN)
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_series(overlapping(_clean(spark, d)), "union").select("key", "ts", "score")


@query(f"""WITH c AS (SELECT * FROM time_series WHERE key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY score, pct5 NULLS FIRST, pct25 NULLS FIRST, pct75 NULLS FIRST, pct95 NULLS FIRST) = 1), {_OVERLAPPING}
SELECT key, ts, score, pct5, pct25, pct75, pct95 FROM u QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY source) = 1""")
def merge_union_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_series(overlapping(_clean(spark, d)), "union").select("key", "ts", "score", *PERCENTILES)


@query(f"WITH c AS ({_CLEAN}) SELECT key, ts, CAST(CASE WHEN ts < '2020-01-01' AND ts >= '2018-01-01' THEN score + score ELSE score END AS FLOAT) AS score FROM c")
def merge_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = _plain(_clean(spark, d))
    return merge.merge_series([rows.where("ts < '2020-01-01'"), rows.where("ts >= '2018-01-01'")], "sum").select("key", "ts", "score")


@query(f"WITH c AS (SELECT key, ts, coalesce(score, CAST('NaN' AS FLOAT)) AS score FROM time_series WHERE key IS NOT NULL), {_OVERLAPPING} SELECT key, ts, CAST(sum(score) AS FLOAT) AS score FROM u GROUP BY 1, 2")
def merge_sum_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables, repeated ones and those without a score too, which makes the sum NaN."""
    rows = _plain(table(spark, d, "time_series").where("key IS NOT NULL"))
    return merge.merge_series(overlapping(rows), "sum").select("key", "ts", "score")


@query("""WITH r AS (SELECT * REPLACE (coalesce(score, CAST('NaN' AS FLOAT)) AS score), CASE WHEN arrived_at <= ts + INTERVAL 1 DAY THEN 0 ELSE 1 END AS source, coalesce(NOT isnan(pct5) AND NOT isinf(pct5), false) AS has FROM time_series WHERE key IS NOT NULL)
SELECT key, ts, score, pct5 FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY has, source, score, pct5 NULLS FIRST, pct25 NULLS FIRST, pct75 NULLS FIRST, pct95 NULLS FIRST) AS rn FROM r) WHERE rn = 1""")
def merge_pick_one(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "time_series")
    prompt = F.coalesce(F.col("arrived_at") <= F.col("ts") + F.expr("INTERVAL 1 DAY"), F.lit(False))
    return merge.merge_series([rows.where(prompt), rows.where(~prompt)], "pick-one").select("key", "ts", "score", "pct5")


@query(f"""WITH s AS (SELECT 0 AS source, key, min(json) AS json FROM summaries WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT 1, key, min(json) FROM overrides WHERE key IS NOT NULL GROUP BY key)
SELECT key, '{{' || coalesce(string_agg({body("json")}, ',' ORDER BY source), '') || '}}' AS json FROM s GROUP BY key""")
def merge_summaries(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: table(spark, d, name).where("key IS NOT NULL").groupBy("key").agg(F.min("json").alias("json"))
    return merge.merge_summaries([one("summaries"), one("overrides")], "union")


@query("SELECT keyword, count(*) AS n FROM postings WHERE keyword IS NOT NULL GROUP BY 1")
def merge_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "postings").where("keyword IS NOT NULL")
    events = F.col("keyword").startswith("event:")
    return merge.merge_index([rows.where(events), rows.where(~events)]).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


# Exports


@query("SELECT key, count(*) AS n FROM time_series WHERE key IS NOT NULL GROUP BY 1")
def dump_counts(spark: SparkSession, d: str) -> DataFrame:
    return export.series_counts(table(spark, d, "time_series"))


@query(f"WITH {BASE} SELECT keyword, doc, score FROM P")
def dump_index_raw(spark: SparkSession, d: str) -> DataFrame:
    return export.raw_postings(index_of(spark, d))


@query(f"WITH {BASE} SELECT keyword, key, json, score FROM P JOIN F USING (doc)")
def dump_index_resolved(spark: SparkSession, d: str) -> DataFrame:
    return export.resolved_postings(index_of(spark, d))


@query("SELECT key, json FROM summaries")
def dump_summaries(spark: SparkSession, d: str) -> DataFrame:
    return export.summaries(index_of(spark, d))


@query("SELECT key, strftime(ts, '%d.%m.%Y %H:%M') AS date, coalesce(score, CAST('NaN' AS FLOAT)) AS score FROM time_series WHERE key IS NOT NULL")
def dump_time_series(spark: SparkSession, d: str) -> DataFrame:
    return export.time_series(table(spark, d, "time_series"), "%d.%m.%Y %H:%M").select("key", "date", "score")


@query("SELECT key, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS date, pct5, pct25, pct75, pct95 FROM time_series WHERE key IS NOT NULL")
def time_series_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return export.time_series(table(spark, d, "time_series"), "%s").select("key", "date", *PERCENTILES)


@query("SELECT DISTINCT keyword AS key FROM postings WHERE keyword >= 'status:'")
def dump_keys_from(spark: SparkSession, d: str) -> DataFrame:
    return export.keys(export.scoped(table(spark, d, "postings"), "keyword", start="status:"))


@query("SELECT DISTINCT keyword AS key FROM postings WHERE starts_with(keyword, 'status:')")
def dump_keys_prefix(spark: SparkSession, d: str) -> DataFrame:
    return export.keys(export.scoped(table(spark, d, "postings"), "keyword", prefix="status:"))


# Helpers

_BACKSLASH = "chr(92)"


@query(f"SELECT doc_id, replace(replace(replace(replace(text, {_BACKSLASH}, {_BACKSLASH} || {_BACKSLASH}), chr(10), {_BACKSLASH} || 'n'), chr(13), {_BACKSLASH} || 'r'), chr(9), {_BACKSLASH} || 't') AS escaped FROM documents")
def escape_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", escape_tsv_column(F.col("text")).alias("escaped"))


@query("SELECT DISTINCT substr(keyword, 6) AS name, length(keyword) >= 8 AND NOT starts_with(keyword, 'name:.') AND NOT ends_with(keyword, '.') AS valid FROM postings WHERE starts_with(keyword, 'name:')")
def valid_hosts(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("substr(keyword, 6)")
    return table(spark, d, "postings").where(F.col("keyword").startswith("name:")).select(name.alias("name"), valid_host(name).alias("valid")).distinct()


@query("SELECT * FROM (VALUES ('kudivanemo.example', 'Group One', '000000'), ('sufomitana.example', 'Group One', '000000'), ('vasegerele.example', 'Group-Two', '000001'), ('no.such.example', 'Group-Two', '000001')) AS t(name, header, header_key)")
def list_object_names(spark: SparkSession, d: str) -> DataFrame:
    return list_names(spark.createDataFrame([(HOSTS,)], "data STRING"), "data")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
