"""Queries that go through files or printed lines: loaders, writers, catalogs, sinks and scripts, each with SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristdex.engine import Engine
from gristdex.functions.text import escape_tsv_column, general, minute_text, short_float32
from gristdex.model import PERCENTILES
from gristdex.operators.leaves import exists
from gristdex.operators.search import json_quoted
from gristdex.plans.parser import parse_expression
from gristdex.queries.reference import _TOPK, RULES, _of, engine_of, index_of
from gristdex.queries.sqlgen import BASE, body, correlated
from gristdex.session import fresh_path, table
from gristdex.sources import catalog, export, load, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query by its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Text and columns that are loaded.

_WHOLE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})" for c in PERCENTILES)
_PCT = ", ".join(f"CASE WHEN {_WHOLE} THEN {c} END AS {c}" for c in PERCENTILES)


def _whole() -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in PERCENTILES))


def _value() -> Column:
    """The score, and the percentiles if there are all four, as the text of a field."""
    number = F.col("score").cast("string")
    return F.when(_whole(), F.concat_ws(" ", number, *(F.col(c).cast("string") for c in PERCENTILES))).otherwise(number)


def _lines(spark: SparkSession, rows: DataFrame, *fields: Column, delimiter: str = "\t", line_end: str | None = None) -> str:
    """Writes a text file of delimited fields and returns its path."""
    path = fresh_path(spark)
    rows.select(F.concat_ws(delimiter, *fields).alias("value")).write.text(path, lineSep=line_end)
    return path


_LAST_NAME = "N AS (SELECT key, doc FROM summaries WHERE key IS NOT NULL AND doc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY table_seq DESC, doc DESC) = 1)"


@query(f"""WITH {BASE}, {_LAST_NAME},
R AS (SELECT keyword, N.doc, score, {_PCT} FROM postings p JOIN F ON p.doc = F.doc JOIN N ON F.key = N.key WHERE keyword IS NOT NULL AND score IS NOT NULL)
SELECT keyword, doc, row_number() OVER (PARTITION BY keyword, doc ORDER BY score, pct5 NULLS FIRST, pct25 NULLS FIRST, pct75 NULLS FIRST, pct95 NULLS FIRST) AS seq, score, pct5, pct25, pct75, pct95 FROM R""")
def load_index_text(spark: SparkSession, d: str) -> DataFrame:
    """Postings written as text lines with document names and loaded again."""
    index = index_of(spark, d)
    rows = table(spark, d, "postings").where("keyword IS NOT NULL AND score IS NOT NULL").join(index.forward().where("key IS NOT NULL").select("doc", F.col("key").alias("name")), "doc")
    path = _lines(spark, rows, escape_tsv_column(F.col("keyword")), escape_tsv_column(F.col("name")), _value())
    return load.load_index(spark, path, index.summaries).select("keyword", "doc", "seq", "score", *PERCENTILES)


@query(f"SELECT key, epoch_us(date_trunc('second', ts)) AS at, score, {_PCT} FROM time_series WHERE key IS NOT NULL AND score IS NOT NULL AND ts IS NOT NULL")
def load_series_text(spark: SparkSession, d: str) -> DataFrame:
    """Time series written as text lines with formatted dates and loaded again."""
    rows = table(spark, d, "time_series").where("key IS NOT NULL AND score IS NOT NULL AND ts IS NOT NULL")
    path = _lines(spark, rows, escape_tsv_column(F.col("key")), F.date_format("ts", "dd.MM.yyyy HH-mm-ss"), _value())
    return load.load_time_series(spark, path, "%d.%m.%Y %H-%M-%S").select("key", F.unix_micros("ts").alias("at"), "score", *PERCENTILES)


@query("SELECT key, epoch_us(date_trunc('second', ts)) AS at, score FROM time_series WHERE key IS NOT NULL AND NOT contains(key, ';') AND score IS NOT NULL AND ts IS NOT NULL")
def load_series_seconds(spark: SparkSession, d: str) -> DataFrame:
    """The same with seconds, another delimiter and no escapes."""
    rows = table(spark, d, "time_series").where("key IS NOT NULL AND NOT contains(key, ';') AND score IS NOT NULL AND ts IS NOT NULL")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    # Keys may hold line breaks but no semicolon, so a line ends with both.
    end = ";\n"
    path = _lines(spark, rows, F.col("key"), seconds, F.col("score").cast("string"), delimiter=";", line_end=end)
    return load.load_time_series(spark, path, "%s", ";", unescape=False, line_end=end).select("key", F.unix_micros("ts").alias("at"), "score")


@query("""WITH K AS (SELECT key, coalesce(min(json), '') AS json FROM summaries WHERE key IS NOT NULL GROUP BY key)
SELECT 5000 + row_number() OVER (ORDER BY key) - 1 AS doc, 5000 AS base, key, json FROM K""")
def load_summaries_text(spark: SparkSession, d: str) -> DataFrame:
    """Summaries written as text lines, loaded and numbered in key order."""
    rows = table(spark, d, "summaries").where("key IS NOT NULL").groupBy("key").agg(F.coalesce(F.min("json"), F.lit("")).alias("json"))
    path = _lines(spark, rows, escape_tsv_column(F.col("key")), escape_tsv_column(F.col("json")))
    return load.load_summaries(spark, path, 5000).select("doc", F.col("base").cast("int").alias("base"), "key", "json")


@query("SELECT keyword, CAST(doc AS VARCHAR) AS name, coalesce(score, CAST(0 AS FLOAT)) AS score FROM postings")
def load_columns(spark: SparkSession, d: str) -> DataFrame:
    """A columnar file whose fields are named by the caller."""
    path = fresh_path(spark)
    table(spark, d, "postings").select(F.col("keyword").alias("a"), F.col("doc").cast("string").alias("b"), F.col("score").alias("c")).write.parquet(path)
    return load.columnar(spark.read.parquet(path), "a", "b", "c").select("keyword", "name", "score")


# Tables that are written.


@query("""SELECT codec, count(*) AS n_rows, count(DISTINCT key) AS n_keys, CAST(sum(doc) AS BIGINT) AS docs, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS shared_keys
FROM summaries, (VALUES ('none'), ('snappy'), ('zstd')) AS c(codec) GROUP BY codec""")
def table_written_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Tables of each codec: what was written, rows that come before a smaller key in their file, and keys in two files."""
    rows = table(spark, d, "summaries").repartition(8)
    parts = []
    for codec in ("none", "snappy", "zstd"):
        path = fresh_path(spark)
        tables.write_table(rows, path, compression=codec)
        # A file is what one task of the writer held, and so is a window here.
        back = spark.read.parquet(path).select("key", "doc", "_metadata.file_path", "_metadata.row_index")
        step = F.when(F.lag("key").over(Window.partitionBy("file_path").orderBy("row_index")) > F.col("key"), 1)
        checked = back.withColumn("back", step).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("doc").alias("docs"), F.count("back").alias("back"), F.count_distinct("file_path").alias("files"))
        named = F.count("key").alias("n_keys")
        parts.append(checked.agg(F.sum("n").alias("n_rows"), named, F.sum("docs").alias("docs"), F.sum("back").alias("out_of_order"), F.count_if((F.col("files") > 1) & F.col("key").isNotNull()).alias("shared_keys")).withColumn("codec", F.lit(codec)))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT key, min(json) AS json FROM overrides WHERE key IS NOT NULL GROUP BY key")
def table_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """A table whose keys are checked to be unique as it is read."""
    return tables.unique_keys(table(spark, d, "overrides").where("key IS NOT NULL").groupBy("key").agg(F.min("json").alias("json")))


def _stored(spark: SparkSession, d: str) -> Engine:
    """An engine over tables on disk, one for each table number, found through a catalog file."""
    lines = ["# tables"]
    # The delta comes before the main table, as in the other queries.
    for kind, name, key, order in (("summary", "summaries", "key", (0, 1, 2)), ("index", "postings", "keyword", (1, 0)), ("summary-override", "overrides", "key", (0, 1, 2))):
        df = table(spark, d, name)
        for n in order:
            path = fresh_path(spark)
            tables.write_table(df.where(F.col("table_seq") == n).drop("table_seq", "base"), path, key)
            lines.append(f"{kind}\t{path}\t{n * 1000}" if kind == "summary" else f"{kind}\t{path}")
    at = fresh_path(spark)
    spark.createDataFrame([("\n".join(lines),)], "value STRING").coalesce(1).write.text(at)
    return Engine(tables.open_index(spark, catalog.load_catalog(spark, at), RULES))


@query(f"WITH {BASE} SELECT a.doc, a.score FROM {_of('price')} a SEMI JOIN {_of('status:open')} b ON a.doc = b.doc")
def stored_search(spark: SparkSession, d: str) -> DataFrame:
    """An expression over tables that were written and opened through their catalog."""
    return _stored(spark, d).evaluate("price AND status:open").df.select("doc", "score")


@query("SELECT line_type AS kind, path, coalesce(base_offset, 0) AS base, CAST(row_number() OVER (PARTITION BY line_type ORDER BY line_no) - 1 AS INT) AS seq FROM schema_lines")
def catalog_text(spark: SparkSession, d: str) -> DataFrame:
    """The catalog as a text file, read by its parser; base offsets are written in hex."""
    base = F.concat(F.lit("0x"), F.hex("base_offset"))
    rows = table(spark, d, "schema_lines").coalesce(1).sortWithinPartitions("line_no")
    path = _lines(spark, rows, F.col("line_type"), F.col("path"), base)
    return spark.createDataFrame([(e.kind, e.path, e.base, e.seq) for e in catalog.load_catalog(spark, path).entries], "kind STRING, path STRING, base BIGINT, seq INT")


# Printed lines.


def _printed(rows: DataFrame, schema: str, lines: Callable[[list[dict]], Iterator[str]]) -> DataFrame:
    """Lines of rows, printed where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"line": list(lines(batch.to_dict("records")))})

    return rows.mapInPandas(run, schema)


@query(f"""WITH {BASE}, {_TOPK},
O AS (SELECT key, table_seq, min(json) AS json, dense_rank() OVER (ORDER BY table_seq) AS nth FROM overrides WHERE key IS NOT NULL GROUP BY 1, 2),
X AS (SELECT key, string_agg({body("json")}, ',' ORDER BY nth) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY nth) AS rn FROM O) WHERE nth = rn GROUP BY 1)
SELECT n, CASE WHEN n = 1 THEN '{{"result-count":' || (SELECT count(*) FROM matched) || ',"result":[' ELSE '' END || '{{' || concat_ws(',', '"_key":"' || coalesce(F.key, '') || '"', {body("F.json")}, X.extra) || '}}'
 || CASE WHEN n = (SELECT max(n) FROM page) THEN ']}}' ELSE ',' END AS line FROM page LEFT JOIN F USING (doc) LEFT JOIN X ON F.key = X.key UNION ALL SELECT 1, '[]' WHERE NOT EXISTS (SELECT 1 FROM page)""")
def query_json(spark: SparkSession, d: str) -> DataFrame:
    """The result object of a page as it is printed."""
    lines = engine_of(spark, d).query("QUERY (price AND status:open ORDER BY words) LIMIT 25").json_text()
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines, 1)], "n BIGINT, line STRING")


@query(f"""WITH {BASE}, R AS (SELECT DISTINCT doc FROM {_of('status:open')}),
A AS (SELECT doc, coalesce(min(score) FILTER (WHERE NOT isnan(score)), CAST('NaN' AS FLOAT)) AS a FROM {_of('words')} GROUP BY doc), B AS (SELECT DISTINCT doc FROM {_of('lang:en')})
SELECT coalesce(key, '') || ',' || CASE WHEN a IS NULL OR isnan(a) THEN 'nan' ELSE printf('%.9g', CAST(a AS DOUBLE)) END || ',' || CASE WHEN B.doc IS NULL THEN 'nan' ELSE '1' END || ',"' || replace(coalesce(json, ''), '"', '""') || '"' AS line
FROM R LEFT JOIN F USING (doc) LEFT JOIN A ON R.doc = A.doc LEFT JOIN B ON R.doc = B.doc""")
def select_csv(spark: SparkSession, d: str) -> DataFrame:
    """A feature matrix as comma-separated lines."""
    rows = engine_of(spark, d).select("SELECT words, lang:en FROM (status:open) WITH SUMMARIES")
    return _printed(rows, "line STRING", lambda rs: export.matrix_lines(rs, ["f1", "f2"], True))


_NUMBER = "regexp_replace(CAST({} AS VARCHAR), '[.]0$', '')"
_MINUTE = "strftime(make_timestamp(CAST(trunc(CAST({} AS DOUBLE) * 86400) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M')"
_EDGE = f"CASE WHEN starts_with(keyword, 'event:') THEN {_MINUTE} ELSE {_NUMBER} END"


@query(f"""SELECT printf('%.3f', log_odds) || chr(9) || n_a || chr(9) || n_b || chr(9) || keyword
 || CASE WHEN low IS NOT NULL THEN '≥' || {_EDGE.format("low", "low")} WHEN high IS NOT NULL THEN '≤' || {_EDGE.format("high", "high")} ELSE '' END AS line FROM ({correlated("words > 200", "words <= 200", union=True)})""")
def correlate_text(spark: SparkSession, d: str) -> DataFrame:
    """Mined ranges as they are printed."""
    rows = engine_of(spark, d, "union").correlate("CORRELATE QUERY (words > 200), (words <= 200)")
    found = rows.select("keyword", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "log_odds", "n_a", "n_b", "days_before")
    none = lambda r: {k: None if isinstance(v, float) and v != v else v for k, v in r.items()}
    return _printed(found, "line STRING", lambda rs: export.correlate_lines(map(none, rs), RULES.is_timestamped))


@query("SELECT DISTINCT printf('%.9g', CAST(score AS DOUBLE)) || ' ' || " + _NUMBER.format("score") + " AS line FROM time_series WHERE abs(score) BETWEEN 0.001 AND 1000000 AND NOT isnan(score)")
def format_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by nine digits, and by as few as tell them apart."""
    rows = table(spark, d, "time_series").where("abs(score) BETWEEN 0.001 AND 1000000 AND NOT isnan(score)").select(F.col("score").cast("double").alias("score"), F.col("score").alias("single")).distinct()
    return _printed(rows, "line STRING", lambda rs: (f"{general(r['score'])} {short_float32(r['single'])}" for r in rs))


@query(f"SELECT DISTINCT {_MINUTE.format('score')} AS line FROM postings WHERE keyword = 'event:vote' AND score BETWEEN 1 AND 40000")
def format_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Times of events, days since 1970, as text."""
    days = table(spark, d, "postings").where("keyword = 'event:vote' AND score BETWEEN 1 AND 40000").select(F.col("score").cast("double").alias("days")).distinct()
    return _printed(days, "line STRING", lambda rs: (minute_text(r["days"]) for r in rs)).distinct()


@query("SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS quoted FROM documents WHERE text IS NOT NULL")
def json_strings(spark: SparkSession, d: str) -> DataFrame:
    """Texts as JSON strings."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", json_quoted(F.col("text")).alias("quoted"))


# Statements.

_PARSED = [
    ("a b - c ORDER BY ~d", "(((a AND b) - c) ORDER BY ~(d))"),
    ("a + b c", "((a + b) AND c)"),
    ("a > 5 b", "((a>5) AND b)"),
    ("a > b + c", "((a>b) + c)"),
    ("~a > 5", "~((a>5))"),
    ("x[7, 3]", "(x[3,7])"),
    ("x >= 0x1F", "(x>=31)"),
    ("x < 1970-01-11", "(x<10)"),
    ("a AND NOT b", "(a - b)"),
    ("MAX(a OR b) MIN(c)", "(MAX((a + b)) AND MIN(c))"),
    ('KEY = "some name" + links-in:list', "(KEY=some name + links-in:list)"),
    ("RANDOM_SAMPLE((a b), 10)", "RANDOM_SAMPLE((a AND b), 10)"),
]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_text(a)}, {_text(b)})" for a, b in _PARSED) + ") AS t(expr, normal)")
def parse_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normal texts of expressions, against texts written by hand."""
    return spark.createDataFrame([(e, str(parse_expression(e))) for e, _ in _PARSED], "expr STRING, normal STRING")


_ASKED = ["price", "status:open", "Status:open", "status:", "event:view", "nothing at all", ""]


@query("SELECT k AS keyword, k IN (SELECT keyword FROM postings WHERE doc IS NOT NULL AND keyword IS NOT NULL) AS there FROM (VALUES " + ", ".join(f"({_text(k)})" for k in _ASKED) + ") AS t(k)")
def keyword_exists(spark: SparkSession, d: str) -> DataFrame:
    index = index_of(spark, d)
    return spark.createDataFrame([(k, exists(index, k)) for k in _ASKED], "keyword STRING, there BOOLEAN")


_SCRIPT = """SET OUTPUT FORMAT CSV; SET TIME FORMAT '%Y'; PARSE a  b - c;
QUERY KEYS FOR (price AND status:open ORDER BY words) FETCH FIRST 3 ROWS ONLY; SELECT words FROM (KEY=p0000000001); SET TIME FORMAT 'LONG'; QUERY (nothing) OFFSET 1;""".replace("LONG", "x" * 70)


@query(f"""WITH {BASE}, {_TOPK}, D AS (SELECT doc FROM summaries WHERE key = 'p0000000001' AND doc IS NOT NULL ORDER BY table_seq, doc LIMIT 1),
G AS (SELECT doc, coalesce(min(score) FILTER (WHERE NOT isnan(score)), CAST('NaN' AS FLOAT)) AS a FROM {_of('words')} GROUP BY doc)
SELECT '1' AS part, '((a AND b) - c)' AS line UNION ALL SELECT '2' || n, coalesce(key, '') FROM page LEFT JOIN F USING (doc) WHERE n <= 3
UNION ALL SELECT '3', coalesce(key, '') || ',' || CASE WHEN a IS NULL OR isnan(a) THEN 'nan' ELSE printf('%.9g', CAST(a AS DOUBLE)) END FROM D LEFT JOIN F USING (doc) LEFT JOIN G ON D.doc = G.doc
UNION ALL SELECT '4', '{{"error": "time format too long"}}' UNION ALL SELECT '5', '[]'""")
def script_lines(spark: SparkSession, d: str) -> DataFrame:
    """Everything a script prints, statement by statement; one that fails prints an error object and the script goes on."""
    lines = list(engine_of(spark, d).run(_SCRIPT))
    parts = ["1", *(f"2{i + 1}" for i in range(len(lines) - 4)), "3", "4", "5"]
    return spark.createDataFrame(list(zip(parts, lines, strict=True)), "part STRING, line STRING")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
