"""SQL of expressions, written independently of the Spark operators: what most queries are checked by.

Trees come from this package's parser; chains and nested expressions have SQL of
their own in the queries, so that precedence is checked too.
"""

from __future__ import annotations

from gristdex.plans.nodes import Binary, Compare, DocKey, Expr, InRange, Leaf, Sample, Unary
from gristdex.plans.parser import parse_expression

#: Common table expressions: postings P (the delta is table 0, the main table 1), of these Q in the last table of their keyword, and first summary rows F.
BASE = """P AS (SELECT 1 - table_seq AS table_seq, keyword, doc, CAST(seq AS BIGINT) AS seq, coalesce(score, CAST('NaN' AS FLOAT)) AS score FROM postings WHERE keyword IS NOT NULL AND doc IS NOT NULL),
Q AS (SELECT * FROM P QUALIFY table_seq = max(table_seq) OVER (PARTITION BY keyword)),
F AS (SELECT doc, key, json FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY table_seq, key NULLS FIRST, json NULLS FIRST) AS rn FROM summaries WHERE doc IS NOT NULL) WHERE rn = 1)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def numbered(sub: str) -> str:
    return f"(SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY seq, score) AS seq, score FROM {sub})"


def expression(e: Expr | str, union: bool = False) -> str:
    """A subquery (doc, seq, score) of an expression; ``union`` as in the index's ``multi_index``."""
    if isinstance(e, str):
        e = parse_expression(e)
    if isinstance(e, Leaf) and e.name.startswith("in-"):
        prefix, _, part = e.name[3:].partition(":")
        return f"(SELECT DISTINCT doc, 1 AS seq, CAST(0 AS FLOAT) AS score FROM P WHERE starts_with(keyword, {quoted(prefix)}) AND contains(lower(keyword), {quoted(part.lower())}))"
    if isinstance(e, Leaf):
        last = "" if union else f" AND table_seq = (SELECT max(table_seq) FROM P WHERE keyword = {quoted(e.name)})"
        return f"(SELECT doc, seq, score FROM P WHERE keyword = {quoted(e.name)}{last})"
    if isinstance(e, DocKey):
        return f"(SELECT doc, 1 AS seq, CAST(0 AS FLOAT) AS score FROM summaries WHERE key = {quoted(e.name)} AND doc IS NOT NULL ORDER BY table_seq, doc LIMIT 1)"
    if isinstance(e, Compare):
        return f"(SELECT * FROM {expression(e.arg, union)} WHERE NOT isnan(score) AND CAST(score AS DOUBLE) {e.op} {e.value!r})"
    if isinstance(e, InRange):
        return f"(SELECT * FROM {expression(e.arg, union)} WHERE NOT isnan(score) AND CAST(score AS DOUBLE) BETWEEN {e.low!r} AND {e.high!r})"
    if isinstance(e, Unary) and e.op == "~":
        return f"(SELECT doc, seq, -score AS score FROM {expression(e.arg, union)})"
    if isinstance(e, Unary):
        return folded(expression(e.arg, union), e.op.lower())
    if isinstance(e, Sample):
        raise ValueError("a sample is not SQL")
    a, b = expression(e.left, union), expression(e.right, union)
    if e.op == "AND":
        return f"(SELECT x.* FROM {a} x SEMI JOIN {b} y ON x.doc = y.doc)"
    if e.op == "SUBTRACT":
        return f"(SELECT x.* FROM {a} x ANTI JOIN {b} y ON x.doc = y.doc)"
    na, nb = numbered(a), numbered(b)
    if e.op == "OR":
        return f"(SELECT * FROM {nb} UNION ALL SELECT x.* FROM {na} x LEFT JOIN (SELECT doc, count(*) AS c FROM {b} GROUP BY 1) y ON x.doc = y.doc WHERE x.seq > coalesce(y.c, 0))"
    if e.op == "ORDER BY":
        return f"(SELECT x.doc, x.seq, CASE WHEN y.doc IS NULL THEN CAST('-inf' AS FLOAT) ELSE y.score END AS score FROM {na} x LEFT JOIN {nb} y ON x.doc = y.doc AND x.seq = y.seq)"
    assert isinstance(e, Binary) and e.op in "<>"
    return f"(SELECT x.* FROM {na} x JOIN {nb} y ON x.doc = y.doc AND x.seq = y.seq WHERE NOT isnan(x.score) AND NOT isnan(y.score) AND x.score {e.op} y.score)"


def folded(sub: str, pick: str) -> str:
    return f"(SELECT doc, 1 AS seq, coalesce({pick}(CASE WHEN NOT isnan(score) THEN score END), CAST('NaN' AS FLOAT)) AS score FROM {sub} GROUP BY doc)"


def body(column: str) -> str:
    inner = f"CASE WHEN starts_with({column}, '{{') THEN substr({column}, 2, greatest(length({column}) - 2, 0)) ELSE {column} END"
    return f"nullif({inner}, '')"


def ranked(e: str, limit: int = -1, offset: int = 0, union: bool = False) -> str:
    page = f"(SELECT doc, score FROM {folded(expression(e, union), 'max')} ORDER BY isnan(score), score DESC, doc"
    return page + (f" LIMIT {limit}" if limit >= 0 else "") + (f" OFFSET {offset}" if offset else "") + ")"


def cell(e: str, name: str, union: bool = False) -> str:
    """(doc, name) of a SELECT field."""
    sub = expression(e, union)
    return f"(SELECT doc, CASE WHEN (SELECT bool_or(isnan(score) OR score <> 0) FROM {sub}) THEN score ELSE CAST(1 AS FLOAT) END AS {name} FROM {folded(sub, 'min')})"


def correlated(a: str, b: str, timed: str = "false", ephemeral: str = "false", both: bool = False, now: float = 0, union: bool = False) -> str:
    """CORRELATE as one statement; ``timed`` and ``ephemeral`` are conditions on ``keyword``, used if A is timestamped."""
    event = "cls = 1" if not both else "cls IS NOT NULL"
    others = "" if both else f"\n UNION ALL SELECT table_seq, keyword, doc, CAST({now} AS FLOAT) - score, cls FROM J WHERE {timed} AND coalesce(cls, 0) <> 1"
    return f"""WITH {BASE},
A AS (SELECT doc, score AS event FROM {folded(expression(a, union), 'min')}),
B AS (SELECT doc, score AS event FROM {folded(expression(b, union), 'min')} WHERE doc NOT IN (SELECT doc FROM A)),
L AS (SELECT doc, 1 AS cls, event FROM A UNION ALL SELECT doc, -1, event FROM B),
lim AS (SELECT ln((na + 1.0) / (nb + 1.0)) AS prior, greatest(na // 20, 1) AS la, greatest(nb // 20, 1) AS lb FROM (SELECT (SELECT count(*) FROM A) AS na, (SELECT count(*) FROM B) AS nb) WHERE na > 0 AND nb > 0),
S AS (SELECT table_seq, keyword FROM P, lim WHERE NOT ({ephemeral}) GROUP BY table_seq, keyword, la, lb HAVING count(*) >= la OR count(*) >= lb),
J AS (SELECT p.*, l.cls, l.event FROM P p LEFT JOIN L l ON p.doc = l.doc WHERE NOT ({ephemeral})),
K AS (SELECT table_seq, keyword, doc, score, cls FROM J WHERE NOT ({timed})
 UNION ALL SELECT table_seq, keyword, doc, event - score, cls FROM (SELECT *, row_number() OVER (PARTITION BY table_seq, keyword, doc ORDER BY seq, score) AS nth FROM J WHERE {timed} AND {event}) WHERE nth = 1 AND NOT isnan(score) AND NOT isnan(event) AND score < event{others}),
C AS (SELECT table_seq, keyword, bool_or(isnan(score) OR score <> 0) AS cont FROM K GROUP BY 1, 2),
M AS (SELECT k.*, C.cont, lim.* FROM K k JOIN C USING (table_seq, keyword) JOIN S USING (table_seq, keyword) CROSS JOIN lim WHERE cls IS NOT NULL AND NOT isnan(score)),
OK AS (SELECT table_seq, keyword, any_value(cont) AS cont, any_value(prior) AS prior, any_value(la) AS la, any_value(lb) AS lb FROM M GROUP BY 1, 2 HAVING count(*) >= least(any_value(la), any_value(lb))),
V AS (SELECT table_seq, keyword, score, sum(CASE WHEN cls = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN cls = -1 THEN 1 ELSE 0 END) AS b FROM M JOIN OK USING (table_seq, keyword) WHERE OK.cont AND NOT isnan(score) GROUP BY 1, 2, 3),
R AS (SELECT *, sum(a) OVER w AS al, sum(b) OVER w AS bl, sum(a) OVER t AS aw, sum(b) OVER t AS bw, row_number() OVER w AS pos, count(*) OVER t AS cuts, lead(score) OVER (PARTITION BY table_seq, keyword ORDER BY score) AS nx FROM V JOIN OK USING (table_seq, keyword)
 WINDOW w AS (PARTITION BY table_seq, keyword ORDER BY score), t AS (PARTITION BY table_seq, keyword)),
G AS (SELECT *, greatest(CASE WHEN al >= la OR bl >= lb THEN abs(ln((al + 1.0) / (bl + 1.0)) - prior) ELSE 0 END, CASE WHEN aw - al >= la OR bw - bl >= lb THEN abs(ln((aw - al + 1.0) / (bw - bl + 1.0)) - prior) ELSE 0 END) AS gain FROM R),
T AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_seq, keyword ORDER BY round(gain, 12) DESC, pos) AS best FROM G) WHERE best = 1),
W AS (SELECT table_seq, keyword, CAST('-inf' AS FLOAT) AS low, CAST('inf' AS FLOAT) AS high FROM OK WHERE NOT cont
 UNION ALL SELECT table_seq, keyword, CAST('-inf' AS FLOAT), CASE WHEN pos > 1 AND pos < cuts AND gain >= ln(1.05) THEN score ELSE CAST('inf' AS FLOAT) END FROM T
 UNION ALL SELECT table_seq, keyword, nx, CAST('inf' AS FLOAT) FROM T WHERE pos > 1 AND pos < cuts AND gain >= ln(1.05)),
D AS (SELECT w.table_seq, w.keyword, low, high, count(DISTINCT CASE WHEN cls = 1 THEN doc END) AS n_a, count(DISTINCT CASE WHEN cls = -1 THEN doc END) AS n_b, any_value(prior) AS prior, any_value(la) AS la, any_value(lb) AS lb
 FROM W w JOIN M m ON w.table_seq = m.table_seq AND w.keyword = m.keyword AND NOT isnan(m.score) AND m.score BETWEEN low AND high GROUP BY 1, 2, 3, 4)
SELECT table_seq, keyword, CASE WHEN NOT isinf(low) THEN low END AS low, CASE WHEN NOT isinf(high) THEN high END AS high, n_a, n_b, round(ln((n_a + 1.0) / (n_b + 1.0)) - prior, 6) AS log_odds
FROM D WHERE (n_a >= la OR n_b >= lb) AND abs(ln((n_a + 1.0) / (n_b + 1.0)) - prior) >= ln(.55 / .45)"""
