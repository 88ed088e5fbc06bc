"""SELECT: a feature matrix, one row a selected document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristdex.functions.text import decode_uri
from gristdex.model import Index, real
from gristdex.operators.evaluate import Evaluator
from gristdex.plans.nodes import Expr, Leaf, SelectStatement

_NAN = float("nan")


def _plain_keyword(e: Expr) -> bool:
    if not isinstance(e, Leaf):
        return False
    colon = e.name.find(":")
    return not e.name.startswith("in-") and not (colon > 3 and e.name[colon - 3 : colon] == "-in")


def _nonzero() -> Column:
    return F.max(F.isnan("score") | (F.col("score") != 0))


def _cell(has: Column, cont: Column, score: Column) -> Column:
    """NaN where the document is absent, 1 where every score of the field is 0, else the lowest score."""
    return F.when(~has, F.lit(_NAN)).when(~cont, F.lit(1.0)).otherwise(F.coalesce(score, F.lit(_NAN))).cast("float")


def keyword_fields(index: Index, rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Cells of plain keywords ``{column: keyword}`` by one scan and one conditional aggregation."""
    wanted = sorted({decode_uri(k) for k in names.values()})
    hits = index.rows().where(F.col("keyword").isin(wanted)).select("table_seq", "keyword", "doc", "score")
    stats = hits.groupBy("keyword", "table_seq").agg(_nonzero().alias("cont"))
    if index.multi_index == "last":
        stats = stats.groupBy("keyword").agg(F.max(F.struct("table_seq", "cont")).alias("s")).select("keyword", "s.table_seq", "s.cont")
        hits = hits.join(F.broadcast(stats), ["keyword", "table_seq"])  # one row a named keyword
    else:
        stats = stats.groupBy("keyword").agg(F.max("cont").alias("cont"))
        hits = hits.join(F.broadcast(stats), "keyword")
    number = F.when(real(F.col("score")), F.col("score"))
    aggregates = []
    for i, keyword in enumerate(wanted):
        here = F.col("keyword") == keyword
        aggregates += [F.max(here).alias(f"has_{i}"), F.max(F.when(here, F.col("cont"))).alias(f"cont_{i}"), F.min(F.when(here, number)).alias(f"min_{i}")]
    folded = hits.join(rows.select("doc"), "doc", "left_semi").groupBy("doc").agg(*aggregates)
    place = {k: i for i, k in enumerate(wanted)}
    cells = [_cell(F.coalesce(F.col(f"has_{(i := place[decode_uri(k)])}"), F.lit(False)), F.coalesce(F.col(f"cont_{i}"), F.lit(False)), F.col(f"min_{i}")).alias(c) for c, k in names.items()]
    return rows.select("doc").join(folded, "doc", "left").select("doc", *cells)


def select(index: Index, statement: SelectStatement, sizes: dict[str, int] | None = None) -> DataFrame:
    """Runs a SELECT statement lazily: ``doc``, ``key``, a FLOAT column a field (``f1``, ``f2``, ... or the names given) and, WITH SUMMARIES, ``json``.

    Rows are the documents of FROM; each field is evaluated over the whole index.
    Plain keywords share one scan; other fields take a left join each.
    """
    evaluator = Evaluator(index, sizes)
    rows = evaluator.result(statement.rows, use_max=False).df.select("doc")
    names = statement.names or tuple(f"f{i + 1}" for i in range(len(statement.fields)))
    simple = {n: f.name for n, f in zip(names, statement.fields) if _plain_keyword(f)}
    out = keyword_fields(index, rows, simple) if simple else rows
    for name, expr in zip(names, statement.fields):
        if name in simple:
            continue
        bag = evaluator.result(expr, use_max=False).df.select("doc", "score")
        cont = bag.agg(F.coalesce(_nonzero(), F.lit(False)).alias("cont")).scalar()
        cells = bag.join(rows, "doc", "left_semi").select("doc", F.col("score").alias("cell"), F.lit(True).alias("has")).withColumn("cont", cont)
        out = out.join(cells, "doc", "left").withColumn(name, _cell(F.coalesce("has", F.lit(False)), F.coalesce("cont", F.lit(False)), F.col("cell"))).drop("cell", "has", "cont")
    named = out.join(index.forward(), "doc", "left")
    return named.select("doc", "key", *names, *(["json"] if statement.with_summaries else []))
