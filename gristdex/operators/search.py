"""QUERY: ranked retrieval, forward look-up and result objects."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristdex.model import Index
from gristdex.operators.evaluate import Evaluator
from gristdex.operators.thresholds import header_columns, parse_key, restrict
from gristdex.plans.nodes import QueryStatement
from gristdex.session import placed


@dataclass(frozen=True)
class Result:
    """``matches`` (doc, score) before paging, ``page`` (doc, score), ``rows`` with names and objects, in rank order."""

    matches: DataFrame
    page: DataFrame
    rows: DataFrame
    keys_only: bool

    def count(self) -> int:
        """Number of results before OFFSET and LIMIT."""
        return self.matches.count()

    def json_text(self, offset: int = 0) -> Iterator[str]:
        """The result object as text lines; ``[]`` where the offset is past the end.  Rows are fetched as they are printed."""
        total = self.count()
        if offset >= total:
            yield "[]"
            return
        rows = self.rows.toLocalIterator()
        if self.keys_only:
            for r in rows:
                yield r["key"] or ""
            return
        line = f'{{"result-count":{total},"result":['
        for i, r in enumerate(rows):
            if i:
                yield line + ","
                line = ""
            line += "{" + r["object"] + "}"
        yield line + "]}"


def body(json: Column) -> Column:
    """The inside of a JSON object text; null, empty and ``{}`` give null."""
    inner = F.when(json.startswith("{"), F.expr("substr(json, 2, length(json) - 2)")).otherwise(json)
    return F.when(F.length(inner) > 0, inner)


def json_quoted(column: Column) -> Column:
    """A string as JSON text; null stays null."""
    wrapped = F.to_json(F.struct(column.alias("k")))
    return F.when(column.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def tables_with(index: Index, keyword: str) -> list[int]:
    """Numbers of the tables that hold a keyword (at most as many as the catalog lists)."""
    rows = index.rows().where(F.col("keyword") == keyword).select("table_seq").distinct().collect()
    return sorted(r[0] for r in rows)


def override_bodies(index: Index, names: DataFrame | None = None) -> DataFrame:
    """(key, extra): the override texts of each key, up to the first override table that lacks it.  With ``names`` (``key``), of those only."""
    rows = index.overrides.where("key IS NOT NULL").select("table_seq", "key", "json")
    if names is not None:
        rows = rows.join(names.select("key"), "key", "left_semi")
    one = rows.groupBy("table_seq", "key").agg(F.min("json").alias("json")).select("table_seq", "key", body(F.col("json")).alias("body"))
    if index.override_tables is None:
        order = index.overrides.select("table_seq").distinct().select("table_seq", F.row_number().over(Window.orderBy("table_seq")).alias("nth"))
    else:
        order = index.spark.createDataFrame([(t, i + 1) for i, t in enumerate(index.override_tables)], "table_seq INT, nth INT")
    texts = F.array_sort(F.collect_list(F.struct("nth", "body")))
    # Tables without gaps have their own number as their place.
    unbroken = F.filter(texts, lambda x, i: x["nth"] == i + 1)
    found = one.join(F.broadcast(order), "table_seq").groupBy("key").agg(unbroken.alias("texts"))
    return found.select("key", F.array_join(F.filter(F.transform("texts", lambda x: x["body"]), lambda x: x.isNotNull()), ",").alias("extra"))


def matches(index: Index, statement: QueryStatement, evaluator: Evaluator) -> DataFrame:
    """(doc, score): one row a document (a row a posting with THRESHOLDS)."""
    found = evaluator.result(statement.expr, use_max=True).df.select("doc", "score")
    if statement.thresholds:
        keyword, _ = parse_key(statement.thresholds)
        found = restrict(index, found, statement.thresholds, tables_with(index, keyword))
    return found


def rank_order() -> list[Column]:
    """Best score first, NaN last, ties to the smaller document."""
    return [F.isnan("score").asc(), F.desc("score"), F.asc("doc")]


def query(index: Index, statement: QueryStatement, sizes: dict[str, int] | None = None) -> Result:
    """Runs a QUERY statement lazily.

    Ranked by score downwards (NaN last), then document upwards.  OFFSET and
    LIMIT come before the look-up of names, so summaries and overrides are joined
    to the page only.  OFFSET without LIMIT drops rows by their places in a range
    sort, so the rest never meets in one task.  Documents without a summary stay,
    with null key.
    """
    evaluator = Evaluator(index, sizes)
    found = matches(index, statement, evaluator)
    page = found
    if statement.limit >= 0:
        page = page.orderBy(*rank_order()).offset(statement.offset).limit(statement.limit) if statement.offset > 0 else page.orderBy(*rank_order()).limit(statement.limit)
    elif statement.offset > 0:
        page = placed(page, *rank_order()).where(F.col("place") >= statement.offset).drop("place")
    rows = page.join(index.forward(page if statement.limit >= 0 else None), "doc", "left")
    if statement.keys_only:
        return Result(found, page, rows.orderBy(*rank_order()).select("doc", "score", "key"), True)
    header = evaluator.headers[0] if evaluator.headers else None
    for more in evaluator.headers[1:]:
        header = header.unionByName(more)
    if statement.thresholds:
        dates = index.rules.is_timestamped(parse_key(statement.thresholds)[0])
        text, key = header_columns(statement.thresholds, dates, F.col("score"))
        rows = rows.withColumn("header", text).withColumn("header_key", key)
    elif header is not None:
        one = header.groupBy("doc").agg(F.min(F.struct("header_key", "header")).alias("h")).select("doc", F.col("h.header").alias("header"), F.col("h.header_key").alias("header_key"))
        rows = rows.join(one, "doc", "left")
    else:
        none = F.lit(None).cast("string")
        rows = rows.withColumn("header", none).withColumn("header_key", none)
    rows = rows.join(override_bodies(index, rows if statement.limit >= 0 else None), "key", "left") if index.overrides is not None else rows.withColumn("extra", F.lit(None).cast("string"))
    parts = F.concat_ws(
        ",",
        F.concat(F.lit('"_key":'), json_quoted(F.coalesce("key", F.lit("")))),
        body(F.col("json")),
        F.when(F.col("extra") != "", F.col("extra")),
        F.concat(F.lit('"_header":'), json_quoted(F.col("header"))),
        F.concat(F.lit('"_header_key":"'), "header_key", F.lit('"')),
    )
    return Result(found, page, rows.orderBy(*rank_order()).select("doc", "score", "key", "json", "header", "header_key", parts.alias("object")), False)
