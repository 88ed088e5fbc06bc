"""The engine: runs scripts and single statements over an index."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristdex.model import Bag, Index
from gristdex.operators import correlate as _correlate
from gristdex.operators import matrix, search
from gristdex.operators.evaluate import Evaluator
from gristdex.plans.nodes import CorrelateStatement, Expr, ParseStatement, QueryStatement, SelectStatement, SetStatement, Statement
from gristdex.plans.parser import Parser, parse_script
from gristdex.sources import export


class Engine:
    """Statements over one index.  Session options set by SET stay with the engine."""

    def __init__(self, index: Index, now: float | None = None):
        self.index, self.now = index, now
        self.options = {"OUTPUT FORMAT": "JSON", "TIME FORMAT": "%Y-%m-%dT%H:%M:%S"}
        self.sizes: dict[str, int] | None = None

    def use_sizes(self, keywords: list[str]) -> None:
        """Counts the postings of some keywords, so that intersections start with the smallest."""
        rows = self.index.rows().where(F.col("keyword").isin(keywords)).groupBy("keyword").count().collect()
        self.sizes = (self.sizes or {}) | dict.fromkeys(keywords, 0) | {r["keyword"]: r["count"] for r in rows}

    def evaluate(self, expr: Expr | str) -> Bag:
        """The bag of an expression, before any folding of a document's postings."""
        return Evaluator(self.index, self.sizes).evaluate(expr)

    def _statement(self, statement: Statement | str, kind: type) -> Statement:
        if isinstance(statement, str):
            (statement,) = parse_script(statement.rstrip().rstrip(";") + ";")
        if not isinstance(statement, kind):
            raise TypeError(f"not a {kind.__name__}: {statement!r}")
        return statement

    def query(self, statement: QueryStatement | str) -> search.Result:
        return search.query(self.index, self._statement(statement, QueryStatement), self.sizes)

    def select(self, statement: SelectStatement | str) -> DataFrame:
        return matrix.select(self.index, self._statement(statement, SelectStatement), self.sizes)

    def correlate(self, statement: CorrelateStatement | str) -> DataFrame:
        return _correlate.correlate(self.index, self._statement(statement, CorrelateStatement), self.now if self.now is not None else time.time() / 86400)

    def parse(self, text: str) -> str:
        """The normalised text of an expression."""
        (statement,) = parse_script(f"PARSE {text};")
        return str(statement.expr)

    def lines(self, statement: Statement) -> Iterator[str]:
        """The printed result of one statement."""
        if isinstance(statement, QueryStatement):
            yield from self.query(statement).json_text(statement.offset)
        elif isinstance(statement, SelectStatement):
            names = list(statement.names) or [f"f{i + 1}" for i in range(len(statement.fields))]
            yield from export.matrix_lines(self.select(statement).orderBy("doc").toLocalIterator(), names, statement.with_summaries)
        elif isinstance(statement, CorrelateStatement):
            yield from export.correlate_lines(self.correlate(statement).orderBy(F.desc("log_odds"), "keyword", "low").toLocalIterator(), self.index.rules.is_timestamped)
        elif isinstance(statement, ParseStatement):
            yield str(statement.expr)
        elif isinstance(statement, SetStatement):
            if statement.what == "TIME FORMAT" and len(statement.value) >= 64:
                raise ValueError("time format too long")
            self.options[statement.what] = statement.value

    def run(self, script: str) -> Iterator[str]:
        """Runs a script statement by statement; one that fails prints an error object, a syntax error ends it."""
        try:
            for statement in Parser(script).statements():
                try:
                    yield from self.lines(statement)
                except Exception as e:  # noqa: BLE001 - every failure of a statement is its output
                    yield export.error_line(e)
        except ValueError as e:
            yield export.error_line(e)
