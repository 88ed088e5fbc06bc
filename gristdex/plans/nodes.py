"""Syntax tree of the query language: expressions and statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from gristdex.functions.text import general


class Expr:
    """An expression; ``str()`` is its normalised text."""


@dataclass(frozen=True)
class Leaf(Expr):
    """The postings of a keyword (or of the keywords a ``FIELD-in:`` or ``in-PREFIX:`` form stands for)."""

    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class DocKey(Expr):
    """The document of one name."""

    name: str

    def __str__(self) -> str:
        return f"KEY={self.name}"


@dataclass(frozen=True)
class Unary(Expr):
    """``op`` is MAX, MIN or ~."""

    op: str
    arg: Expr

    def __str__(self) -> str:
        return f"{self.op}({self.arg})"


@dataclass(frozen=True)
class Sample(Expr):
    arg: Expr
    size: int

    def __str__(self) -> str:
        return f"RANDOM_SAMPLE({self.arg}, {self.size})"


@dataclass(frozen=True)
class Binary(Expr):
    """``op`` is OR, AND, SUBTRACT, ORDER BY, > or <."""

    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        sign = {"OR": " + ", "AND": " AND ", "SUBTRACT": " - ", "ORDER BY": " ORDER BY "}.get(self.op, self.op)
        return f"({self.left}{sign}{self.right})"


@dataclass(frozen=True)
class Compare(Expr):
    """Score against a number; ``op`` is =, >, >=, < or <=."""

    op: str
    arg: Expr
    value: float

    def __str__(self) -> str:
        return f"({self.arg}{self.op}{general(self.value)})"


@dataclass(frozen=True)
class InRange(Expr):
    arg: Expr
    low: float
    high: float

    def __str__(self) -> str:
        return f"({self.arg}[{general(self.low)},{general(self.high)}])"


@dataclass(frozen=True)
class Thresholds:
    values: tuple[float, ...]
    key: str


@dataclass(frozen=True)
class QueryStatement:
    expr: Expr
    keys_only: bool = False
    thresholds: Thresholds | None = None
    limit: int = -1
    offset: int = 0


@dataclass(frozen=True)
class SelectStatement:
    fields: tuple[Expr, ...]
    rows: Expr
    with_summaries: bool = False
    parallel: int | None = None
    names: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class CorrelateStatement:
    a: Expr
    b: Expr


@dataclass(frozen=True)
class ParseStatement:
    expr: Expr


@dataclass(frozen=True)
class SetStatement:
    """``what`` is OUTPUT FORMAT or TIME FORMAT."""

    what: str
    value: str


Statement = QueryStatement | SelectStatement | CorrelateStatement | ParseStatement | SetStatement


def primary_keyword(expr: Expr) -> str:
    """The leftmost keyword of an expression; empty if that is a document name."""
    while not isinstance(expr, (Leaf, DocKey)):
        expr = expr.left if isinstance(expr, Binary) else expr.arg
    return expr.name if isinstance(expr, Leaf) else ""
