"""Compiles expressions to lazy bags."""

from __future__ import annotations

from gristdex.model import Bag, Index
from gristdex.operators import bags, leaves
from gristdex.plans.nodes import Binary, Compare, DocKey, Expr, InRange, Leaf, Sample, Unary
from gristdex.plans.parser import parse_expression
from gristdex.plans.rewrite import rewrite

_BINARY = {"OR": bags.union, "AND": bags.intersect, "SUBTRACT": bags.subtract, "ORDER BY": bags.order_by, ">": bags.join_greater, "<": bags.join_less}


class Evaluator:
    """Compiles the expressions of one statement; a leaf met twice is built once, so its exchange is shared."""

    def __init__(self, index: Index, sizes: dict[str, int] | None = None):
        self.index, self.sizes, self.known = index, sizes, {}
        self.headers: list = []

    def evaluate(self, expr: Expr | str) -> Bag:
        """The bag of an expression."""
        tree = parse_expression(expr) if isinstance(expr, str) else expr
        return self._bag(rewrite(tree, self.sizes))

    def _bag(self, e: Expr) -> Bag:
        if isinstance(e, (Leaf, DocKey)):
            if e not in self.known:
                self.known[e] = leaves.leaf(self.index, e.name) if isinstance(e, Leaf) else leaves.document_leaf(self.index, e.name)
                if self.known[e].headers is not None:
                    self.headers.append(self.known[e].headers)
            return self.known[e]
        if isinstance(e, Binary):
            return _BINARY[e.op](self._bag(e.left), self._bag(e.right))
        if isinstance(e, Compare):
            return bags.compare(self._bag(e.arg), e.op, e.value)
        if isinstance(e, InRange):
            return bags.in_range(self._bag(e.arg), e.low, e.high)
        if isinstance(e, Sample):
            return bags.sample(self._bag(e.arg), e.size)
        if isinstance(e, Unary):
            return {"MAX": bags.maximum, "MIN": bags.minimum, "~": bags.negate}[e.op](self._bag(e.arg))
        raise TypeError(f"no expression: {e!r}")

    def result(self, expr: Expr | str, use_max: bool) -> Bag:
        """The bag with one posting a document: its highest score (ranked search) or lowest (features, mining)."""
        bag = self.evaluate(expr)
        return bags.maximum(bag) if use_max else bags.minimum(bag)
