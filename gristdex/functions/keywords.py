"""Keyword metadata: which keywords are ephemeral or timestamped."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _matches(rules: tuple[str, ...], keyword: str) -> bool:
    return any(re.fullmatch(r[1:-1], keyword) is not None if _is_regex(r) else keyword.startswith(r) for r in rules)


def _is_regex(rule: str) -> bool:
    return len(rule) > 1 and rule[0] == rule[-1] == "/"


def _column(rules: tuple[str, ...], keyword: Column) -> Column:
    tests = [keyword.rlike(rf"\A(?:{r[1:-1]})\z") if _is_regex(r) else keyword.startswith(r) for r in rules]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass(frozen=True)
class KeywordRules:
    """Rules are prefixes, or ``/regex/`` matching the whole keyword.  No rules: an empty configuration."""

    ephemeral: tuple[str, ...] = field(default=())
    timestamped: tuple[str, ...] = field(default=())

    def is_ephemeral(self, keyword: str) -> bool:
        return _matches(self.ephemeral, keyword)

    def is_timestamped(self, keyword: str) -> bool:
        return _matches(self.timestamped, keyword)

    def ephemeral_column(self, keyword: Column) -> Column:
        return _column(self.ephemeral, keyword)

    def timestamped_column(self, keyword: Column) -> Column:
        return _column(self.timestamped, keyword)

    @classmethod
    def parse(cls, text: str) -> KeywordRules:
        """Reads the two lists of a YAML file, in block (``- x``) or flow (``[x, y]``) form."""
        lists: dict[str, list[str]] = {"ephemeral": [], "timestamped": []}
        current = None
        clean = lambda s: s.strip().strip("\"'")
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if m := re.match(r"(\w+):\s*(.*)$", line):
                current = m[1]
                if m[2].startswith("[") and current in lists:
                    lists[current] += [clean(x) for x in m[2].strip("[] ").split(",") if clean(x)]
            elif (m := re.match(r"\s*-\s+(.*)$", line)) and current in lists:
                lists[current].append(clean(m[1]))
        return cls(tuple(lists["ephemeral"]), tuple(lists["timestamped"]))
