"""The catalog file: which tables an index is made of."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TYPES = ("summary", "summary-override", "index")


class CatalogError(ValueError):
    """A line of a catalog file that can't be read."""


@dataclass(frozen=True)
class Entry:
    """One table; ``seq`` numbers the tables of its type from 0."""

    kind: str
    path: str
    base: int
    seq: int


@dataclass
class Catalog:
    """Entries in the order of the file."""

    entries: list[Entry] = field(default_factory=list)

    def of(self, kind: str) -> list[Entry]:
        return [e for e in self.entries if e.kind == kind]

    def summary_table_of(self, doc: int) -> Entry | None:
        """The last summary table whose base is at most ``doc``; the first if none is."""
        tables = self.of("summary")
        return next((e for e in reversed(tables) if e.base <= doc), tables[0] if tables else None)


def _integer(text: str, line: int) -> int:
    """Decimal, ``0x`` hex or, behind a leading zero, octal; the whole field must be read."""
    digits = text.lstrip("+-")
    try:
        value = int(digits, 8) if digits.startswith("0") and digits.isdigit() and len(digits) > 1 else int(digits, 0)
    except ValueError as e:
        raise CatalogError(f"line {line}: bad base offset {text!r}") from e
    return -value if text.startswith("-") else value


def parse_catalog(lines: Iterable[str]) -> Catalog:
    """Reads ``type<TAB>path[<TAB>base offset]`` lines; blank lines and ``#`` comments are skipped."""
    catalog, counts = Catalog(), dict.fromkeys(TYPES, 0)
    for number, raw in enumerate(lines, 1):
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        parts = line.split("\t")
        if len(parts) < 2:
            raise CatalogError(f"line {number}: no tab after the type")
        if parts[0] not in counts:
            raise CatalogError(f"line {number}: unknown type {parts[0]!r}")
        base = _integer(parts[2], number) if len(parts) > 2 else 0
        catalog.entries.append(Entry(parts[0], parts[1], base, counts[parts[0]]))
        counts[parts[0]] += 1
    return catalog


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Reads a catalog file from any file system Spark reads; it is a small text, a line a table."""
    rows = spark.read.text(path, wholetext=True).collect()
    return parse_catalog("".join(r[0] for r in rows).splitlines())


def catalog_lines(lines: DataFrame) -> DataFrame:
    """Entries of a catalog held as a table (line_no, line_type, path, base_offset): (kind, path, base, seq)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    known = lines.where(F.col("line_type").isin(*TYPES))
    # A catalog has a line a table, so one window a type holds it.
    order = Window.partitionBy("line_type").orderBy("line_no")
    return known.select(F.col("line_type").alias("kind"), "path", F.coalesce("base_offset", F.lit(0)).alias("base"), (F.row_number().over(order) - 1).alias("seq"))
