"""THRESHOLDS: filter by a keyword's score and bucket the results."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristdex.functions.text import date_text, decode_uri, short_float
from gristdex.model import Index, real
from gristdex.operators.leaves import postings_of
from gristdex.plans.nodes import Thresholds


def parse_key(spec: Thresholds) -> tuple[str, bool]:
    """(keyword, whether header keys run backwards)."""
    backwards = spec.key.startswith("~")
    return decode_uri(spec.key[1:] if backwards else spec.key), backwards


def restrict(index: Index, result: DataFrame, spec: Thresholds, tables: list[int]) -> DataFrame:
    """(doc, score): a row for each posting of the keyword with lowest <= score < highest threshold.

    The tables that hold the keyword filter one after the other.  A keyword that
    no table holds, or a single threshold, gives no row.
    """
    keyword, _ = parse_key(spec)
    low, high = min(spec.values), max(spec.values)
    rows = postings_of(index, keyword).where(real(F.col("score"))).where((F.col("score").cast("double") >= low) & (F.col("score").cast("double") < high))
    out = result.select("doc", "score")
    for t in sorted(tables):
        out = rows.where(F.col("table_seq") == t).select("doc", "score").join(out.select("doc"), "doc")
    return out if tables else out.where(F.lit(False))


def bucket_table(spec: Thresholds, dates: bool) -> list[tuple[float, float, str, str]]:
    """(from, to, header, header key) of each bucket ``[from, to)``."""
    _, backwards = parse_key(spec)
    edges, out = sorted(spec.values), []
    for i in range(1, len(edges)):
        low, high = edges[i - 1], edges[i]
        if not dates:
            header = f"{short_float(low)}–{short_float(high)}"
        elif low + 1 == high:
            header = date_text(low)
        else:
            header = f"{date_text(low)}–{date_text(high)}"
        at = len(edges) - i if backwards else i
        letters = "".join(chr(65 + at // 26**p % 26) for p in range(4, -1, -1))
        out.append((low, high, header, letters))
    return out


def bucket_of(edges: list[float], score: float) -> int:
    """Index of the upper edge of a score's bucket."""
    i = bisect_left(edges, score, 1)
    return i + 1 if edges[i] == score and i + 1 < len(edges) else i


def header_columns(spec: Thresholds, dates: bool, score: Column) -> tuple[Column, Column]:
    """(header, header key) by literal buckets."""
    s = score.cast("double")
    header: Column = F.lit(None).cast("string")
    key: Column = F.lit(None).cast("string")
    for low, high, text, letters in reversed(bucket_table(spec, dates)):
        inside = (s >= low) & (s < high)
        header, key = F.when(inside, text).otherwise(header), F.when(inside, letters).otherwise(key)
    return header, key
