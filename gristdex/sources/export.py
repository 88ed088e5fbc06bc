"""Exports of index tables and results, as rows and as text lines."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristdex.functions.text import general, json_string, minute_text, short_float32, spark_pattern
from gristdex.model import PERCENTILES, Index, scored
from gristdex.sources.load import key_filter


def scoped(df: DataFrame, key: str, pattern: str | None = None, start: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows by key: full match of a regex, keys from ``start`` on, or keys with a prefix."""
    if pattern is not None:
        df = key_filter(df, pattern, key)
    if start is not None:
        df = df.where(F.col(key) >= start)
    return df.where(F.col(key).startswith(prefix)) if prefix is not None else df


def raw_postings(index: Index) -> DataFrame:
    """(keyword, doc, score) of every posting."""
    return index.rows().select("keyword", "doc", "score")


def resolved_postings(index: Index) -> DataFrame:
    """(keyword, key, json, score): postings with the name and summary of their document; those without one drop out."""
    return index.rows().select("keyword", "doc", "score").join(index.forward(), "doc").select("keyword", "key", "json", "score")


def summaries(index: Index) -> DataFrame:
    """(key, json) of every summary row."""
    return index.summaries.select("key", "json")


def time_series(df: DataFrame, date_format: str = "%Y-%m-%d %H:%M:%S") -> DataFrame:
    """(key, date, value): dates in a strftime format (``%s``: seconds), ``score`` (a missing one is NaN) and percentiles, null where there are none."""
    date = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string") if date_format == "%s" else F.date_format("ts", spark_pattern(date_format))
    return df.where("key IS NOT NULL").select("key", date.alias("date"), scored(F.col("score")), *PERCENTILES)


def series_counts(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, n) of every key."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def keys(df: DataFrame, key: str = "keyword") -> DataFrame:
    """The distinct keys."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()


# Text lines; rows are fetched as they are printed.


def posting_lines(rows: Iterable) -> Iterator[str]:
    """A keyword line, then a tab-indented ``doc score`` line a posting; ``rows`` sorted by keyword."""
    last: str | None = None
    for r in rows:
        if r["keyword"] != last:
            last = r["keyword"]
            yield last
        yield f"\t{r['doc']} {general(r['score'], 6)}"


def resolved_lines(rows: Iterable) -> Iterator[str]:
    for r in rows:
        yield f"{r['key']}\t{r['json'] or ''}\t{general(r['score'])}"


def series_lines(rows: Iterable) -> Iterator[str]:
    for r in rows:
        tail = "".join(f" {general(r[c])}" for c in PERCENTILES) if r["pct5"] is not None and r["pct5"] == r["pct5"] else ""
        yield f"{r['key']}\t{r['date']}\t{general(r['score'])}{tail}"


def matrix_lines(rows: Iterable, names: list[str], with_summaries: bool) -> Iterator[str]:
    """Comma-separated: name, cells, and the quoted summary."""
    for r in rows:
        cells = [r["key"] or "", *(general(r[n]) for n in names)]
        if with_summaries:
            cells.append('"' + (r["json"] or "").replace('"', '""') + '"')
        yield ",".join(cells)


def range_label(low: float | None, high: float | None, timestamped: bool = False, days_before: bool = False) -> str:
    """``[a,b]``, ``≥a`` or ``≤b``; dates for timestamped keywords, or ``N days ago``."""

    def text(v: float) -> str:
        if not timestamped:
            return short_float32(v)
        return f"{short_float32(v)} days ago" if days_before else minute_text(v)

    if low is not None and high is not None:
        return f"[{text(low)},{text(high)}]"
    return f"≥{text(low)}" if low is not None else f"≤{text(high)}" if high is not None else ""


def correlate_lines(rows: Iterable, timestamped) -> Iterator[str]:
    """``log odds, A, B, keyword[range]`` with tabs; ``timestamped`` tells by keyword."""
    for r in rows:
        label = range_label(r["low"], r["high"], timestamped(r["keyword"]), r["days_before"])
        yield f"{r['log_odds']:.3f}\t{r['n_a']}\t{r['n_b']}\t{r['keyword']}{label}"


def error_line(error: Exception) -> str:
    return json.dumps({"error": str(error)}, ensure_ascii=False)


def output_float(value: float) -> str:
    """A 32-bit float as text."""
    return general(value, 9)


def output_double(value: float) -> str:
    return general(value, 17)


def output_integer(value: int) -> str:
    """An unsigned 64-bit integer as text."""
    if not 0 <= value < 1 << 64:
        raise ValueError("not an unsigned 64-bit integer")
    return str(value)


def output_string(value: str) -> str:
    return json_string(value)
