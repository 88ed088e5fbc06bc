"""Text helpers: escapes, percent decoding, JSON strings, number and date formats."""

from __future__ import annotations

import math
import re
import struct
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escape_tsv(text: str) -> str:
    """Backslash escapes for backslash, newline, return and tab."""
    return "".join(_ESCAPES.get(c, c) for c in text)


def unescape_tsv(text: str) -> str:
    """Undoes :func:`escape_tsv`; a backslash before another character vanishes."""
    return re.sub(r"\\(.?)", lambda m: {"t": "\t", "n": "\n", "r": "\r"}.get(m[1], m[1]), text, flags=re.S)


def escape_tsv_column(column: Column) -> Column:
    """:func:`escape_tsv` as a column expression."""
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        column = F.replace(column, F.lit(raw), F.lit(escaped))
    return column


def unescape_tsv_column(column: Column) -> Column:
    """:func:`unescape_tsv` as a column expression: doubled backslashes cut the text, all others lead an escape."""

    def part(text: Column) -> Column:
        for escaped, raw in (("\\t", "\t"), ("\\r", "\r"), ("\\n", "\n"), ("\\", "")):
            text = F.replace(text, F.lit(escaped), F.lit(raw))
        return text

    return F.array_join(F.transform(F.split(column, r"\\\\"), part), "\\")


def decode_uri(text: str) -> str:
    """Decodes ``%XX``; a plus stays, a cut-off escape at the end is dropped, other bad escapes stay."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), re.sub(rb"%[0-9A-Fa-f]?$", b"", text.encode()))
    return raw.decode("utf-8", "replace")


def json_string(text: str) -> str:
    """A JSON string literal, other than ASCII left as it is."""
    import json

    return json.dumps(text, ensure_ascii=False)


def general(value: float, digits: int = 9) -> str:
    """C's ``%.{digits}g``."""
    return f"{value:.{digits}g}"


def _shortest(value: float, digits: int, high: float, same) -> str:
    if value == 0:
        return "0"
    if math.isfinite(value) and 1e-6 <= abs(value) < high:
        for places in range(digits):
            text = f"{value:.{places}f}"
            if same(float(text)):
                return text
    return general(value, digits)


def short_float(value: float) -> str:
    """Shortest fixed-point text that reads back as the same double."""
    return _shortest(float(value), 17, 1e17, lambda x: x == value)


def short_float32(value: float) -> str:
    """The same for a 32-bit float."""
    single = lambda x: struct.pack("f", x)
    return _shortest(float(value), 9, 1e9, lambda x: abs(x) < 3e38 and single(x) == single(value))


def _moment(days: float) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(days * 86400))


def date_text(days: float) -> str:
    """Days since 1970-01-01 as ``March 5, 2021``."""
    t = _moment(days)
    return f"{t:%B} {t.day}, {t.year}"


def minute_text(days: float) -> str:
    """Days since 1970-01-01 as ``2021-03-05 17:30``."""
    return f"{_moment(days):%Y-%m-%d %H:%M}"


# Strftime directives and their pattern letters in Spark.
PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "e": "d", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "I": "hh", "p": "a", "A": "EEEE", "a": "EEE", "Z": "zzz", "z": "xx", "%": "%"}


def spark_pattern(c_format: str) -> str:
    """A strftime format as Spark's datetime pattern; unknown directives raise."""
    out, i = [], 0
    while i < len(c_format):
        c = c_format[i]
        if c == "%":
            i += 1
            if i >= len(c_format) or c_format[i] not in PATTERNS:
                raise ValueError(f"unsupported time format {c_format!r}")
            out.append(PATTERNS[c_format[i]])
        elif c.isalpha():
            out.append(f"'{c}'")
        else:
            out.append("''" if c == "'" else c)
        i += 1
    return "".join(out).replace("''''", "''")


def valid_host(column: Column) -> Column:
    """Whether a name may be a host: three characters or more, no dot at either end."""
    return (F.length(column) >= 3) & ~column.startswith(".") & ~column.endswith(".")
