import pytest
from pyspark.sql import functions as F

from gristdex.functions.keywords import KeywordRules
from gristdex.functions.text import date_text, decode_uri, escape_tsv, escape_tsv_column, general, json_string, minute_text, short_float, short_float32, spark_pattern, unescape_tsv, unescape_tsv_column, valid_host
from gristdex.sources.catalog import CatalogError, parse_catalog
from gristdex.sources.export import error_line, output_double, output_float, output_integer, output_string

HARD = ["", "plain", "a\tb", "line\nbreak\r", "back\\slash", "\\t not a tab", "\\\\n", "\\", "ü\t漢\\\n", "nul\x00\\\x00", "\\\\\\t"]


def test_escapes(spark):
    for text in HARD:
        assert unescape_tsv(escape_tsv(text)) == text
    df = spark.createDataFrame([(t,) for t in [*HARD, None]], "t STRING").select("t", escape_tsv_column(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape_tsv_column(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and (r["t"] is None or r["e"] == escape_tsv(r["t"]))


def test_decode_uri():
    assert decode_uri("a%20b+c") == "a b+c" and decode_uri("%C3%BC") == "ü"
    assert decode_uri("x%2") == decode_uri("x%") == "x" and decode_uri("%zz") == "%zz"


def test_numbers():
    assert [short_float(x) for x in (0.0, 1.5, 0.1, -3.0, 1e-9)] == ["0", "1.5", "0.1", "-3", "1.0000000000000001e-09"]
    assert short_float32(0.1) == "0.1" and short_float32(1.0000001192092896) == "1.0000001" and short_float32(1e12) == "1e+12"
    assert [general(x) for x in (1.5, float("nan"), float("-inf"), 123456789012.0)] == ["1.5", "nan", "-inf", "1.23456789e+11"]
    assert (output_float(0.5), output_double(0.1), output_integer(2**64 - 1), output_string('a"')) == ("0.5", "0.10000000000000001", str(2**64 - 1), '"a\\""')
    with pytest.raises(ValueError):
        output_integer(-1)


def test_dates(spark):
    assert date_text(0) == "January 1, 1970" and minute_text(19000.5) == "2022-01-08 12:00"
    assert spark_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError):
        spark_pattern("%Q")
    assert json_string('a"\n') == '"a\\"\\n"' and error_line(ValueError('x"')) == '{"error": "x\\""}'


def test_hosts(spark):
    rows = spark.createDataFrame([("a.b",), ("ab",), (".ab",), ("ab.",), (None,)], "h STRING").select("h", valid_host(F.col("h")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False, False, None]


def test_keyword_rules(spark):
    rules = KeywordRules.parse("# note\nephemeral:\n  - tmp:\n  - \"/q[01]/\"\ntimestamped: [event:, 'x']\n")
    assert rules == KeywordRules(("tmp:", "/q[01]/"), ("event:", "x"))
    words = ["tmp:a", "q1", "q12", "event:", "xy", "", "qq", "q1\n"]
    rows = spark.createDataFrame([(w,) for w in words], "w STRING").select("w", rules.ephemeral_column(F.col("w")).alias("e"), rules.timestamped_column(F.col("w")).alias("t")).collect()
    for r in rows:
        assert (r["e"], r["t"]) == (rules.is_ephemeral(r["w"]), rules.is_timestamped(r["w"]))
    assert [rules.is_ephemeral(w) for w in words] == [True, True, False, False, False, False, False, False]
    assert KeywordRules.parse("") == KeywordRules()


def test_catalog():
    c = parse_catalog(["# tables", "", "summary\t/a", "summary\t/b\t0x10  ", "index\t/i", "summary-override\t/o", "index\t/j"])
    assert [(e.kind, e.path, e.base, e.seq) for e in c.entries] == [("summary", "/a", 0, 0), ("summary", "/b", 16, 1), ("index", "/i", 0, 0), ("summary-override", "/o", 0, 0), ("index", "/j", 0, 1)]
    assert c.summary_table_of(15).path == "/a" and c.summary_table_of(16).path == "/b"
    for bad in ("summary /a", "other\t/a", "summary\t/a\t12x", "summary\t/a\t"):
        if bad.endswith("\t"):
            assert parse_catalog([bad]).entries[0].base == 0
            continue
        with pytest.raises(CatalogError):
            parse_catalog([bad])
