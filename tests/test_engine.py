"""Leaves, ranked search, thresholds, feature matrices and mining over a small index."""

import json
import math

import pytest

from gristdex.engine import Engine
from gristdex.functions.keywords import KeywordRules
from gristdex.model import Index
from gristdex.operators.thresholds import bucket_of, bucket_table
from gristdex.plans.nodes import Thresholds

P = "table_seq INT, keyword STRING, doc BIGINT, seq INT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT, extra STRING"
NAN = math.nan
POSTINGS = [
    (0, "red", 1, 1, 0.0), (0, "red", 2, 1, 0.0), (0, "red", 2, 1, 0.0), (0, "red", 3, 1, 0.0),
    (0, "size", 1, 1, 5.0), (0, "size", 1, 2, 9.0), (0, "size", 2, 1, 7.5), (0, "size", 3, 1, NAN), (0, "size", 4, 1, None),
    (0, "both", 1, 1, 1.0), (0, "both", 2, 1, 2.0), (1, "both", 3, 1, 30.0), (1, "both", 2, 1, 20.0),
    (0, "name:Host-A.example", 1, 1, 0.0), (0, "name:host-a.example", 2, 1, 0.0), (1, "name:b.example", 3, 1, 0.0),
    (0, "", 4, 1, 0.0), (0, None, 1, 1, 3.0), (0, "red", None, 1, 3.0), (0, "a b/ü", 4, 1, 2.0),
    (0, "event:x", 1, 1, 19000.25), (0, "event:x", 2, 1, 19001.0), (0, "event:x", 3, 1, 19002.5),
]
SUMMARIES = [(0, 0, 1, "one", '{"t":1}'), (0, 0, 2, "two", '{"t":"a \\"b\\""}'), (1, 3, 3, "three", '"t":3'), (1, 3, 4, "one", None), (1, 3, 1, "one", '{"late":1}')]
OVERRIDES = [(0, "one", '{"o":0}'), (1, "one", '{"o":1}'), (1, "two", '{"o":1}'), (0, "three", ""), (0, None, "{}")]
OBJECTS = [("list", "{Group One} host-a.example www.b.example; {Group 2} host-a.example {bad!} x.y")]


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(*p, None, None, None, None, "x") for p in POSTINGS]
    return Engine(
        Index(
            spark.createDataFrame(rows, P),
            spark.createDataFrame(SUMMARIES, "table_seq INT, base BIGINT, doc BIGINT, key STRING, json STRING"),
            spark.createDataFrame(OVERRIDES, "table_seq INT, key STRING, json STRING"),
            spark.createDataFrame(OBJECTS, "key STRING, data STRING"),
            KeywordRules(("tmp",), ("event:",)),
        ),
        now=19010.0,
    )


def docs(engine, text):
    return sorted((r["doc"], r["score"]) for r in engine.evaluate(text).df.collect())


def test_leaves(engine):
    assert docs(engine, "red") == [(1, 0), (2, 0), (2, 0), (3, 0)]
    assert docs(engine, "both") == [(2, 20), (3, 30)]  # the last table that has it
    assert docs(engine, "a%20b/%C3%BC") == [(4, 2)]
    assert docs(engine, '""') == [(4, 0)]
    assert docs(engine, "KEY=one") == [(1, 0)]  # the first table that has it
    assert docs(engine, "KEY=none") == docs(engine, "nothing") == docs(engine, "in-none") == []
    assert docs(engine, "in-name:HOST") == [(1, 0), (2, 0)]
    assert docs(engine, "name-in:list") == docs(engine, "links-in:list") == [(2, 0), (3, 0)]
    assert docs(engine, "name-in:gone") == []


def test_union_of_tables(engine):
    from dataclasses import replace

    both = Engine(replace(engine.index, multi_index="union"))
    assert docs(both, "both") == [(1, 1), (2, 2), (2, 20), (3, 30)]


def test_ranked_search(engine):
    out = json.loads("".join(engine.run("QUERY (size + red) LIMIT 3;")))
    assert out["result-count"] == 4
    assert [r["_key"] for r in out["result"]] == ["one", "two", "three"]
    assert out["result"][0]["t"] == 1 and out["result"][0]["o"] == 1  # later text wins
    assert "o" not in out["result"][1]  # the chain stops at the first table without the key
    assert list(engine.run("QUERY (red) OFFSET 9;")) == ["[]"]
    assert list(engine.run("QUERY KEYS FOR (size) LIMIT 2 OFFSET 1;")) == ["two", "three"]
    assert list(engine.run("QUERY KEYS FOR (size) OFFSET 1;")) == ["two", "three", "one"]
    assert list(engine.run("QUERY (nothing) LIMIT 0;")) == ["[]"]
    assert json.loads(list(engine.run("QUERY (red) LIMIT 0;"))[0]) == {"result-count": 3, "result": []}


def test_list_headers(engine):
    rows = {r["key"]: (r["header"], r["header_key"]) for r in engine.query("QUERY (name-in:list)").rows.collect()}
    assert rows == {"two": ("Group One", "000000"), "three": ("Group One", "000000")}


def test_thresholds(engine):
    rows = engine.query("QUERY (red) THRESHOLDS 5, 9, 7.5 FOR KEY 'size'").rows.collect()
    assert sorted((r["doc"], r["score"], r["header"], r["header_key"]) for r in rows) == [(1, 5.0, "5–7.5", "AAAAB"), (2, 7.5, "7.5–9", "AAAAC")]
    back = engine.query("QUERY (red) THRESHOLDS 5, 7.5, 9 FOR KEY '~size'").rows.collect()
    assert sorted(r["header_key"] for r in back) == ["AAAAB", "AAAAC"]
    dated = engine.query("QUERY (red) THRESHOLDS 19000, 19001, 19005 FOR KEY 'event:x'").rows.collect()
    assert {r["doc"]: r["header"] for r in dated} == {1: "January 8, 2022", 2: "January 9, 2022–January 13, 2022", 3: "January 9, 2022–January 13, 2022"}
    assert engine.query("QUERY (red) THRESHOLDS 5, 9 FOR KEY 'nothing'").rows.count() == 0
    assert engine.query("QUERY (red) THRESHOLDS 5 FOR KEY 'size'").rows.count() == 0


def test_buckets_are_half_open():
    edges = [0.0, 1.0, 2.5]
    for score, upper in ((0.0, 1), (0.5, 1), (1.0, 2), (2.4, 2)):
        assert bucket_of(edges, score) == upper
    assert [b[3] for b in bucket_table(Thresholds((0, 1, 2.5), "~x"), False)] == ["AAAAC", "AAAAB"]


def test_feature_matrix(engine):
    rows = {r["doc"]: r for r in engine.select("SELECT red, size, both, MAX(size) > 6, in-name:host FROM (red + size) WITH SUMMARIES").collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[1]["f1"], rows[1]["f2"], rows[1]["f4"], rows[1]["f5"]) == (1.0, 5.0, 9.0, 1.0)
    assert math.isnan(rows[3]["f2"]) and math.isnan(rows[4]["f1"]) and math.isnan(rows[1]["f3"])
    assert rows[3]["f3"] == 30.0 and rows[1]["json"] == '{"t":1}'
    assert list(engine.run("SELECT red, size FROM (KEY=one) WITH SUMMARIES;")) == ['one,1,5,"{""t"":1}"']


def test_other_statements(engine):
    assert list(engine.run("PARSE a b; SET OUTPUT FORMAT CSV; SET TIME FORMAT '%Y';")) == ["(a AND b)"]
    assert engine.options == {"OUTPUT FORMAT": "CSV", "TIME FORMAT": "%Y"}
    out = list(engine.run("PARSE a; PARSE (;"))
    assert out[0] == "a" and "error" in json.loads(out[1])
    assert "error" in json.loads(next(engine.run(f"SET TIME FORMAT '{'x' * 70}';")))
    assert engine.parse("a > 1.50") == "(a>1.5)"
    engine.use_sizes(["red", "size"])
    assert engine.sizes == {"red": 4, "size": 5}
    engine.sizes = None


def test_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    e = Engine(Index(none(P), none("table_seq INT, base BIGINT, doc BIGINT, key STRING, json STRING"), none("table_seq INT, key STRING, json STRING")))
    assert e.query("QUERY (a + b)").rows.count() == e.select("SELECT a FROM (b)").count() == e.correlate("CORRELATE QUERY (a), (b)").count() == 0
    assert docs(e, "KEY=x") == docs(e, "MAX(a) - b") == []
