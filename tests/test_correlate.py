"""Mining against a plain-Python model."""

import math
import random

import pytest

from gristdex.engine import Engine
from gristdex.functions.keywords import KeywordRules
from gristdex.model import Index
from gristdex.sources.export import correlate_lines, range_label

P = "table_seq INT, keyword STRING, doc BIGINT, seq INT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT"


def mined(a, b, lists):
    """{(keyword, low, high): (n_a, n_b, log_odds)} of keywords ``{keyword: [(doc, score)]}``."""
    prior = math.log((len(a) + 1) / (len(b) + 1))
    la, lb = max(len(a) // 20, 1), max(len(b) // 20, 1)
    found = {}
    for keyword, rows in lists.items():
        if len(rows) < la and len(rows) < lb:
            continue
        hits = [(s, d in a) for d, s in rows if d in a or d in b]
        if not hits or len(hits) < min(la, lb):
            continue
        ranges = [(-math.inf, math.inf)]
        if any(s != 0 for _, s in rows):
            cuts = sorted({s for s, _ in hits})
            best, place = 0.0, 0
            for i, cut in enumerate(cuts):
                for side in ([x for s, x in hits if s <= cut], [x for s, x in hits if s > cut]):
                    n_a, n = sum(side), len(side)
                    if n_a >= la or n - n_a >= lb:
                        p = (n_a + 1) / (n + 2)
                        gain = abs(math.log(p / (1 - p)) - prior)
                        if gain > best + 1e-12:
                            best, place = gain, i
            if 0 < place < len(cuts) - 1 and best >= math.log(1.05):
                ranges = [(-math.inf, cuts[place]), (cuts[place + 1], math.inf)]
        for low, high in ranges:
            inside = {d for d, s in rows if low <= s <= high}
            n_a, n_b = len(inside & a), len(inside & b)
            odds = math.log((n_a + 1) / (n_b + 1)) - prior
            if (n_a >= la or n_b >= lb) and abs(odds) >= math.log(0.55 / 0.45):
                found[keyword, low, high] = (n_a, n_b, round(odds, 6))
    return found


def shown(df):
    inf = math.inf
    return {(r["keyword"], -inf if r["low"] is None else r["low"], inf if r["high"] is None else r["high"]): (r["n_a"], r["n_b"], round(r["log_odds"], 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    a, b = set(range(1, 61)), set(range(61, 141))
    lists = {}
    for k in range(30):
        lean = rng.random()
        docs = [d for d in range(1, 161) if rng.random() < (0.1 + 0.5 * (lean if d in a else 1 - lean))]
        boolean = k % 3 == 0
        lists[f"k{k}"] = [(d, 0.0 if boolean else float(rng.randint(0, 6) + (3 if d in a and k % 3 == 1 else 0))) for d in docs for _ in range(1 + (rng.random() < 0.2))]
    return a, b, lists


def engine_of(spark, lists, rules=None, now=None):
    rows = [(0, k, d, i, s, None, None, None, None) for k, r in lists.items() for i, (d, s) in enumerate(r)]
    return Engine(Index(spark.createDataFrame(rows, P), rules=rules or KeywordRules()), now=now)


def test_boolean_and_continuous(spark, data):
    a, b, lists = data
    whole = lists | {"A": [(d, 0.0) for d in a], "B": [(d, 0.0) for d in b | {1, 2}]}
    found = shown(engine_of(spark, whole).correlate("CORRELATE QUERY (A), (B)"))
    assert found == mined(a, b, whole)
    assert sum(k[1] > -math.inf for k in found) >= 3  # some keywords are split


def test_either_side_empty(spark, data):
    e = engine_of(spark, {"A": [(1, 0.0)]})
    assert e.correlate("CORRELATE QUERY (A), (none)").count() == e.correlate("CORRELATE QUERY (none), (A)").count() == e.correlate("CORRELATE QUERY (A), (A)").count() == 0


def test_timestamped(spark):
    lists = {
        "event:buy": [(1, 100.0), (1, 90.0), (2, 100.0), (3, 50.0)],
        "event:see": [(1, 89.0), (1, 95.0), (2, 101.0), (3, 49.0), (7, 70.0), (8, 199.0)],
        "base": [(7, 0.0), (8, 0.0), (9, 0.0)],
        "tmp:x": [(1, 0.0), (2, 0.0), (3, 0.0)],
        "late": [(7, 0.0), (8, 0.0)],
    }
    rules = KeywordRules(("tmp:",), ("event:",))
    e = engine_of(spark, lists, rules, now=200.0)
    found = shown(e.correlate("CORRELATE QUERY (event:buy), (base)"))
    assert not any(k[0].startswith("tmp") for k in found)
    # Before the event: 1 day for documents 1 and 3; for others days before now: 130 and 1.
    assert found == mined({1, 2, 3}, {7, 8, 9}, {"event:see": [(1, 1.0), (3, 1.0), (7, 130.0), (8, 1.0)], "base": lists["base"], "late": lists["late"]})
    both = shown(e.correlate("CORRELATE QUERY (event:buy), (event:see)"))
    timed = {"event:see": [(1, 1.0), (3, 1.0)]}
    assert both == mined({1, 2, 3}, {7, 8}, timed | {k: lists[k] for k in ("base", "late")})
    line = next(iter(correlate_lines(e.correlate("CORRELATE QUERY (event:buy), (base)").where("keyword = 'late'").collect(), rules.is_timestamped)))
    assert line.split("\t")[1:] == ["0", "2", "late"]


def test_labels():
    assert range_label(None, None) == "" and range_label(0.5, 2) == "[0.5,2]" and range_label(None, 3) == "≤3" and range_label(3, None) == "≥3"
    assert range_label(2, None, True, True) == "≥2 days ago" and range_label(19000.5, None, True) == "≥2022-01-08 12:00"


def test_running_counts_by_stretches(spark):
    import numpy as np
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gristdex.operators.correlate import running_counts, stretch

    rng = np.random.default_rng(5)
    odd = np.array([0.0, -0.0, np.inf, -np.inf, 1e-45, -1e-45, 3.4e38, 1.0, -1.0], np.float32)
    scores = np.concatenate([odd, rng.normal(0, 100, 300).astype(np.float32), rng.integers(-5, 5, 200).astype(np.float32), np.float32(19000) + rng.random(300).astype(np.float32)])
    # One keyword has nine tenths of the rows.
    rows = [(0, "hot" if rng.random() < 0.9 else f"k{i % 3}", float(s), int(rng.choice([1, -1]))) for i, s in enumerate(scores) for _ in range(2)]
    matched = spark.createDataFrame(rows, "table_seq INT, keyword STRING, score FLOAT, cls INT")
    lists = spark.createDataFrame([(0, k, 1, True, 0.0, 1, 1) for k in ("hot", "k0", "k1")], "table_seq INT, keyword STRING, n_list INT, cont BOOLEAN, prior DOUBLE, limit_a INT, limit_b INT")
    got = {(r["keyword"], r["score"]): (r["a_low"], r["b_low"], r["a_all"], r["b_all"], r["pos"], r["cuts"], r["next"]) for r in running_counts(matched, lists).collect()}
    key = ["table_seq", "keyword"]
    up, whole = Window.partitionBy(*key).orderBy("score"), Window.partitionBy(*key)
    by = matched.where("keyword <> 'k2'").groupBy(*key, "score").agg(F.count_if(F.col("cls") == 1).alias("a"), F.count_if(F.col("cls") == -1).alias("b"))
    plain = by.select("keyword", "score", F.sum("a").over(up), F.sum("b").over(up), F.sum("a").over(whole), F.sum("b").over(whole), F.row_number().over(up), F.count("a").over(whole), F.lead("score").over(up))
    assert got == {(r[0], r[1]): tuple(r[2:]) for r in plain.collect()}

    bits = np.concatenate([np.arange(0x3F7F0000, 0x40010000, 97), np.arange(0, 0x7F800001, 999_983)]).astype(np.uint32)
    near = np.sort(bits.view(np.float32))
    numbers = spark.createDataFrame([(float(x),) for x in near[::5]], "x FLOAT").select("x", stretch(F.col("x")).alias("n"), stretch(-F.col("x")).alias("m")).orderBy("x").collect()
    assert all(a["n"] <= b["n"] and a["m"] >= b["m"] for a, b in zip(numbers, numbers[1:]))
    octave = np.arange(0x3F800000, 0x40000000, dtype=np.uint32).view(np.float32)
    assert np.bincount(np.floor(np.log2(octave.astype(np.float64)) * 256).astype(int)).max() <= 46_000
