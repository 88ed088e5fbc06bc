from collections import Counter, defaultdict

import pytest

from gristdex.operators.skew import heavy_keys, per_key, skew_join, split_by_weight

NAN = float("nan")
ROWS = [("hot", i % 50, float(i % 7)) for i in range(600)] + [("warm", None, NAN)] * 120 + [("", 1, None)] * 30 + [(None, 1, 1.0)] * 50 + [(f"k{i}", i, float(i)) for i in range(200)]


@pytest.fixture(scope="module")
def df(spark):
    # Extra columns whose names the operator uses itself.
    return spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], "keyword STRING, doc BIGINT, score FLOAT, n_rows INT, salt INT, k INT").repartition(5)


def test_counts_are_exact(df):
    got = {r["key"]: r for r in per_key(df, "keyword", "doc", "score", share=0.1).collect()}
    rows, docs, values = Counter(), defaultdict(set), defaultdict(list)
    for k, d, v in ROWS:
        if k is None:
            continue
        rows[k] += 1
        docs[k] |= {d} - {None}
        if v is not None and v == v:
            values[k].append(v)
    assert {k: (r["n_rows"], r["n_records"]) for k, r in got.items()} == {k: (rows[k], len(docs[k])) for k in rows}
    for k, r in got.items():
        v = values[k]
        assert (r["value_min"], r["value_max"], r["value_sum"]) == ((min(v), max(v), sum(v)) if v else (None, None, None))
    plain = per_key(df, "keyword").collect()
    assert {r["key"]: r["n_rows"] for r in plain} == dict(rows)
    assert {r["key"]: r["row_share"] for r in plain} == {k: n / len(ROWS) for k, n in rows.items()}


def test_heavy_keys_are_found_and_split_off(df):
    names = {r[0] for r in heavy_keys(df, "keyword", 0.1).collect()}
    assert {"hot", "warm"} <= names and len(names) <= 20
    heavy, light, _ = split_by_weight(df, "keyword", 0.1)
    assert heavy.count() + light.count() == len(ROWS)
    assert "hot" not in {r[0] for r in light.select("keyword").distinct().collect()}
    with pytest.raises(ValueError):
        heavy_keys(df, "keyword", 0)


def test_join(spark, df):
    right = spark.createDataFrame([("hot", "H"), ("k5", "K"), ("unused", "U")], "keyword STRING, tag STRING")
    assert Counter(r["tag"] for r in skew_join(df.select("keyword", "doc"), right, "keyword", 0.1).collect()) == {"H": 600, "K": 1}
    left = skew_join(df.select("keyword", "doc"), right, "keyword", 0.1, "left")
    assert left.count() == len(ROWS) and left.where("tag IS NULL").count() == len(ROWS) - 601
    with pytest.raises(ValueError):
        skew_join(df, right, "keyword", 0.1, "outer")
    light_twice = right.unionByName(right.where("keyword = 'k5'"))
    assert skew_join(df.select("keyword", "doc"), light_twice, "keyword", 0.1).count() == 602
    with pytest.raises(Exception, match="duplicate key hot"):
        skew_join(df.select("keyword", "doc"), right.unionByName(right), "keyword", 0.1).collect()


def test_empty(spark):
    none = spark.createDataFrame([], "keyword STRING, doc BIGINT, score FLOAT")
    assert per_key(none, "keyword", "doc", "score").count() == per_key(none, "keyword").count() == heavy_keys(none, "keyword", 0.5).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1.0)], "keyword STRING, doc BIGINT, score FLOAT")
    assert per_key(nulls, "keyword", "doc").count() == 0
