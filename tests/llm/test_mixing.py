import pytest

from gristdex.llm.encode import encoder, vocabulary_path
from gristdex.llm.mixing import Mix, targets_of

pytest.importorskip("public_tokenizers")
DOCS = [(i, "word " * (i % 7 + 1), "big") for i in range(300)] + [(1000 + i, "small text here", "small") for i in range(5)] + [(2000, None, "blank"), (2001, "", "blank"), (3000, "lost", None), (3001, "other", "unused")]
TARGETS = [("big", 0.5, 3), ("small", 0.25, 4), ("blank", 0.1, 2), ("gone", 0.05, 2), ("zero", 0.0, 3), (None, 0.3, 1), ("big", 0.1, 1), ("bad", float("nan"), 1), ("none", None, 2)]


@pytest.fixture(scope="module")
def mix(spark):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id BIGINT, text STRING, source STRING, tokens INT, key INT").repartition(3)
    return Mix(docs, spark.createDataFrame(TARGETS, "source STRING, weight DOUBLE, max_repeats INT"))


def sizes():
    coder = encoder(vocabulary_path())
    out = {"big": {}, "small": {}, "blank": {}, "gone": {}}
    for d, t, s in DOCS:
        if s in out:
            out[s][d] = len(coder.encode([t or ""])[0][0])
    return out


def test_plan(mix):
    size = {s: sum(x.values()) for s, x in sizes().items()}
    weight = {"big": 0.6, "small": 0.25, "blank": 0.1, "gone": 0.05}
    whole = sum(size.values())
    rows = {r["source"]: r for r in mix.plan().collect()}
    assert rows.keys() == weight.keys()
    repeats = {"big": 3, "small": 4, "blank": 2, "gone": 2}
    for s, r in rows.items():
        assert r["size"] == size[s] and r["whole"] == whole and r["budget"] == pytest.approx(whole * weight[s])
        assert r["capped"] == (size[s] * repeats[s] < r["budget"])
    assert {r["source"]: r["capped"] for r in mix.report().collect()} == {s: size[s] * repeats[s] < whole * weight[s] for s in weight}


def test_capped_sources_come_through_the_cut(mix):
    plan = mix.report().where("capped").select("source")._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(tokens" in plan and "windowspecdefinition(source" in plan and "key" in plan and "running" in plan


def test_records_are_cut_at_the_budget(mix):
    size, plan = sizes(), {r["source"]: r for r in mix.plan().collect()}
    got = mix.records().collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    for s in ("big", "small"):
        mine = [r for r in got if r["source"] == s]
        total = sum(r["tokens"] * r["repeats"] for r in mine)
        assert all(r["tokens"] == size[s][r["doc_id"]] for r in mine) and max(r["repeats"] for r in mine) <= plan[s]["max_repeats"]
        if plan[s]["capped"]:
            assert total == sum(size[s].values()) * plan[s]["max_repeats"]
        else:  # the next record would go beyond
            assert total <= plan[s]["budget"] < total + max(size[s].values())
    assert not any(r["source"] in ("gone", "unused", None) for r in got)


def test_report_and_repeatability(spark, mix):
    rows = {r["source"]: r for r in mix.report().collect()}
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1) and sum(r["target_share"] for r in rows.values()) == pytest.approx(1)
    totals = {r["source"]: r["actual_tokens"] for r in rows.values()}
    assert totals["gone"] == 0 and rows["gone"]["records"] == 0
    again = Mix(spark.createDataFrame(DOCS, "doc_id BIGINT, text STRING, source STRING"), spark.createDataFrame(TARGETS, "source STRING, weight DOUBLE, max_repeats INT"))
    assert sorted(map(tuple, again.records().collect())) == sorted(map(tuple, mix.records().collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING, source STRING")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source STRING, weight DOUBLE, max_repeats INT")
    m = Mix(docs, targets)
    assert m.records().count() == 0 and [r["actual_tokens"] for r in m.report().collect()] == [0]
    assert Mix(spark.createDataFrame(DOCS, "doc_id BIGINT, text STRING, source STRING"), targets.limit(0)).report().count() == 0
    odd = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, -2)], "source STRING, weight DOUBLE, max_repeats INT")
    assert sorted(r["max_repeats"] for r in targets_of(odd).collect()) == [0, 0]
