import pytest

from gristdex.llm.mixing import Mix

pytest.importorskip("public_tokenizers")


def test_empty_texts_keep_to_the_cap(spark):
    docs = [(i, "" if i % 2 else None, "capped") for i in range(40)] + [(100, "two words", "capped")]
    docs += [(200 + i, "", "never") for i in range(9)] + [(300 + i, "many words " * 9, "big") for i in range(20)]
    targets = spark.createDataFrame([("capped", 5.0, 2), ("never", 1.0, 0), ("big", 1.0, 1)], "source STRING, weight DOUBLE, max_repeats INT")
    mix = Mix(spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING"), targets)
    got = {r["doc_id"]: r["repeats"] for r in mix.records().collect()}
    assert all(r["capped"] for r in mix.plan().where("source = 'capped'").collect())
    assert {d: n for d, n in got.items() if d < 200} == {d: 2 for d, _, s in docs if s == "capped"}
    assert not any(200 <= d < 300 for d in got)
