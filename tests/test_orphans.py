import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristdex.operators.orphans import ParentRange, orphan_report, orphans, ranged

T0 = datetime(2024, 1, 1)


def at(day):
    return None if day is None else T0 + timedelta(days=day)


def brute(refs, parents):
    out = Counter()
    for ref, t in refs:
        if ref is None:
            continue
        held = t is not None and any(k == ref and (a is None or a <= t) and (r is None or t < r) for k, a, r in parents)
        if not held:
            out[str(ref), t] += 1
    return out


def run(spark, refs, parents, kind, **k):
    r = spark.createDataFrame([(x, at(t), 1, 2) for x, t in refs], f"ref {kind}, loaded_at TIMESTAMP_NTZ, at INT, is_ref INT")
    p = spark.createDataFrame([(x, at(a), at(b), 0) for x, a, b in parents], f"ref {kind}, added_at TIMESTAMP_NTZ, removed_at TIMESTAMP_NTZ, at INT")
    found = orphans(r, "ref", "loaded_at", p, "ref", "added_at", "removed_at", "t", **k)
    return found, Counter({(x["ref"], None if x["at"] is None else (x["at"] - T0).days): x["n_rows"] for x in found.collect()})


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_against_brute_force(spark, kind):
    rng = random.Random(3)
    name = (lambda i: i) if kind == "BIGINT" else (lambda i: ["", "é", "a", "A", "a ", "漢", "zz"][i % 7] + str(i % 5))
    pick = lambda: name(rng.randint(-5, 30))
    day = lambda: rng.choice([None, *range(12)])
    parents = [(rng.choice([None, pick(), pick(), pick()]), day(), day()) for _ in range(60)] * 2
    refs = [(rng.choice([None, pick(), pick(), pick()]), day()) for _ in range(400)] + [(name(1), 3)] * 200
    for partitions in (None, 3):
        _, got = run(spark, refs, parents, kind, partitions=partitions)
        assert got == brute(refs, parents)


def test_empty_sides(spark):
    assert run(spark, [(1, 2), (1, 2), (None, 1)], [], "BIGINT")[1] == {("1", 2): 2}
    assert run(spark, [], [(1, None, None)], "BIGINT")[1] == {}
    assert run(spark, [("x", None)], [("x", None, None)], "STRING")[1] == {("x", None): 1}


def test_report(spark):
    found, _ = run(spark, [(1, 2), (1, 2), (1, 3), (2, 40)], [], "BIGINT")
    rows = {r["period"]: (r["ref_table"], r["n_refs"], r["n_rows"]) for r in orphan_report(found).collect()}
    assert rows == {"2024-01": ("t", 1, 3), "2024-02": ("t", 1, 1)}


def test_overlapping_and_touching_intervals():
    p = ParentRange(pa.array([5, 5, 5, 7]), np.array([0, 2, 10, 4]), np.array([9, 4, 12, 4]))
    times = np.arange(14)
    assert p.alive(pa.array([5] * 14), times).tolist() == [t < 9 or 10 <= t < 12 for t in times]
    assert not p.alive(pa.array([7] * 14), times).any() and not p.alive(pa.array([6] * 14), times).any()


def test_a_key_with_most_references_is_split(spark):
    refs = spark.range(60_000).select(F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("ref"), F.timestamp_seconds("id").alias("at"))
    olds = spark.createDataFrame([(7, None, T0), (7, None, T0), (13, None, None)], "ref BIGINT, added TIMESTAMP, removed TIMESTAMP")
    sizes = sorted(r["count"] for r in ranged(refs, "ref", "at", olds, "ref", "added", "removed", 8).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4]
    missed = orphans(refs, "ref", "at", olds, "ref", "added", "removed", "t", 8)
    assert missed.count() == 6000 and missed.where("ref = 7").isEmpty()
    assert orphans(refs, "ref", "at", olds.where("ref <> 7"), "ref", "added", "removed", "t", 8).count() == 60_000


def test_rows_are_read_once(spark):
    found, _ = run(spark, [(1, 2)], [(1, None, None)], "BIGINT")
    plan = found._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "MapInArrow" in plan and "CartesianProduct" not in plan
