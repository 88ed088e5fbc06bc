import math
import struct
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gristdex.model import BAG_SCHEMA, Bag
from gristdex.operators import bags
from tests import models

INF, NAN = math.inf, math.nan
A = [(1, 5.0), (1, 7.0), (2, 0.0), (4, -1.0), (4, -1.0), (6, NAN), (9, INF)]
B = [(1, 6.0), (2, 3.0), (2, 9.0), (4, 2.0), (5, 1.0), (9, -INF)]


def make(spark, rows, unique=False):
    n = Counter()
    out = []
    for doc, score in rows:
        n[doc] += 1
        out.append((doc, n[doc], score, None, None, None, None))
    return Bag(spark.createDataFrame(out, BAG_SCHEMA), unique)


def bits(score):
    return "nan" if math.isnan(score) else struct.pack("f", score + 0.0)


def shown(bag):
    return Counter((r["doc"], bits(r["score"])) for r in bag.df.collect())


def model(rows):
    return Counter((d, bits(s)) for d, s in rows)


CASES = {
    "union": (bags.union, models.union),
    "intersect": (bags.intersect, models.intersect),
    "subtract": (bags.subtract, models.subtract),
    "greater": (bags.join_greater, lambda a, b: models.join(a, b, lambda x, y: x > y)),
    "less": (bags.join_less, lambda a, b: models.join(a, b, lambda x, y: x < y)),
    "order_by": (bags.order_by, models.order_by),
}


def test_written_out_bags(spark):
    a, b, e = make(spark, A), make(spark, B), make(spark, [])
    assert shown(bags.union(a, b)) == model([(1, 6), (1, 7), (2, 3), (2, 9), (4, 2), (4, -1), (5, 1), (6, NAN), (9, -INF)])
    assert shown(bags.intersect(a, b)) == model([(1, 5), (1, 7), (2, 0), (4, -1), (4, -1), (9, INF)])
    assert shown(bags.subtract(a, b)) == model([(6, NAN)])
    assert shown(bags.join_greater(a, b)) == model([(9, INF)])
    assert shown(bags.join_less(a, b)) == model([(1, 5), (2, 0), (4, -1)])
    assert shown(bags.order_by(a, b)) == model([(1, 6), (1, -INF), (2, 3), (4, 2), (4, -INF), (6, -INF), (9, -INF)])
    assert shown(bags.maximum(a))[(1, bits(7.0))] == 1 and shown(bags.minimum(a))[(1, bits(5.0))] == 1
    assert shown(bags.compare(a, ">", 0)) == model([(1, 5), (1, 7), (9, INF)])
    assert shown(bags.in_range(a, 5, -1)) == model([(1, 5), (2, 0), (4, -1), (4, -1)])
    for op, _ in CASES.values():
        assert shown(op(e, b)) == (model(B) if op is bags.union else Counter())
        assert shown(op(e, e)) == Counter()
    assert shown(bags.maximum(e)) == shown(bags.sample(e, 3)) == Counter()


scores = st.sampled_from([0.0, 1.0, 1.5, -2.0, 3.25, INF, -INF])
bag_rows = st.lists(st.tuples(st.integers(1, 5), scores), max_size=9).map(lambda r: sorted(r, key=lambda x: x[0]))


@pytest.mark.parametrize("name", sorted(CASES))
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=bag_rows, b=bag_rows)
def test_against_the_list_model(spark, name, a, b):
    op, plain = CASES[name]
    assert shown(op(make(spark, a), make(spark, b))) == model(plain(a, b))


def test_unique_bags_take_the_plain_join_and_agree(spark):
    a, b = [(1, 5.0), (2, 1.0), (3, 0.5)], [(2, 4.0), (3, 0.25), (7, 1.0)]
    for op, plain in CASES.values():
        fast = op(make(spark, a, True), make(spark, b, True))
        assert shown(fast) == model(plain(a, b))
        assert fast.unique
    fast = bags.union(make(spark, a, True), make(spark, b, True))
    assert "Window" not in fast.df._jdf.queryExecution().toString()


def test_folds_negation_and_floats(spark):
    a = make(spark, A)
    for pick, op in ((max, bags.maximum), (min, bags.minimum)):
        assert shown(op(a)) == model(models.fold(A, pick))
    (row,) = bags.negate(make(spark, [(1, 0.0)])).df.collect()
    assert math.copysign(1, row["score"]) == -1
    tenth = make(spark, [(1, 0.1)])
    assert shown(bags.compare(tenth, "=", 0.1)) == Counter()  # a 32-bit tenth isn't the double
    nan = make(spark, [(1, NAN)])
    for op in ("=", ">", ">=", "<", "<="):
        assert shown(bags.compare(nan, op, 0)) == Counter()


def test_folds_keep_the_percentiles_of_the_first_row(spark):
    rows = [(1, 1, 2.0, 0.1, 0.2, 0.3, 0.4), (1, 2, 9.0, None, None, None, None)]
    (row,) = bags.maximum(Bag(spark.createDataFrame(rows, BAG_SCHEMA))).df.collect()
    assert row["score"] == 9.0 and row["pct5"] == pytest.approx(0.1)


def test_sample_is_exact_and_repeatable(spark, monkeypatch):
    bag = make(spark, [(i % 40, float(i)) for i in sorted(range(100), key=lambda i: i % 40)])
    first = shown(bags.sample(bag, 17))
    assert sum(first.values()) == 17 and first == shown(bags.sample(bag, 17))
    assert shown(bags.sample(bag, 1000)) == shown(bag)
    monkeypatch.setattr(bags, "GATHERED", 10)  # the same by places in a range sort
    assert shown(bags.sample(bag, 17)) == first and shown(bags.sample(bag, 1000)) == shown(bag)
