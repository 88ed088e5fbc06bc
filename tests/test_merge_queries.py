"""The merge queries merge: their two tables share instants."""

import os

import pytest

from gristdex.queries import reference
from gristdex.sources import merge

DATA = os.environ.get("GRISTDEX_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", ["merge_union", "merge_union_percentiles", "merge_sum_overlap"])
def test_instants_come_from_both_tables(spark, monkeypatch, name):
    given, real = [], merge.merge_series
    monkeypatch.setattr(merge, "merge_series", lambda tables, mode: given.extend(tables) or real(tables, mode))
    out = reference.QUERIES[name](spark, DATA)
    one, two = ({(r["key"], r["ts"]) for r in t.collect()} for t in given)
    assert one & two and one - two and two - one
    assert {(r["key"], r["ts"]) for r in out.collect()} == one | two
    if "union" in name:
        assert given[0].where("pct5 IS NOT NULL").count() and given[1].where("pct5 IS NOT NULL").count()


def test_scores_are_added(spark):
    once = {(r["key"], r["ts"]): r["score"] for r in reference.QUERIES["merge_union"](spark, DATA).collect()}
    added = {(r["key"], r["ts"]): r["score"] for r in reference.QUERIES["merge_sum_overlap"](spark, DATA).collect()}
    assert once.keys() <= added.keys() and sum(added[k] == 2 * v != 0 for k, v in once.items()) > 50
