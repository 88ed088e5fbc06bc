"""The packed lists of all postings are unpacked and compared."""

import os

import pytest

from gristdex.queries import reference
from gristdex.session import table

DATA = os.environ.get("GRISTDEX_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_posting_comes_back(spark):
    want = table(spark, DATA, "postings").where("keyword IS NOT NULL AND doc IS NOT NULL")
    got = reference.QUERIES["posting_blocks_all"](spark, DATA)
    assert got.columns == [c for c in want.columns if c != "loaded_at"]
    assert got.exceptAll(want.drop("loaded_at")).count() == 0 and got.count() == want.count()
    assert got.where("doc < 100").count() and got.where("doc > 1000000100").count()
