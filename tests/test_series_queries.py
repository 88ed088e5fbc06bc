"""Time series on odd keys and dates come back from text as their SQL has them."""

from datetime import datetime

import pytest

from gristdex.queries import roundtrip
from gristdex.sources import load

KEYS = ["a\nb", "\n", "c\rd", "e\r\n", "\\n", "", " f ", "t\tu", "x;y", "\\"]
DATES = [datetime(y, 12, 31, 23, 59, 59, 999_999) for y in (1, 1969, 2016, 2262, 2600, 9999)]
SERIES = "key STRING, ts TIMESTAMP_NTZ, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT"


@pytest.mark.parametrize("name", ["load_series_text", "load_series_seconds"])
def test_odd_keys_and_dates(spark, tmp_path, name):
    import duckdb

    rows = [(k, t, s, *p) for k in KEYS for t in DATES for s, p in ((0.1, (1.0, 2.0, 3.0, 4.0)), (float("nan"), (None,) * 4))]
    spark.createDataFrame(rows, SERIES).write.parquet(str(tmp_path / "time_series.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW time_series AS SELECT * FROM '{tmp_path}/time_series.parquet/*.parquet'")
    got, want = roundtrip.QUERIES[name](spark, str(tmp_path)), db.sql(roundtrip.SQL[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    assert got.count() == len(rows) - (name == "load_series_seconds") * 2 * len(DATES)


def test_lines_whose_end_is_cut_by_a_split(spark, tmp_path):
    want = sorted("\n" * (i % 4) + f"k{i}" + "\r\n" * (i % 3) for i in range(40))
    (tmp_path / "t").write_bytes("".join(f"{k};{i};1;\n" for i, k in enumerate(want)).encode())
    size = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for n in (7, 8, 9, 50):
            for key in size:
                spark.conf.set(key, str(n))
            rows = load.load_time_series(spark, str(tmp_path / "t"), "%s", ";", unescape=False, line_end=";\n")
            assert rows.rdd.getNumPartitions() > 1
            assert sorted(r["key"] for r in rows.collect()) == want
    finally:
        for key in size:
            spark.conf.unset(key)
