import math

import pytest
from pyspark.errors import PySparkException

from gristdex.engine import Engine
from gristdex.model import PERCENTILES
from gristdex.shell import main
from gristdex.sources import export, load, merge, tables
from gristdex.sources.catalog import load_catalog

SERIES = "key STRING, ts TIMESTAMP, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT"


def write(path, lines):
    path.write_text("".join(x + "\n" for x in lines), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A small index loaded from text, written as Parquet and described by a catalog."""
    d = tmp_path_factory.mktemp("index")
    pages = load.load_summaries(spark, write(d / "p.tsv", ['b\t{"x":1}', 'a\t{"x":"t\\tab"}', "ä\t{}"]), 0)
    users = load.load_summaries(spark, write(d / "u.tsv", ['a\t{"u":1}', 'c\t{"u":2}']), 1000, table_seq=1)
    summaries = pages.unionByName(users)
    postings = load.load_index(spark, write(d / "i.tsv", ["red\ta\t0", "red\tb\t0", "red\tgone\t0", "size\tc\t2.5 1 2 3 4", "size\tb\t7", "size\tb\t7.5", "od\\td\tc\t1"]), summaries)
    tables.write_table(pages.select("key", "doc", "json"), str(d / "pages"))
    tables.write_table(users.select("key", "doc", "json"), str(d / "users"), compression="zstd", level=5)
    tables.write_table(postings.drop("table_seq"), str(d / "main"), "keyword", compression="none")
    write(d / "catalog.tsv", ["# index", f"summary\t{d}/pages", f"summary\t{d}/users\t1000", f"index\t{d}/main"])
    return d, summaries, postings


def test_documents_are_numbered_in_key_order(stored):
    _, summaries, _ = stored
    rows = sorted((r["table_seq"], r["key"], r["doc"], r["json"]) for r in summaries.collect())
    assert rows == [(0, "a", 0, '{"x":"t\tab"}'), (0, "b", 1, '{"x":1}'), (0, "ä", 2, "{}"), (1, "a", 1000, '{"u":1}'), (1, "c", 1001, '{"u":2}')]


def test_postings_are_resolved_by_the_last_table(stored):
    _, _, postings = stored
    rows = sorted((r["keyword"], r["doc"], r["seq"], r["score"], r["pct95"]) for r in postings.collect())
    assert rows == [("od\td", 1001, 1, 1.0, None), ("red", 1, 1, 0.0, None), ("red", 1000, 1, 0.0, None), ("size", 1, 1, 7.0, None), ("size", 1, 2, 7.5, None), ("size", 1001, 1, 2.5, 4.0)]


def test_open_search_and_shell(spark, stored, capsys):
    d, _, postings = stored
    index = tables.open_index(spark, load_catalog(spark, str(d / "catalog.tsv")))
    assert sorted((r["keyword"], r["doc"], r["score"]) for r in index.rows().collect()) == sorted((r["keyword"], r["doc"], r["score"]) for r in postings.collect())
    assert list(Engine(index).run("QUERY KEYS FOR (red + size);")) == ["b", "c", "a"]
    assert main(["--catalog", str(d / "catalog.tsv"), "-c", "QUERY KEYS FOR (size) LIMIT 1"]) == 0
    assert capsys.readouterr().out == "b\n"
    assert main(["--catalog", str(d / "none.tsv"), "-c", "PARSE a"]) == 1
    assert "error" in capsys.readouterr().out


def test_published_once_and_sorted(spark, stored, tmp_path):
    d, _, _ = stored
    with pytest.raises(PySparkException):
        tables.write_table(spark.createDataFrame([("x",)], "key STRING"), str(d / "pages"))
    raw = spark.createDataFrame([(a + b, "xxx") for a in "zyxabc" for b in "bca"], "key STRING, value STRING")
    tables.write_table(raw, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [r["key"] for r in tables.read_rows(back, "key", 3, skip=1, start="b").collect()] == ["bb", "bc", "ca"]
    assert back.where("key = 'A'").count() == 0 and back.where("key = 'aa'").count() == 1
    tables.write_table(raw.limit(0), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0


def test_duplicate_keys(spark):
    twice = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "key STRING, json STRING")
    with pytest.raises(tables.DuplicateKeyError):
        tables.require_unique(twice)
    with pytest.raises(Exception, match="duplicate key a"):
        tables.unique_keys(twice).collect()
    with pytest.raises(Exception, match="duplicate key a"):
        load.number_documents(twice)
    tables.require_unique(twice.limit(1))
    assert tables.unique_keys(twice.where("json <> 'z'")).count() == 2


def test_a_write_that_breaks_off_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).selectExpr("CAST(id AS STRING) AS key", "if(id = 77, CAST(raise_error('broken off') AS BIGINT), id) AS v").repartition(4)
    with pytest.raises(Exception, match="broken off"):
        tables.write_table(rows, path)
    with pytest.raises(PySparkException):  # neither a schema nor rows to be read
        spark.read.parquet(path)
    tables.write_table(spark.range(99).selectExpr("CAST(id AS STRING) AS key", "id AS v"), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 99
    with pytest.raises(PySparkException):  # a table is written once
        tables.write_table(spark.range(1).selectExpr("'x' AS key"), path)
    assert spark.read.parquet(path).count() == 99


def test_rows_after_skipping_without_a_count(spark):
    rows = spark.createDataFrame([(f"k{i % 40:02}", i) for i in range(200)], "key STRING, n INT").repartition(5)
    want = sorted(map(tuple, rows.collect()))
    skipped = tables.read_rows(rows, "key", skip=37, start="k05", then=("n",))
    assert "SinglePartition" not in skipped._jdf.queryExecution().executedPlan().toString().replace("SinglePartition, ENSURE", "")
    assert [tuple(r) for r in skipped.collect()] == [w for w in want if w[0] >= "k05"][37:]
    assert tables.read_rows(rows, "key", skip=500).count() == 0


def test_scores_and_dates(spark, tmp_path):
    good = load.load_time_series(spark, write(tmp_path / "t.tsv", ["k\t2024-02-29 12:00:00\t1.5", "k\t2024-03-01 00:00:00\tnan 1 2 3 4"]))
    rows = sorted((str(r["ts"]), r["pct5"]) for r in good.collect())
    assert rows == [("2024-02-29 12:00:00", None), ("2024-03-01 00:00:00", 1.0)]
    assert load.load_time_series(spark, write(tmp_path / "s.tsv", ["k;86400;2"]), "%s", ";").collect()[0]["ts"].day == 2
    for bad in ("k\tyesterday\t1", "k\t2024-01-01 00:00:00\t1 2 3", "k\t2024-01-01 00:00:00\tx"):
        with pytest.raises(PySparkException):
            load.load_time_series(spark, write(tmp_path / "bad.tsv", [bad])).collect()
    with pytest.raises(ValueError):
        load.read_delimited(spark, "x", ("a",), "ab")
    raw = load.read_delimited(spark, write(tmp_path / "r.tsv", ["a\\tb\tc\td"]), ("x", "y"), unescape=False).collect()
    assert [tuple(r) for r in raw] == [("a\\tb", "c\td")]
    rows = load.columnar(spark.createDataFrame([("k", "n", None)], "a STRING, b STRING, c FLOAT"), "a", "b", "c").collect()
    assert rows[0]["score"] == 0.0


def test_loader_options(spark):
    df = spark.createDataFrame([("a:x", 1.0), ("a:y", float("nan")), ("b:z", 5.0), ("a:w", None)], "keyword STRING, score FLOAT")
    keys = lambda d: sorted(r["keyword"] for r in d.collect())
    assert keys(load.threshold(df, 2)) == ["a:w", "a:y", "b:z"]
    assert keys(load.key_filter(df, "a:.")) == ["a:w", "a:x", "a:y"] and keys(load.key_filter(df, "a|b:z")) == ["b:z"]
    assert keys(load.add_prefix(load.strip_prefix(load.key_filter(df, "a:.*"), "a:"), "foo:")) == ["foo:w", "foo:x", "foo:y"]
    with pytest.raises(PySparkException):
        load.strip_prefix(df, "a:").collect()
    assert sorted(k for i in range(3) for k in keys(load.shard(df, 3, i))) == keys(df)
    with pytest.raises(ValueError):
        load.shard(df, 3, 3)
    assert [load.literal_prefix(p) for p in ("abc", "ab*", "a|b", "event:.*", "x+", "(a)")] == ["abc", "a", "", "event:", "x", ""]


def series(spark, rows):
    return spark.createDataFrame([(k, s, *(None if x is None else float(x) for x in p)) for k, s, *p in rows], "key STRING, ts BIGINT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT")


NONE = (None,) * 4


def merged(spark, tables_, mode):
    return sorted((r["key"], r["ts"], r["score"], r["pct5"]) for r in merge.merge_series([series(spark, t) for t in tables_], mode).collect())


def test_merge_series(spark):
    one = [("a", 1, 0.5, *NONE), ("b", 3, 6.0, 1, 2, 3, 4), (None, 1, 1.0, *NONE)]
    two = [("a", 2, 4.0, *NONE), ("c", 4, 8.0, *NONE), ("b", 3, 6.0, *NONE)]
    assert merged(spark, [one, two], "union") == [("a", 1, 0.5, None), ("a", 2, 4.0, None), ("b", 3, 6.0, 1.0), ("c", 4, 8.0, None)]
    other = [("b", 3, 7.0, *NONE), ("a", 1, 9.0, *NONE)]
    assert merged(spark, [one, other], "pick-one") == [("a", 1, 0.5, None), ("b", 3, 7.0, None)]
    with pytest.raises(PySparkException):
        merged(spark, [one, other], "union")
    assert merged(spark, [one[:1], other[1:], two[:1]], "sum") == [("a", 1, 9.5, None), ("a", 2, 4.0, None)]
    with pytest.raises(PySparkException):
        merged(spark, [one, other], "sum")
    with pytest.raises(ValueError):
        merged(spark, [one], "other")
    nan = [("a", 1, math.nan, *NONE)]
    for mode in ("union", "pick-one", "sum"):  # a missing score is NaN
        assert math.isnan(merged(spark, [[("a", 1, None, *NONE)]], mode)[0][2])
    assert len(merged(spark, [nan], "union")) == 1
    with pytest.raises(PySparkException):
        merged(spark, [nan, nan], "union")


def test_merge_summaries_and_index(spark):
    t = lambda *rows: spark.createDataFrame(rows, "key STRING, json STRING")
    a, b = t(("x", '{"a":1}'), ("y", None)), t(("x", ' {"b":2} '), ("z", "{}"), (None, "{}"))
    get = lambda mode: {r["key"]: r["json"] for r in merge.merge_summaries([a, b], mode).collect()}
    assert get("union") == {"x": '{"a":1,"b":2}', "y": "{}", "z": "{}"} and get("pick-one")["x"] == '{"a":1}'
    with pytest.raises(ValueError):
        get("sum")
    p = lambda *ks: spark.createDataFrame([(k, 1, 1, 0.0, *NONE) for k in ks], "keyword STRING, doc BIGINT, seq INT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT")
    assert merge.merge_index([p("a", "b", "b"), p("c")]).count() == 4
    assert sorted(r["keyword"] for r in merge.merge_index([p("a"), p("b", None)]).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="duplicate key a"):
        merge.merge_index([p("a"), p("a")]).collect()


def test_text_exports(spark, stored):
    d, _, _ = stored
    index = tables.open_index(spark, load_catalog(spark, str(d / "catalog.tsv")))
    lines = list(export.posting_lines(export.raw_postings(index).orderBy("keyword", "doc", "score").collect()))
    assert lines[-4:] == ["size", "\t1 7", "\t1 7.5", "\t1001 2.5"]
    assert "b\t{\"x\":1}\t7.5" in list(export.resolved_lines(export.resolved_postings(index).collect()))
    rows = spark.createDataFrame([("k", "2024-01-02", 1.25, 1.0, 2.0, 3.0, 4.0), ("k", "2024-01-03", 1.0, *NONE)], "key STRING, date STRING, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT")
    assert list(export.series_lines(rows.collect())) == ["k\t2024-01-02\t1.25 1 2 3 4", "k\t2024-01-03\t1"]
    assert set(PERCENTILES) <= set(rows.columns)


def test_objects_and_existence(spark, stored, tmp_path):
    from dataclasses import replace

    from gristdex.operators.leaves import exists

    d, _, _ = stored
    (tmp_path / "hosts").write_text("{H} a.example")
    index = replace(tables.open_index(spark, load_catalog(spark, str(d / "catalog.tsv"))), objects=tables.read_objects(spark, str(tmp_path)))
    assert [tuple(r) for r in index.objects.collect()] == [("hosts", "{H} a.example")]
    assert Engine(index).evaluate("name-in:hosts").df.count() == 0
    assert exists(index, "red") and not exists(index, "Red")
