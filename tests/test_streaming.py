from datetime import datetime

from gristdex.streaming.ingest import POSTINGS, append_table, arrivals, first_arrivals, posting_stream


def test_stream(spark, tmp_path):
    day = lambda d, h=2: datetime(2024, 1, d, h)
    row = lambda k, doc, t: (0, k, doc, 1, 0.5, None, None, None, None, t)
    spark.createDataFrame([row("a", 1, day(1)), row("a", 1, day(1, 3)), row("a", 2, day(1)), row("b", 1, day(2)), row(None, 1, day(2))], POSTINGS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = posting_stream(spark, str(tmp_path / "in"))
    append_table(first_arrivals(stream), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    append_table(first_arrivals(stream), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()  # nothing new
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    q = arrivals(stream).writeStream.format("memory").queryName("arrived").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["key"], r["from"].day, r["n"]) for r in spark.table("arrived").collect()) == [("a", 1, 3), ("b", 2, 1)]
