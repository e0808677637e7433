import datetime

from weftline.streaming import feed


def test_diffs_that_arrive_plan_sections(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [("d", at, i, x) for i, x in enumerate(["diff --git a/a.go b/a.go", "@@ -1 +5 @@"])]
    spark.createDataFrame(rows + rows, feed.SCHEMA).write.parquet(str(tmp_path / "in"))
    symbols = spark.createDataFrame([("A", "a.go", 1, 9)], "id string, filepath string, start_line int, end_line int")
    edges = spark.createDataFrame([], "from_id string, to_id string, kind string, confidence double")
    sources = spark.createDataFrame([("s", "A", "a.go", 0.9)], "section_id string, symbol_id string, file_path string, confidence double")
    got = []
    q = feed.plan_on_arrival(feed.read(spark, str(tmp_path / "in")), symbols, edges, sources, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.section_id for r in got] == ["s"]
    q = feed.touched_by_window(feed.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("touched").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("touched").count() in (0, 1)
