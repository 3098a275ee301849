import datetime

from cohortloom.streaming import predictions


def test_stream_equals_batch(spark, tmp_path):
    t = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = [("r1", t(1), "a", "a", True), ("r1", t(1, 1), "a", "a", True), ("r2", t(1, 2), "b", None, False), ("r3", t(2), "b", "a", True), ("r4", t(9), "a", "a", True)]
    source, out = str(tmp_path / "in"), "windows"
    spark.createDataFrame(rows, predictions.SCHEMA).repartition(2).write.parquet(source)
    found = predictions.windowed_accuracy(predictions.attempts(spark, source))
    query = found.writeStream.outputMode("complete").format("memory").queryName(out).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    streamed = {(r["window"]["start"], r["eligible"], r["failed"], r["top1"]) for r in spark.sql(f"SELECT * FROM {out}").collect()}
    batch = spark.read.parquet(source).dropDuplicates(["request_sha256"])
    assert streamed == {(r["window"]["start"], r["eligible"], r["failed"], r["top1"]) for r in predictions.windowed_accuracy(batch).collect()}
    assert (t(1), 2, 1, 0.5) in streamed


def test_stream_drops_what_is_late(spark, tmp_path):
    """In append mode a window comes out once the watermark has passed it, without rows that are later than allowed."""
    t = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    source = str(tmp_path / "in")
    spark.createDataFrame([("r1", t(1), "a", "a", True)], predictions.SCHEMA).write.parquet(source)
    query = predictions.windowed_accuracy(predictions.attempts(spark, source)).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c"))
    query = query.start()
    query.processAllAvailable()
    for rows in ([("r2", t(9), "a", "b", True)], [("r3", t(1, 1), "a", "a", True), ("r4", t(20), "a", "a", True)], [("r5", t(21), "a", "a", True)]):
        spark.createDataFrame(rows, predictions.SCHEMA).write.mode("append").parquet(source)
        query.processAllAvailable()
    query.stop()
    assert [(r["window"]["start"], r["eligible"], r["top1"]) for r in spark.sql("SELECT * FROM closed ORDER BY window.start").collect()] == [(t(1), 1, 1.0), (t(9), 1, 0.0)]
