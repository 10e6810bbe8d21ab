from pyspark.sql import functions as F

from cairn.streaming import jobs


def test_state_machine_equals_windows(spark, tmp_path):
    events = spark.createDataFrame([("a", False, 1), ("a", False, 2), ("a", True, 3), ("b", False, 1), ("b", False, 2), ("b", False, 3), ("b", True, 4), ("c", True, 1)], "job_id string, ok boolean, s int").select(
        "job_id", "ok", F.timestamp_seconds("s").alias("at"))
    want = {tuple(r) for r in jobs.states(events).collect()}
    assert ("a", 3, "done", 0.0) in want and ("b", 3, "failed", 0.0) in want and ("a", 2, "retrying", 2.0) in want
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = jobs.state_machine(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == want


def test_publication_quarantine_and_conflicts(spark, tmp_path):
    job = '{"job_id": "%s", "job_type": "full", "repo_path": "%s", "max_attempts": 3, "created_at": "2024-01-01T00:00:00Z"}'
    raw = spark.createDataFrame([(job % ("a", "/x"),), (job % ("a", "/x"),), (job % ("a", "/y"),), ("nonsense",), ("{}",)], "value string")
    rows = jobs.decoded(raw, jobs.JOB, "job_id")
    assert jobs.quarantined(rows).count() == 2
    published = jobs.published(rows)
    assert published.count() == 2 and [r["job_id"] for r in jobs.conflicts(published).collect()] == ["a"]
    raw.write.text(f"{tmp_path}/in")
    stream = jobs.published(jobs.decoded(spark.readStream.text(f"{tmp_path}/in"), jobs.JOB, "job_id"))
    q = stream.writeStream.format("memory").queryName("published").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("published").count() == 2


def test_traces(spark, tmp_path):
    symbols = spark.createDataFrame([("a",), ("b",)], "qualified_name string")
    traces = spark.createDataFrame([("t", "find", ["a", "x"], 1.0)], "trace_id string, tool string, results array<string>, latency_ms double").withColumn("ts", F.current_timestamp())
    traces.write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(traces.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(jobs.trace_sink(symbols, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["total"], r["missing"], r["share"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(2, 1, 0.5)]


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = jobs.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in jobs.event_windows(events).collect()}
