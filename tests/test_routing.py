import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.streaming import routing as R


def raw(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "value string").withColumn("at", F.timestamp_seconds(F.lit(0)))


def publish(job, seq, payload="p"):
    return {"job_id": job, "seq": seq, "payload": payload}


def outcome(job, seq, ok):
    return {"job_id": job, "seq": seq, "ok": ok}


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_each_entry_has_its_output(spark):
    rows = [publish("a", 1), publish("a", 2), publish("a", 3, "other"), outcome("a", 4, False), outcome("a", 5, False), outcome("a", 6, True), outcome("a", 7, False),
            publish("b", 1), outcome("b", 2, False), outcome("b", 3, False), outcome("b", 4, False), outcome("b", 5, True), publish("b", 6), outcome("c", 1, True), publish("c", 2), outcome("c", 3, True), "nonsense", "{}", None,
            {"job_id": "d", "seq": 1}]
    got = R.routed(R.readable(raw(spark, rows))).collect()
    by = lambda job: [(r["seq"], r["output"], r["attempt"], r["pause_s"]) for r in sorted(got, key=lambda r: r["seq"] or 0) if r["job_id"] == job]
    assert by("a") == [(1, "published", None, None), (2, "existing", None, None), (3, "conflict", None, None), (4, "retrying", 1, 1.0), (5, "retrying", 2, 2.0), (6, "done", 3, None), (7, "ignored", None, None)]
    assert by("b") == [(1, "published", None, None), (2, "retrying", 1, 1.0), (3, "retrying", 2, 2.0), (4, "quarantine", 3, None), (5, "ignored", None, None), (6, "existing", None, None)]
    assert by("c") == [(1, "quarantine", None, None), (2, "published", None, None), (3, "done", 1, None)]
    reasons = sorted((r["reason"], r["value"]) for r in got if r["output"] == "quarantine" and r["value"] is not None)
    assert [x for x, _ in reasons] == [R.SPENT, R.UNKNOWN, R.UNREADABLE, R.UNREADABLE, R.UNREADABLE] and json.loads(reasons[0][1]) == outcome("b", 4, False)


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_equals_batch(spark, tmp_path, state_store):
    """State is kept between batches; each output has its own table."""
    rng = random.Random(6)
    rows = []
    for seq in range(240):
        job = f"j{rng.randrange(25)}"
        rows.append(rng.choice([publish(job, seq, rng.choice("pq")), outcome(job, seq, False), outcome(job, seq, rng.random() < 0.3), f"bad {seq % 7}"]))
    (tmp_path / "in").mkdir()
    stream = R.route(R.readable(spark.readStream.schema("value string, at timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")))
    for k in range(3):
        raw(spark, rows[80 * k: 80 * k + 80]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream.writeStream.foreachBatch(R.by_output(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = R.routed(R.readable(raw(spark, rows)))
    assert plain(got.select(want.columns)) == plain(want)
    assert {r["output"] for r in got.select("output").distinct().collect()} >= {"published", "existing", "conflict", "retrying", "quarantine"}
    assert spark.read.parquet(f"{tmp_path}/out/output=quarantine").where("reason = 'attempts are spent'").count() > 0


def test_a_repeated_epoch_replaces_itself(spark, tmp_path):
    rows = R.routed(R.readable(raw(spark, [publish("a", 1), publish("a", 2, "x")])))
    write = R.by_output(f"{tmp_path}/out")
    write(rows, 0)
    write(rows, 0)
    write(rows.where("output = 'conflict'"), 1)
    assert sorted((r["output"], r["epoch"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("conflict", 0), ("conflict", 1), ("published", 0)]


def test_jobs_are_forgotten_by_a_timer(spark, tmp_path, state_store):
    (tmp_path / "in").mkdir()
    stream = R.route(R.readable(spark.readStream.schema("value string, at timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")), forget_s=1)

    q = stream.writeStream.foreachBatch(R.by_output(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()

    def told(k, row, n):
        raw(spark, [row]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for _ in range(60):
            time.sleep(0.5)
            if (tmp_path / "out").exists() and spark.read.schema(f"{R.ROUTED}, epoch int").parquet(f"{tmp_path}/out").count() >= n:
                return
        raise AssertionError("the stream gave no row")

    try:
        told(0, publish("a", 1), 1)
        time.sleep(4)  # time goes on: a timer is due
        told(1, publish("a", 2, "other"), 2)
    finally:
        q.stop()
    assert [r["output"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["published", "published"]
