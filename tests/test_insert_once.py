import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairn.sources import insert_once as S

ITEM = "project string, batch string, path string, content string, sha256 string, bytes long, tombstone boolean"


def item(project, batch, path, content="x", **odd):
    raw = (content or "").encode()
    return (project, batch, path, odd.get("content", content), odd.get("sha256", hashlib.sha256(raw).hexdigest()), odd.get("bytes", len(raw)), odd.get("tombstone", False))


def gone(project, batch, path):
    return (project, batch, path, None, None, None, True)


@pytest.mark.parametrize("path, want", [("a/b.py", "a/b.py"), ("a\\b", "a/b"), ("/a", None), ("a//b", None), ("a/../b", None), ("./a", None), ("c:/x", None), ("a\tb", None), ("a ", None), ("a./b", None), ("", None), ("a b/ü", "a b/ü")])
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(S.relative_path(F.col("p"))).first()[0] == want


def test_batches_say_why_they_are_not_taken(spark):
    rows = [item("p", "ok", "a", "é\"\n"), gone("p", "ok", "b"), item("p", "many", "a"), item("p", "many", "b"), item("p", "many", "c"), item("p", "up", "../a"), item("p", "twice", "a"), gone("p", "twice", "a"),
            item("p", "long", "a", bytes=7), item("p", "digest", "a", sha256="0" * 64), item("p", "none", "a", content=None), item("p", "big", "a", "y" * 300), item(None, "alone", "a"), item("p", "upper", "a", sha256=hashlib.sha256(b"x").hexdigest().upper())]
    got = {r["batch"]: r for r in S.batches(spark.createDataFrame(rows, ITEM), 2, 300).collect()}
    assert {b: r["reason"] for b, r in got.items() if r["reason"]} == {
        "many": "too many items", "up": "path is not relative", "twice": "conflicting path", "long": "content is not as long as it says", "digest": "content does not match its digest",
        "none": "content is not as long as it says", "big": "too many bytes"}
    payload = {"snapshots": [{"bytes": 4, "content": "é\"\n", "path": "a", "sha256": hashlib.sha256("é\"\n".encode()).hexdigest()}], "tombstones": ["b"]}
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got["ok"]["payload"] == text and got["ok"]["batch_id"] == hashlib.sha256(f"p\n{text}".encode()).hexdigest()
    assert got["upper"]["batch_id"] is not None and got["many"]["payload"] is None


def delivered(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def test_a_replayed_epoch_adds_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first, write = delivered(spark, item("p", "1", "a"), item("p", "2", "b"), item("q", "3", "a"), item("p", "bad", "../x")), S.sink(root)
    write(first, 0)
    before = sorted(map(tuple, S.Store(spark, root).read().collect()))
    write(first, 0)
    write(first, 1)  # the same content again, by another name
    write(delivered(spark, item("p", "9", "a"), item("p", "10", "new"), item("p", "11", "new")), 2)
    after = S.Store(spark, root).read().collect()
    assert len(before) == 3 and sorted(tuple(r) for r in after if r["epoch"] == 0) == before
    assert [r["epoch"] for r in after if r["epoch"]] == [2] and S.Store(spark, root).epochs() == [0, 1, 2]


def test_a_lost_attempt_leaves_nothing(spark, tmp_path, monkeypatch):
    root, rows = f"file://{tmp_path}/store", delivered(spark, item("p", "1", "a"), item("p", "2", "b"))
    store = S.Store(spark, root)
    with monkeypatch.context() as m:
        m.setattr(S, "_fs", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        m.setattr(S.Store, "epochs", lambda self: [])
        with pytest.raises(OSError):
            S.sink(root)(rows, 0)
    assert store.read().count() == 0
    S.sink(root)(rows.where("batch = '2'"), 0)
    assert [r["items"] for r in store.read().collect()] == [1]


def test_stream_of_items(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    delivered(spark, item("p", "1", "a"), item("p", "1", "b"), item("p", "2", "c")).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(ITEM).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def run():
        stream.writeStream.foreachBatch(S.sink(root)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    run()
    delivered(spark, item("p", "1", "a"), item("p", "1", "b"), item("p", "3", "d")).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted((r["items"], r["epoch"]) for r in S.Store(spark, root).read().collect()) == [(1, 0), (1, 1), (2, 0)]
