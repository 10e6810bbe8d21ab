import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing, sharding, spotsigs, topk, warc


def jump(key: int, n: int) -> int:
    b, j, key = -1, 0, key % (1 << 64)
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 9, 100])
def test_jump_hash(spark, n):
    keys = [0, 1, 2, -1, (1 << 63) - 1, -(1 << 63), *(random.Random(1).randrange(-(1 << 63), 1 << 63) for _ in range(300))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r["s"] == jump(r["k"], n) for r in got)


def test_shards(spark, odd):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == 13 and all(r["grown_shard"] in (r["shard"], 3) for r in got)
    for s in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["size"] == 1 and one["text_crc32"] == 0
    assert sharding.shard(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_hash(F.lit(1), 0)


def test_mixing_takes_what_it_should(spark, docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(2000)]
    got = mixing.mix(docs(*rows)).collect()
    total = sum(r["size"] for r in got)
    source = {r[0]: r[2] for r in rows}
    taken, target, size = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
        assert r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * total) and all(target[s] <= 2 * size[s] for s in size)
    assert all(abs(taken[s] - target[s]) <= 60 for s in taken)
    assert sorted(map(tuple, mixing.mix(docs(*reversed(rows))).collect())) == sorted(map(tuple, got))


def test_mixing_odd_tables(spark, odd, docs):
    assert mixing.mix(odd).count() == 13
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.emit(odd).columns == odd.columns
    empty = mixing.mix(docs((1, None, "a"), (2, "", None))).collect()
    assert {(r["size"], r["target"], r["copies"]) for r in empty} == {(0, 0.0, 0)}


def test_mixing_repeated_ids(spark, docs):
    """Rows that share an id but not a text are taken alike on every run, whatever their order."""
    rows = [(i // 3, f"w{i} " * (1 + i % 2), "ab"[i % 2]) for i in range(300)] + [(None, f"n{i}", "a") for i in range(50)]
    taken = [sorted(map(str, (r["text"] for r in mixing.emit(docs(*some)).collect()))) for some in (rows, rows[::-1])]
    assert taken[0] == taken[1]


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got == {"a": 200.0, "b": pytest.approx(5900 / 3), "c": pytest.approx(2950 / 3)}


def spot(text):
    """Signatures by a loop."""
    import re

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out = set()
    anchors = [i for i, w in enumerate(words) if w in spotsigs.ANCHORS]
    for n, i in enumerate(anchors):
        end = anchors[n + spotsigs.REACH + 1] if n + spotsigs.REACH + 1 < len(anchors) else len(words)
        chain = [w for w in words[i + 1: end] if w not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        out.add(f"{words[i]}:" + " ".join(chain) + (" " if len(chain) == 1 else ""))
    if not anchors and text:
        out = {" ".join(words) + " " if words else text}
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in out})


def test_signatures(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "der", "la", "word", "other", "Große", "x9y", "é", "…", "12"]
    texts = ["", "123", "nothing common", "the", None, *(" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(60))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spotsigs.signatures(F.col("t")).alias("s")).collect()
    assert all(r["s"] == spot(r["t"]) for r in got)


def test_fingerprints(spark, docs, odd):
    rows = [(i, f"the word{i} of thing{i} and a tail{i} " * (i % 5 + 1)) for i in range(40)] + [(50, "the word3 of thing3 and a tail3 " * 4)]
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(docs(*rows)).collect()}
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    for at, d in enumerate(order):
        nxt = texts[order[(at + 1) % len(order)]]
        k = len(texts[d]) // 3
        assert got[d]["edited_sha256"] == hashlib.sha256((texts[d][: len(texts[d]) - k] + nxt[:k]).encode()).hexdigest()
        a, b = set(spot(texts[d])), set(spot(nxt))
        assert got[d]["near_next"] == pytest.approx(len(a & b) / len(a | b))
    assert got[50]["fingerprint"] == got[3]["fingerprint"]
    odd_rows = spotsigs.fingerprints(odd).collect()
    assert len(odd_rows) == 13 and all(0 <= r["near_edited"] <= 1 for r in odd_rows)
    assert spotsigs.fingerprints(odd.limit(0)).count() == 0


def test_ranges_give_the_same_successors(spark, docs, monkeypatch):
    rows = [(i * 7 % 501, f"the text {i}") for i in range(501)]
    want = sorted(map(tuple, spotsigs.with_next(docs(*rows)).select("doc_id", "next_text").collect()))
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 40)
    assert sorted(map(tuple, spotsigs.with_next(docs(*rows)).select("doc_id", "next_text").collect())) == want


def brute_top(vectors, k=10, every=100):
    clean = {i: [int(np.floor(float(np.float32(x)) * 1024)) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in clean.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in clean.items() if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_top_k(spark, scale):
    rng = np.random.default_rng(7)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * scale]) for i in range(600)]
    vectors += [(700, vectors[5][1]), (701, vectors[5][1]), (800, None), (801, [None, *[1.0] * 7]), (802, [float("nan")] * 8), (900, [float("inf")] * 8), (1000, [1.0, 2.0]), (1001, [0.5, 0.5]), (1100, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS id", "1 AS rank")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, shard_rows=150, query_block=3).collect())
    assert got == brute_top(vectors)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_odd_rows(spark):
    """Repeated ids, empty vectors, a very long one, ties, and scores that no long holds."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (5, [1.0, 1.0]), (100, []), (101, []), (200, [1.0] * 5000), (201, [0.5] * 5000), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, k=3, shard_rows=2).collect())
    m = 1024 * 1024
    assert got == [(0, 1, 5, 3 * m), (0, 2, 7, 3 * m), (0, 3, 7, 3 * m), (100, 1, 101, 0), (200, 1, 201, 2500 * m)]
    big = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9 - 1 / 1024]), (2, [1e9 - 1 / 1024, 1e9]), (3, [1e12, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(big).orderBy("rank").collect()]
    assert got == [(n, i, (1 << 63) - 1) for n, i in ((1, 3), (2, 1), (3, 2))]


def test_balls_hold_their_points():
    x = np.random.default_rng(8).normal(size=(500, 6)).round(1)
    x[:50] = x[0]
    t = topk.BallTree(x, 16)
    for (a, b), c, r in zip(t.span, t.centres, t.radii, strict=True):
        assert np.sqrt(((x[t.order[a:b]] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
    assert sorted(t.order.tolist()) == list(range(500))


def test_archives(spark):
    rows = [(5, "http://a/x", "<p>WARC/1.1\r\nContent-Length: 3</p>"), (3, "http://a/y?q=1", "same"), (9, None, "same"), (1, "http://é/", None), (2, "bad\r\nurl", ""), (None, "u", "same"), (7, "http://z", "é" * 50_000), (7, "http://z", "é" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS nth", "2 AS first")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(5, 34, "response", None), (3, 4, "response", None), (9, 4, "revisit", 3), (1, 0, "response", None), (2, 0, "revisit", 1), (None, 4, "revisit", 3), *[(7, 100_000, "response", None)] * 2], key=repr)
    assert {r["record_type"] for r in warc.round_trip(pages, min_bytes=1 << 20).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_long_payload_over_a_roll(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 1 << 10)
    rows = [(i, f"http://h/{i}", ("x%d" % i) * n) for i, n in enumerate((1, 3_000_000, 10, 2000, 5))]
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect())
    assert got == [(i, len(h), "response") for i, _, h in rows]


def test_records_are_members_and_checked():
    row = {"page_id": 1, "url": "http://h/p?q", "html": "body", "digest": hashlib.sha1(b"body").hexdigest(), "nth": 1, "first_id": 1, "first_url": "http://h/p?q", "revisit": False}
    parts = warc.capture(row)
    assert all(gzip.decompress(p).startswith(b"WARC/1.1\r\n") for p in parts)
    found = list(warc.parse(io.BytesIO(b"".join(map(gzip.decompress, parts)))))
    assert [h["warc-type"][0] for h, _ in found] == ["request", "response", "metadata"]
    assert found[0][0]["warc-concurrent-to"] == found[2][0]["warc-concurrent-to"] == found[1][0]["warc-record-id"]
    with pytest.raises(ValueError, match="digest"):
        warc._row(found[1][0], found[1][1] + b"!", False)
    with pytest.raises(ValueError, match="short"):
        list(warc.parse(io.BytesIO(gzip.decompress(parts[1])[:-9])))


def test_assembly_leaves_out_strays(spark):
    rows = [("response", "r1", [], None, "u", "d", 1, None, ""), ("request", "q1", ["r1"], None, "u", None, None, None, "GET"), ("metadata", "m1", ["r1", "r2"], None, "u", None, None, 4, None), ("request", "q9", ["gone"], None, "u", None, None, None, "GET"),
            ("revisit", "r2", [], "r1", "u", "d", 1, None, ""), ("revisit", "r3", [], "lost", "u", "d", 1, None, "")]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert set(got) == {"r1", "r2", "r3"} and got["r1"]["request"]["http"] == "GET" and got["r2"]["refers_to_page"] == 4 and got["r3"]["refers_to_page"] is None and got["r3"]["metadata"] is None
