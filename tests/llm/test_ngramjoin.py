import random
import re

import numpy as np
import pytest

from cairn.llm import ngramjoin
from cairn.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(texts: dict, words=5) -> dict:
    """doc_id -> (size of set, smallest doc_id reachable)."""
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i: i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    own = {d: d for d in sets}

    def find(d):
        while own[d] != d:
            d = own[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                own[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("seed", [1])
def test_join_equals_brute_force(spark, docs, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for g in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 6)):
            w = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))
            if rng.random() < 0.3:
                w = passage + w
            texts[len(texts)] = " ".join(w)
    for n in range(1, 7):  # the bounds of prefixes and of few words
        texts[len(texts)] = " ".join("abcdefg"[:n])
        texts[len(texts)] = " ".join("abcdefg"[:n]).upper()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(docs(*texts.items())).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("share", [(0.004, 0.02, 0.06), (0.04, 0.08)])
def test_large_groups(spark, docs, monkeypatch, share):
    """Tiny bounds: many files, buckets and bins, with few strays, none, and many."""
    for name, most in (("FILE_WORDS", 3000), ("FILE_TEXTS", 20), ("BUCKET_TOKENS", 500), ("BIN_TOKENS", 3000), ("SET_TOKENS", 20)):
        monkeypatch.setattr(ngramjoin, name, most)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(edited(rng, base, rng.choice(share))) for i in range(90)}
    texts |= {100 + i: " ".join(edited(rng, base[: 60 + i], 0.01)) for i in range(50)}  # sizes that reach each other step by step
    texts |= {200 + i: texts[i] for i in range(20)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(docs(*texts.items())).collect()}
    assert got == brute(texts)


def test_very_long_text(spark, docs):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    texts = {1: " ".join(long), 2: " ".join(edited(rng, long, 0.01)), 3: " ".join(long[:1000]), 4: "x" * 3_000_000, 5: "x" * 3_000_000}
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.join(docs(*texts.items())).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.join(odd).collect()), key=repr)
    assert (1, 0, 1) in got and (2, 0, 2) in got and got.count((4, 1, 4)) == 2 and (6, 4, 5) in got and (None, 2, None) in got and (8, 1, 8) in got and len(got) == 13
    assert ngramjoin.join(odd.limit(0)).count() == 0
    kept = ngramjoin.one_of_each(odd)
    assert kept.columns == odd.columns and sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([1, 2, 3, 4, 5, None, None, 7, 8, 9, 10], key=str)


def test_one_id_with_two_texts(spark, docs):
    got = sorted((r["n_shingles"], r["component_id"]) for r in ngramjoin.join(docs((1, "a b c d e f"), (1, "q r s t u v w"), (2, "a b c d e f"))).collect())
    assert got == [(2, 1), (2, 1), (3, 1)]


def test_one_of_each_goes_by_rows(spark, docs):
    a, b, near = "a b c d e f g h i j k l", "q r s t u v w", "a b c d e f g h i j k l m"
    kept = lambda *rows: sorted((r["doc_id"], r["text"]) for r in ngramjoin.one_of_each(docs(*rows)).collect())
    assert kept((1, a), (2, b), (2, a)) == [(1, a), (2, b)]
    assert kept((1, a), (1, b), (2, a)) == [(1, a), (1, b)]
    assert len(kept((1, a), (1, near), (1, a), (3, near))) == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500)]
    label = ngramjoin.forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), 600)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: label[n] for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps():
    rng = np.random.default_rng(5)
    a, b = rng.random((30, 400)) < 0.3, rng.random((20, 400)) < 0.1
    a[:, 0] = b[:, 0] = True
    ia, ta = np.nonzero(a)
    ib, tb = np.nonzero(b)
    assert (ngramjoin.overlaps(ia, ta, 30, ib, tb, 20) == a.astype(int) @ b.T.astype(int)).all()


def test_files_hold_words():
    rng = np.random.default_rng(8)
    words = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    texts = [words[rng.integers(0, 50, n)] for n in (3, 70, 1, 9)]
    got = ngramjoin.unframed(ngramjoin.framed(texts))
    assert len(got) == 4 and all((a == b).all() for a, b in zip(got, texts, strict=True))
