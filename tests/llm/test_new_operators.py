"""Spelling variants, the filter audit and repeated passages against their meaning."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from cairn.llm import filteraudit, spelling, substrings, vectext

RUN = re.compile("[A-Za-zÀ-ÿ]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def spelled(rows, typo=199):
    counts = Counter()
    for d, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if len(w) >= 6 and h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = [form, None, n[w], len(others), n.get(form)]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def grouped(df, **how):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group(df, **how).collect()}


def test_spelling_equals_brute_force(spark, docs):
    rng = random.Random(3)
    base = ["aaaaaa", "aaaaaaa", "aaaaab", "abcabc", "éclairs", "Éclairs", "eclairs", "zÿÿÿÿÿ", "straße", "façade", "facade", "letters", "lettters", "leters", "× ÷×÷×÷×"]
    rows = []
    for d in range(400):
        words = [w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, [500 // (k + 1) ** 2 + 2 for k in range(len(base))], k=30)]
        words += ["letter" + rng.choice("sxyz") * rng.randint(0, 2)] * rng.randint(0, 3)
        rows.append((d if d % 50 else None, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    rows += [(7, "lettery " * 40 + "letterz " * 8), (8, None), (9, ""), (10, "y" * 70_000 + " ")] + [(11, "x" * 5000 + " " + "x" * 5001)] * 5 + [(12, "x" * 2500 + "y" + "x" * 2499)] * 30
    for typo in (199, 3):
        assert grouped(docs(*rows), typo=typo) == spelled(rows, typo)


def test_spelling_chain_and_ties(docs):
    rows = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdhg " * 125 + "abixhg " * 200 + "ghijkl " * 5 + "ghijkm " * 25 + "ghijkn " * 25)]
    got = grouped(docs(*rows), typo=1 << 40)
    assert got["abcdef"] == ("abcdeg", "abcdhg", 5, 1, 25) and got["abcdeg"][:2] == ("abcdhg", "abcdhg") and got["abcdhg"] == (None, "abcdhg", 125, 1, None)
    assert got["ghijkl"] == ("ghijkm", "ghijkm", 5, 2, 25)


def test_spelling_odd_tables(odd):
    assert "xxxxxx" not in grouped(odd) and grouped(odd.limit(0)) == {}
    with pytest.raises(ValueError):
        spelling.group(odd, ratio=2)


def failing(rows):
    out = []
    for d, text, source in rows:
        text = text or ""
        w = WORDS.findall(text)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows) else set()
        out.append((d, source or "", fails))
    return out


def audited(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    each, out = failing(rows), {}
    for part in {p for _, p, _ in each}:
        own = [(d, f) for d, p, f in each if p == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                removed_by[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own),
                                                   sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_by[x])
    return out


def test_audit_equals_running_every_order(spark, docs):
    rng = random.Random(5)
    texts = ["", None, "short text", "a b " * 150, "A B C " * 100, " ".join(map(str, range(300))), " ".join(map(str, range(250))) + " 5%", "ÀÉ " * 10, "SHOUT " * 3 + "|"]
    rows = [(rng.choice([None, *range(80)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(80)]
    got = filteraudit.audit(docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = audited(rows, labels)
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got.collect()} == want and len(want) == 3 * 600


def test_audit_odd_tables(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filteraudit.audit(odd, labels).collect()
    assert len(got) == 600 and {r["good_lost"] for r in got} == {0}
    # of the texts that repeat only the larger id's fails: null and empty are one text, and rows of one id are all first
    assert {r["removed"] for r in got if r["step"] == 1 and r["filter_order"][0] == "E"} == {2}
    assert filteraudit.audit(odd.limit(0), labels).count() == 0


def deduped(rows, window):
    """(words, removed words, hash of the kept ones) by looking at every window; rows are in order."""
    seen, out = set(), []
    for _, text in rows:
        w = WORDS.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i: i + window])
            if x in seen:
                gone |= set(range(i, i + window))
            seen.add(x)
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [1, 3, 8, 20])
def test_repeats_equal_brute_force(docs, window):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(300):
        w = rng.choices("a b c d e é 漢".split(), [9, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 60)) if d % 3 else []
        a, b = sorted(rng.choices(range(61), k=2))
        w += passage[a:b] if d % 2 else [str(rng.random()) for _ in range(30)]
        w += ["same"] * rng.choice([0, 0, 0, 70])
        rows.append((d * 7 - 500, rng.choice([" ", "\n\t "]).join(w)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(docs(*rows[::-1]), window).collect()}
    assert [got[d] for d, _ in rows] == deduped(rows, window)


def test_repeats_give_texts_and_spans(docs):
    first = " ".join(f"w{i}" for i in range(40))
    rows = [(1, first), (2, "x y " + first + " z"), (3, " ".join(first.split()[5:24]))]
    got = {r["doc_id"]: r for r in substrings.dedup(docs(*rows), texts=True).collect()}
    assert got[1]["kept"] == first and got[1]["spans"] == [] and got[3]["n_removed"] == 0
    assert got[2]["kept"] == "x y z" and [tuple(s) for s in got[2]["spans"]] == [(2, 42)]


def test_repeats_odd_tables(odd, docs):
    got = substrings.dedup(odd).collect()
    assert len(got) == 13 and {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    same = [r for r in got if r["doc_id"] == 8]
    assert same[0]["n_words"] == 30_000 and same[0]["n_removed"] == 29_999
    assert substrings.dedup(odd.limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    listed_twice = substrings.dedup(docs((4, text), (4, text), (None, text + " more"), (9, "other " + text))).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in listed_twice} == {(4, 0), (9, 30), (None, 30)}


def test_parts_of_long_texts_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(vectext, "PIECE_CHARS", 300)
    monkeypatch.setattr(vectext, "BLOCK_CHARS", 50)
    rng = random.Random(1)
    text = " ".join("ab"[: rng.randint(1, 2)] * rng.randint(1, 30) for _ in range(500))
    words = text.split()
    found = []
    for of, s in substrings._sampled(["short one", text], 20, 6):
        before = np.array([b for _, b in of])[s.part()]
        assert {of[k][0] for k in s.part()} <= {1}
        for a, b, skip, part in zip(s.first, s.last, before, s.part(), strict=True):
            found += [int(skip + x - s.bounds[part]) for x in range(a, b + 1)]
            assert s.text[s.starts[a]: s.ends[b + 19]].split() == words[skip + a - s.bounds[part]: skip + b + 20 - s.bounds[part]]
    assert sorted(found) == list(range(len(words) - 19))
