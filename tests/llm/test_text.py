import base64
import io
import json
import random
import zlib

import numpy as np
import pytest
import regex

from cairn.llm import bpe, langid, quality, queries, simple8b, vectext

ALPHABET = list("abcdestvrlmSTREVMLD'''    \n\t\r é12.!?#*漢字́३\x1c\x85\xa0İÉß²ºΣΑσ😀")


def texts_of(rng, n=6, k=30, more=()):
    return ["".join(rng.choices(ALPHABET + list(more), k=rng.randint(0, k))) for _ in range(rng.randint(0, n))]


def test_pretokens_and_words():
    import public_tokenizers

    rng, pattern, word = random.Random(1), regex.compile(public_tokenizers.PATTERN), regex.compile("[^\x20\x09-\x0d]+")
    for _ in range(1500):
        texts = texts_of(rng)
        joined = "".join(texts)
        cps, bounds = vectext.points(texts)
        for cut, want in ((vectext.pretokens(cps, bounds), pattern), (vectext.words(cps, bounds)[:2], word)):
            assert [joined[a:b] for a, b in zip(*map(np.ndarray.tolist, cut), strict=True)] == [x for t in texts for x in want.findall(t)]
        starts, ends, first = vectext.words(cps, bounds)
        assert np.diff(first).tolist() == [len(word.findall(t)) for t in texts]
        assert len(set(vectext.hashes(cps, starts, ends).tolist())) == len({joined[a:b] for a, b in zip(starts, ends, strict=True)})


def test_word_encoder_equals_the_library():
    rng, e = random.Random(2), simple8b.WordEncoder(queries.vocabulary(queries.TOKENIZER))
    for i in range(1500):
        texts = texts_of(rng, 5, 30, ["<|endoftext|>"] * (i % 3 == 0))
        ids, ends = e(texts, 2)
        want = [e.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_word_encoder_of_other_rules(tmp_path):
    """A tokenizer that normalizes or cuts otherwise is given whole texts."""
    with open(queries.vocabulary(queries.TOKENIZER)) as f:
        spec = json.load(f)
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    rng, e = random.Random(4), simple8b.WordEncoder(str(tmp_path / "other.json"))
    assert not e.known and simple8b.WordEncoder(queries.vocabulary(queries.TOKENIZER)).known
    for texts in ([], ["ABC abc"], *(texts_of(rng) for _ in range(20))):
        ids, ends = e(texts, 2)
        want = [e.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_simple8b_round_trips():
    rng = random.Random(3)
    for _ in range(300):
        most = rng.choice([1, 2, 1000, 1 << 16, 1 << 40, (1 << 64) - 1])
        ids = np.array([rng.randrange(most) if rng.random() < 0.8 else 0 for _ in range(rng.randint(0, 300))], np.uint64)
        words = simple8b.encode_block(ids)
        assert (simple8b.decode_block(words, len(ids)) == ids).all()
        assert len(words) <= 2 * len(ids)
    assert len(simple8b.encode_block(np.zeros(120, np.uint64))) == 2
    with pytest.raises(ValueError):
        simple8b.decode_block(simple8b.encode_block(np.arange(5, dtype=np.uint64)), 6)


def test_file_format():
    rng, f = np.random.default_rng(4), io.BytesIO()
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 3, 5000, 1, 0, 70, 2500)]
    w = simple8b.Writer(f, 1000)
    for i in range(0, len(docs), 2):
        part = docs[i: i + 2]
        w.append(list(range(i, i + len(part))), np.concatenate(part), np.cumsum([len(d) for d in part]))
    w.close()
    got = list(simple8b.read(f, len(f.getvalue())))
    assert [(d, s) for d, s, _ in got] == list(enumerate(np.cumsum([0, *map(len, docs)])[:-1].tolist()))
    assert all((a == b).all() for (_, _, a), b in zip(got, docs, strict=True))


def test_id_files_of_odd_tables(spark, odd):
    path = queries.vocabulary(queries.TOKENIZER)
    got = simple8b.round_trip(odd, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist() and got[2]["n_tokens"] == 1
    assert simple8b.round_trip(odd.limit(0), path).count() == 0


@pytest.mark.parametrize("chars", [1 << 20, 50])
def test_merges_of_odd_tables(spark, odd, chars):
    import public_tokenizers
    import tiktoken

    path = queries.vocabulary(queries.RANKS)
    with open(path, "rb") as f:
        e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    got = sorted(((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"]).decode()) for r in bpe.encode(odd, path, True, True, chars).collect()), key=repr)
    assert got == sorted(((r["doc_id"], tuple(e.encode_ordinary(r["text"] or "")), r["text"] or "") for r in odd.collect()), key=repr)
    assert bpe.encode(odd.limit(0), path).count() == 0


def brute_phrases(text, sample):
    """Greedy longest matches."""
    clean = lambda t: regex.sub(r"[^\p{L}]+", " ", t.lower()).lstrip()
    text, sample, n, i = clean(text), clean(sample), 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def brute_label(text, samples):
    """Label and score of a text by the definition."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    clean = lambda t: regex.sub(r"[^\p{L}]+", " ", t.lower()).lstrip()
    bits = {k: brute_phrases(text, v) * np.log2(max(2, len(clean(v)))) for k, v in samples.items()}
    best = min(bits, key=lambda k: (bits[k], k))
    return best, 1 / sum(2.0 ** max(-1000, bits[best] - b) for b in bits.values())


@pytest.mark.parametrize("stride", [256, 7])
def test_phrases_are_longest_matches(monkeypatch, stride):
    monkeypatch.setattr(langid, "STRIDE", stride)
    rng = random.Random(5)
    samples = {"a": "the quick brown fox jumps over the lazy dog and the cat", "b": "le renard brun saute par dessus le chien paresseux", "c": "ab" * 300}
    model = langid.Model(samples)
    for i in range(60):
        texts = ["".join(rng.choices(["ab", "abdefghinorstu  ,É"][i % 2], k=rng.randint(0, 900))) for _ in range(rng.randint(1, 5))] + ["ab" * rng.randint(0, 400)]
        got, _ = model.phrases(texts)
        assert got.tolist() == [[brute_phrases(t, samples[k]) for k in "abc"] for t in texts]
    labels, scores, gains = model.predict(["the dog", "le chien", "", "123 !!", "漢字" * 20])
    assert labels[:4] == ["a", "b", "und", "und"] and scores[2] == scores[3] == 0 and labels[4] in "abc" and gains[0] > 0 > gains[4]


def test_query_equals_brute_force(spark):
    """Labels and scores of the query itself, on a tenth of its rows' texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = langid.training_text(docs)
    assert len(samples) == 4
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    for r in [r for r in docs.collect() if len(r["text"]) < 1500][:40]:
        label, score = brute_label(r["text"], samples)
        assert got[r["doc_id"]] == (label, pytest.approx(score))


def test_languages_of_odd_tables(spark, odd):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_quality_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(d, q) for d, q in ((4, 1), (5, 1), (7, 0), (8, 0), (9, 1), (None, 1), (5, None))], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {quality.THRESHOLD}
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_quality_threshold_is_the_quantile():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 20))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > -0.8).astype(int)
    model = quality.Model(x, y)
    raw = (x - model.mean) / model.scale @ model.weights
    assert (raw < model.cut).sum() == (y == 0).sum() and ((raw >= model.cut) == y).mean() > 0.95
    assert np.isfinite(quality.features(["", " ", "a", "!!|<>", "\n\n"])).all()


def brute_features(text):
    """A text's features by plain counting."""
    one = lambda c: 1 if c.isalpha() else 4 if c.isdigit() else 8 if c in ".,;:'\"-?()’‘“”¿¡«»" else 32 if c == "\n" else 0 if c.isspace() else 16
    kinds, words, lines = [one(c) for c in text], regex.findall("[^\x20\x09-\x0d]+", text), [x for x in text.split("\n") if x]
    n, w = max(1, len(text)), max(1, len(words))
    hashed = lambda t: int(vectext.hashes(*(lambda c, b: (c, b[:-1], b[1:]))(*vectext.points([t])))[0]) >> 40
    out = [np.log1p(len(text)), kinds.count(1) / n, sum(c.isalpha() and c.isupper() for c in text) / max(1, kinds.count(1)), kinds.count(4) / n, kinds.count(8) / n, kinds.count(16) / n,
           sum(map(len, words)) / w, sum(len(x) > 20 for x in words) / w, len(set(words)) / w if words else 1.0, len(set(lines)) / max(1, len(lines)), kinds.count(32) / w, sum(any(one(c) == 16 for c in x) for x in words) / w, np.log1p(len(words))]
    by_word, by_run = np.zeros(quality.CLASSES), np.zeros(quality.CLASSES)
    for x in words:
        by_word[hashed(x) % quality.CLASSES] += 1
    for i in range(len(text) - 2):
        a, b, c = map(ord, text[i: i + 3])
        by_run[(int(vectext.mix(np.array([a | b << 21 | c << 42], np.uint64))[0]) >> 40) % quality.CLASSES] += 1
    return np.array([*out, *np.sqrt(by_word / w), *np.sqrt(by_run / max(1, len(text) - 2))])


@pytest.mark.parametrize("long", [1 << 22, 60])
def test_quality_features_equal_plain_counts(monkeypatch, long):
    monkeypatch.setattr(quality, "LONG", long)
    rng = random.Random(12)
    texts = ["", "a", "\n\n", *("".join(rng.choices(ALPHABET + [" word", "\nline", " x"], k=rng.randint(0, 200))) for _ in range(40))]
    assert quality.features(texts) == pytest.approx(np.array([brute_features(t) for t in texts]))


def test_quality_query_equals_brute_force(spark):
    """Scores of the query itself from plainly counted features, pairs and loss."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    texts, known = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = sorted((known[d], brute_features(t).astype("<f4").tobytes()) for d, t in texts.items() if known.get(d) in (0, 1) and not held(d))
    x, y = np.array([np.frombuffer(r[1], "<f4") for r in rows], np.float64), np.array([r[0] for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    scale[len(quality.SHAPE):] /= quality.HASHED
    z, good, bad = (x - mean) / scale, np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    model = quality.learn(docs, labels)
    most = max(quality.PAIRS * min(len(good), len(bad)), len(good), len(bad))
    pairs = [(good[i % len(good)], bad[(i + i // max(len(good), len(bad)) * 7919) % len(bad)]) for i in range(most)]
    d = np.array([z[a] - z[b] for a, b in pairs])
    grad = quality.RIDGE * model.weights - (d / (1 + np.exp(np.clip(d @ model.weights, -50, 50)))[:, None]).mean(axis=0)
    assert np.abs(grad).max() < 1e-6
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    for doc, t in list(texts.items())[:50]:
        raw = (brute_features(t) - mean) / scale @ model.weights - model.cut
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-np.clip(raw + np.log(0.7 / 0.3), -500, 500))), abs=1e-4)


def test_quality_ties(spark, docs):
    """Documents that nothing tells apart score alike, and alike the threshold."""
    same = docs(*((i, "one text") for i in range(8)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    assert len({r["score"] for r in quality.classify(same, labels).collect()}) == 1


def test_very_long_texts_in_pieces(monkeypatch):
    """Small pieces give what whole texts give."""
    from cairn.llm import ngramjoin

    rng = random.Random(9)
    text = "".join(rng.choices(ALPHABET + [" word", " It's", "  "], k=4000))
    assert "".join(vectext.pieces(text, 100)) == text and len(list(vectext.pieces(text, 100))) > 10 and list(vectext.pieces("x" * 500, 100)) == ["x" * 500]
    e = simple8b.WordEncoder(queries.vocabulary(queries.TOKENIZER))
    want_ids, want_set = e([text], 2)[0].tolist(), ngramjoin.shingle_sets([text])[0].tolist()
    whole = bpe.Block()
    whole.add([1], [text])
    parts = bpe.Block()
    monkeypatch.setattr(vectext, "PIECE_CHARS", 200)
    monkeypatch.setattr(bpe, "PART_CHARS", 100)
    parts.add_long(1, text)
    assert e([text], 2)[0].tolist() == want_ids and ngramjoin.shingle_sets([text])[0].tolist() == want_set
    show = lambda b: [b.words[i] for i in np.concatenate(b.parts).tolist()]
    assert show(parts) == show(whole) and np.concatenate(parts.lens).tolist() == np.concatenate(whole.lens).tolist() and parts.keys == [1]


def test_quality_learns_from_all_rows(spark, monkeypatch):
    """Moments, weights and threshold of a table of several blocks, one label rare, against all rows at once."""
    monkeypatch.setattr(quality, "ROWS", 60)
    monkeypatch.setattr(quality, "LEAST", 20)
    monkeypatch.setattr(quality, "BLOCK", 100)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["fine", "words", "here", "today", "and", "then"] if i % 12 else ["$$", "BUY", "and", "here"], k=rng.randint(3, 30))) for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 12 > 0) if i % 17 else 1 - int(i % 12 > 0)) for i in range(700)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    rows = [(r["quality"], texts[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    x, y = quality.features([t for _, t in rows]).astype("<f4").astype(np.float64), np.array([q for q, _ in rows])
    scale = np.maximum(x.std(axis=0), 1e-3)
    scale[len(quality.SHAPE):] /= quality.HASHED
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(scale, rel=1e-5)
    raw = np.sort((x - model.mean) / model.scale @ model.weights)
    k = int((y == 0).sum())
    assert model.cut == pytest.approx((raw[k - 1] + raw[k]) / 2, abs=1e-9)
    seen = []
    monkeypatch.setattr(quality, "refine", lambda m, blocks, counts: seen.append([(len(r["y"]), sum(r["own"])) for r in blocks.collect()]) or m)
    quality.learn(docs, labels)
    assert sum(own for _, own in seen[0]) == len(rows) and len(seen[0]) > 3
