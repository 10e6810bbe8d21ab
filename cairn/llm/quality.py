"""Quality scores learned from preference pairs (Bradley-Terry).

Each pair has a document of label 1 and one of label 0; weights minimise the logistic
loss of the difference of their features, which are the shape of a text and the hashed frequencies
of its words and runs of three characters. The score's threshold is the quantile of the
learned scores that the share of label 0 names; scores are then mapped so that this
quantile is THRESHOLD. Means, scales, weights and threshold come from all labelled rows that
aren't held out; a bounded choice of them only gives the weights that Newton's method starts from.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .langid import held_out
from .shared import drop, materialise
from .workers import releasing, releasing_group

THRESHOLD = 0.7
#: Labelled rows that starting weights are learned from, and pairs for each row of the smaller class.
ROWS, PAIRS = 8_000, 40
#: Rows of a label that are expected at least in the sample, if it has so many.
LEAST = 400
#: Rows of a block of training rows, whose pairs are made inside it, and tasks that add up blocks.
BLOCK, TASKS = 2_048, 16
RIDGE = 1e-2
#: Texts beyond this many code points are counted in pieces; the counts add up to those of the whole.
LONG = 1 << 22
#: Frequencies of words and of runs of three characters go to so many classes each, by hash.
CLASSES = 256
#: Part of a unit of spread that classes get, so that the many of them don't outweigh the shape.
HASHED = 0.3
SHAPE = ("log_chars", "letters", "upper", "digits", "marks", "symbols", "word_len", "long_words", "distinct_words", "distinct_lines", "line_ends", "mark_words", "word_bulk")
WIDTH = len(SHAPE) + 2 * CLASSES

_TRAITS: np.ndarray | None = None


def traits() -> np.ndarray:
    """Bits of each code point: 1 letter, 2 upper case, 4 digit, 8 usual mark, 16 other symbol, 32 line end."""
    global _TRAITS
    if _TRAITS is None:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = 1 | 2 * s.isupper()
            elif s.isdigit():
                table[c] = 4
            elif s in ".,;:'\"-?()" or s in "’‘“”¿¡«»":
                table[c] = 8
            elif s == "\n":
                table[c] = 32
            elif not s.isspace():
                table[c] = 16
        _TRAITS = table
    return _TRAITS


class Counts:
    """What is counted of a block of texts: sums, hashes of distinct words and lines, and words and runs of characters by class."""

    SUMS = ("chars", "letters", "upper", "digits", "marks", "symbols", "words", "word_chars", "long_words", "lines", "line_ends", "mark_words", "runs")

    def __init__(self, texts: list[str]):
        cps, bounds = vectext.points(texts)
        kind, m = traits()[cps], len(texts)

        def count(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])

        starts, ends, first = vectext.words(cps, bounds)
        n_words = np.diff(first)
        owner, size = np.repeat(np.arange(m), n_words), ends - starts
        line_at, line_to = vectext.spans(kind != 32, bounds)
        lines = np.repeat(np.arange(m), np.diff(np.searchsorted(line_at, bounds)))
        odd = np.concatenate(([0], np.cumsum(kind == 16)))
        per_text = lambda own, weights=None: np.bincount(own, weights=weights, minlength=m)
        n = np.diff(bounds)
        self.sums = np.column_stack([
            n, count(kind & 1 > 0), count(kind & 2 > 0), count(kind == 4), count(kind == 8), count(kind == 16), n_words, per_text(owner, size), per_text(owner, size > 20),
            per_text(lines), count(kind == 32), per_text(owner, odd[ends] - odd[starts] > 0), np.maximum(n - 2, 0)]).astype(np.float64)
        words = vectext.hashes(cps, starts, ends)
        self.words, self.lines = (owner, words), (lines, vectext.hashes(cps, line_at, line_to))
        self.word_classes = np.bincount(owner * CLASSES + (words >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=m * CLASSES).reshape(m, CLASSES)
        # runs of three characters that no text's end cuts
        x = cps.astype(np.uint64)
        run = vectext.mix(x[:-2] | x[1:-1] << np.uint64(21) | x[2:] << np.uint64(42)) if len(x) > 2 else np.empty(0, np.uint64)
        text = np.repeat(np.arange(m), n)
        whole = text[:-2] == text[2:] if len(x) > 2 else np.empty(0, bool)
        self.run_classes = np.bincount(text[:-2][whole] * CLASSES + (run[whole] >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=m * CLASSES).reshape(m, CLASSES)

    def distinct(self, which: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own, hashed = which
        at = np.unique(hashed ^ vectext.mix(own.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
        return np.bincount(own[at], minlength=len(self.sums))

    @classmethod
    def of_pieces(cls, text: str) -> "Counts":
        """The counts of one text, piece by piece: no word is cut, and runs of characters over a cut are counted with its first part."""
        out, at, words = None, 0, np.empty(0, np.uint64)
        for piece in vectext.pieces(text, LONG // 2):
            part = cls([piece])
            seam = cls([text[max(0, at - 2): at] + piece[:2]]) if at else None
            at += len(piece)
            words = np.unique(np.concatenate((words, part.words[1])))
            if out is None:
                out = part
                continue
            out.sums += part.sums
            out.word_classes = out.word_classes + part.word_classes
            out.run_classes = out.run_classes + part.run_classes + seam.run_classes
        rows = [x for x in text.split("\n") if x]
        out.sums[0, cls.SUMS.index("lines")] = len(rows)
        out.sums[0, cls.SUMS.index("runs")] = max(0, len(text) - 2)
        out.words = np.zeros(len(words), np.int64), words
        own = np.array([hash(x) for x in set(rows)], np.int64).view(np.uint64)
        out.lines = np.zeros(len(own), np.int64), own
        return out

    def features(self) -> np.ndarray:
        s = dict(zip(self.SUMS, self.sums.T, strict=True))
        chars, words, lines = np.maximum(s["chars"], 1), np.maximum(s["words"], 1), np.maximum(s["lines"], 1)
        shape = [np.log1p(s["chars"]), s["letters"] / chars, s["upper"] / np.maximum(s["letters"], 1), s["digits"] / chars, s["marks"] / chars, s["symbols"] / chars,
                 s["word_chars"] / words, s["long_words"] / words, np.where(s["words"] > 0, self.distinct(self.words) / words, 1.0), self.distinct(self.lines) / lines,
                 s["line_ends"] / words, s["mark_words"] / words, np.log1p(s["words"])]
        return np.column_stack([*shape, np.sqrt(self.word_classes / words[:, None]), np.sqrt(self.run_classes / np.maximum(s["runs"], 1)[:, None])])


def features(texts: list[str]) -> np.ndarray:
    """WIDTH numbers for each text: its SHAPE, then the square roots of the frequencies of words and of runs of characters by class. All are finite, for empty texts too."""
    parts, short = [], []
    for t in texts:
        if len(t) > LONG:
            parts += [Counts(short).features()] * bool(short) + [Counts.of_pieces(t).features()]
            short = []
        else:
            short.append(t)
    return np.concatenate([*parts, Counts(short).features()] if short or not parts else parts)


def fitted(z: np.ndarray, a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    """Weights that minimise the mean logistic loss of z[a] - z[b] with a ridge: Newton's method, each step by conjugate gradients."""
    n, w = len(z), np.zeros(z.shape[1])
    spread = lambda r: z.T @ (np.bincount(a, r, n) - np.bincount(b, r, n)) / len(a)
    for _ in range(30):
        m = z @ w
        p = 1 / (1 + np.exp(np.clip(m[a] - m[b], -50, 50)))
        grad, q = ridge * w - spread(p), p * (1 - p)

        def curved(v, q=q):
            m = z @ v
            return spread(q * (m[a] - m[b])) + ridge * v

        step, r = np.zeros_like(w), -grad
        d, rr = r.copy(), r @ r
        stop = rr * 1e-10
        for _ in range(200):
            if rr <= stop or rr < 1e-24:
                break
            h = curved(d)
            alpha = rr / (d @ h)
            step += alpha * d
            r -= alpha * h
            rr, before = r @ r, rr
            d = r + rr / before * d
        w = w + step
        if np.abs(step).max(initial=0) < 1e-7:
            break
    return w


def paired(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of label 1 and of label 0 that make pairs: every row of either class in turn, the partners shifted at each turn."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    pick = np.arange(max(PAIRS * min(len(good), len(bad)), len(good), len(bad)))
    return good[pick % len(good)], bad[(pick + pick // max(len(good), len(bad)) * 7919) % len(bad)]


class Model:
    """Weights, means and scales of the features, and the threshold; without both labels every text gets THRESHOLD.

    ``mass`` is how many labelled rows each row stands for: the threshold is the quantile over those.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, mass: np.ndarray | None = None):
        self.weights = None
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        self.scale[len(SHAPE):] /= HASHED
        z = (x - self.mean) / self.scale
        w = fitted(z, *paired(y), RIDGE)
        self.weights = w
        mass = np.ones(len(y)) if mass is None else mass
        raw = z @ w
        order = np.argsort(raw, kind="stable")
        raw, below = raw[order], np.cumsum(mass[order])
        cut = min(len(raw) - 1, int(np.searchsorted(below, mass[bad].sum() * (1 - 1e-12))))
        self.cut = float((raw[cut] + raw[min(len(raw) - 1, cut + 1)]) / 2)

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1; THRESHOLD at the cut."""
        if self.weights is None:
            return np.full(len(texts), THRESHOLD)
        raw = (features(texts) - self.mean) / self.scale @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(raw + math.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))


def _featured(rows: DataFrame, kept: str, types: str) -> DataFrame:
    """Columns ``kept`` (named in ``types``, all of them int) of ``rows`` with the features of their text as x."""
    import pyarrow as pa

    names = kept.split()

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                for first, part in vectext.blocks(batch.column("text").to_pylist()):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(part)).cast(pa.int32()) for c in names), pa.array([r.tobytes() for r in features(part).astype("<f4")], pa.binary())], names=[*names, "x"])

    return rows.select(*names, "text").mapInArrow(releasing(run), f"{types}, x binary")


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Training rows in blocks of about BLOCK: (y, own, x), bytes of their labels, of whether a row is at home there, and of their features.

    A row's block follows from its id. Rows of a label too rare to give LEAST to each block are copied to as many as it takes; where they are not at home they make pairs only.
    """
    import pyarrow as pa

    n = -(-sum(counts.values()) // BLOCK)
    copies = {label: min(n, -(-min(LEAST, BLOCK // 2) * n // k)) for label, k in counts.items()}
    times = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(copies.items()) for x in pair]), F.col("y"))
    home = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    found = _featured(rows.select(F.col("quality").cast("int").alias("y"), home.alias("home"), "text"), "y home", "y int, home int")
    dealt = found.select("y", "x", "home", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy")).select("y", "x", (F.col("copy") == 0).cast("int").alias("own"), F.pmod(F.col("home") + F.col("copy"), F.lit(n)).alias("block"))

    def one(table):
        got = sorted(zip(table.column("y").to_pylist(), table.column("x").to_pylist(), table.column("own").to_pylist(), strict=True))
        return pa.table({"y": [bytes(r[0] for r in got)], "own": [bytes(r[2] for r in got)], "x": [b"".join(r[1] for r in got)]})

    return materialise(dealt.groupBy("block").applyInArrow(releasing_group(one), "y binary, own binary, x binary"), "quality-blocks")


def _summed(blocks: DataFrame, of) -> list[np.ndarray]:
    """Sums over all blocks of the arrays that ``of`` (y, own, x) gives, of symmetric matrices the upper half; TASKS sums come to the driver, however many blocks there are."""
    def run(rows):
        total = None
        for r in rows:
            got = of(np.frombuffer(bytes(r["y"]), np.uint8), np.frombuffer(bytes(r["own"]), np.uint8) > 0, np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, WIDTH).astype(np.float64))
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        # half of a symmetric matrix, in single precision, is enough for a step
        return [] if total is None else [[np.asarray(a, np.float64) if np.ndim(a) < 2 else a[np.triu_indices(len(a))].astype("<f4") for a in total]]

    return [sum(a) for a in zip(*blocks.rdd.coalesce(TASKS).mapPartitions(run).collect(), strict=True)]


def _ranked(values: DataFrame, rank: int) -> float:
    """The value of ``values`` (v) of that rank, from 0: its range is cut in 1,024 until one value is left."""
    within = values
    while True:
        lo, hi = within.agg(F.min("v"), F.max("v")).first()
        if lo == hi:
            return lo
        bins = within.groupBy(F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * 1024), F.lit(1023)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for b in sorted(bins.collect()):
            if rank < b["n"]:
                break
            rank -= b["n"]
        if b["lo"] == b["hi"]:
            return b["lo"]
        within = values.where((F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))


def refine(model: Model, blocks: DataFrame, counts: dict[int, int]) -> Model:
    """``model`` with means, scales, weights and threshold of all rows of ``blocks``: Newton's method from its weights, each step from sums over all blocks."""
    spark = blocks.sparkSession
    n, sums, squares = _summed(blocks, lambda y, own, x: [own.sum(), x[own].sum(axis=0), (x[own] ** 2).sum(axis=0)])
    raw = model.weights / model.scale
    mean = sums / n
    scale = np.maximum(np.sqrt(np.maximum(squares / n - mean ** 2, 0)), 1e-3)
    scale[len(SHAPE):] /= HASHED
    w = raw * scale
    for _ in range(30):
        def part(y, own, x, w=w):
            z, (a, b) = (x - mean) / scale, paired(y)
            m, k = z @ w, len(y)
            p = 1 / (1 + np.exp(np.clip(m[a] - m[b], -50, 50)))
            q = p * (1 - p)
            good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            ties = np.bincount(np.searchsorted(good, a) * len(bad) + np.searchsorted(bad, b), q, len(good) * len(bad)).reshape(len(good), len(bad))
            cross = z[good].T @ (ties @ z[bad])
            return [len(a), z.T @ (np.bincount(a, p, k) - np.bincount(b, p, k)), z.T @ (z * (np.bincount(a, q, k) + np.bincount(b, q, k))[:, None]) - cross - cross.T]

        pairs, slope, half = _summed(blocks, part)
        curve = np.zeros((WIDTH, WIDTH))
        curve[np.triu_indices(WIDTH)] = half
        curve += np.triu(curve, 1).T
        step = np.linalg.solve(curve / pairs + RIDGE * np.eye(WIDTH), slope / pairs - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break

    def scores(rows):
        for r in rows:
            x, own = np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, WIDTH).astype(np.float64), np.frombuffer(bytes(r["own"]), np.uint8) > 0
            yield from ((float(v),) for v in ((x - mean) / scale @ w)[own])

    values = materialise(spark.createDataFrame(blocks.rdd.mapPartitions(scores), "v double"), "quality-scores")
    cut = min(int(n) - 1, counts[0] - 1)
    model.mean, model.scale, model.weights = mean, scale, w
    model.cut = (_ranked(values, cut) + _ranked(values, min(int(n) - 1, cut + 1))) / 2
    drop(spark, values)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all rows of ``docs`` that aren't held out and have a label 0 or 1.

    About ROWS of them, chosen by a hash of doc_id, give a first model; a label of which fewer than LEAST rows would come has a higher rate of its own.
    If there are more, all of them are then learned from in blocks (refine). Rows of one doc_id go together.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"), "quality")
    counts = {r["quality"]: r["n"] for r in docs.select("doc_id").join(known, F.col("doc_id") == F.col("labelled")).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if not n:
        return Model(np.zeros((0, WIDTH)), np.zeros(0))
    rates = {label: math.ceil((1 << 20) * min(1.0, max(ROWS / n, LEAST / k))) for label, k in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair]), F.col("quality"))
    chosen = known.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 20)) < limit).join(docs.select("doc_id"), F.col("labelled") == F.col("doc_id"), "left_semi")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select(F.col("quality").alias("y"), "text")
    got = sorted(map(tuple, _featured(rows, "y", "y int").collect()))
    model = Model(np.frombuffer(b"".join(r[1] for r in got), "<f4").reshape(-1, WIDTH).astype(np.float64), np.array([r[0] for r in got]), np.array([(1 << 20) / rates[r[0]] for r in got]))
    if all(r == 1 << 20 for r in rates.values()) or model.weights is None:
        return model
    # ids of any number of labels: never sent whole to each task, so this join costs alike at any size
    blocks = _blocks(texts.where(~held_out(F.col("doc_id"))).join(known.hint("merge"), F.col("doc_id") == F.col("labelled")), counts)
    model = refine(model, blocks, counts)
    drop(docs.sparkSession, blocks)
    return model


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the score as column ``name`` (replacing one of this name).

    Null texts are empty texts; equal texts, repeated rows included, score alike; an empty table gives an empty result.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    shape = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                got = [model.score(part) for _, part in vectext.blocks(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(releasing(run), shape)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= THRESHOLD) of every document.

    Repeated rows give a row each; a null doc_id is held out, a null text is an empty one; without labels of both kinds every text
    scores THRESHOLD; an empty table gives an empty result; other columns play no part.
    """
    found = score(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
                        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
