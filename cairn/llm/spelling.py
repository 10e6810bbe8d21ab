"""Grouping of spelling variants by full neighbourhood generation.

Of every word of the vocabulary all distinct deletions, replacements and insertions over the observed alphabet are
made, and those that are words are found by a hash join with the vocabulary; as each string one edit away is made
once and no other, distances are never checked.

The neighbourhood of a word has some 2 * length * alphabet members, nearly all of which hold four letters in
a row that no word holds. A bitmap of the observed groups of four, whose size the alphabet of 90 letters bounds (8.6 MB),
drops these where they are made. Those left are named by 128 bits, which follow from the word's
prefix sums in constant time, so long words cost no more for each neighbour than short ones.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext
from .shared import drop, materialise
from .workers import releasing, releasing_group

RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols: 0 for a word's edge, 26 letters, the 64 code points from U+00C0 on.
SYMBOLS = 91
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0xC0:0x100] = np.arange(27, 91)
GRAM = 4
#: Letters of words that are worked on at once, and places whose neighbours are made at once.
CHUNK_LETTERS, CHUNK_PLACES = 1 << 17, 1 << 16
#: For each half of a name: multiplier of a place, its inverse modulo 2^64, and numbers of the symbols.
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_RATES = [(np.uint64(b), np.uint64(pow(b, -1, 1 << 64)), vectext.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(b ^ 0x5851F42D4C957F2D))) for b in _BASES]
#: A form is at least 5 times as frequent and counts are below 2^63, so a chain has under 28 steps, and 5 doublings end it.
ROUNDS = 5


def occurrences(docs: DataFrame, typo: int = 199, least: int = 5, shortest: int = 6) -> DataFrame:
    """(word, n): the runs of letters of whole texts, lower-cased, of at least ``shortest`` letters and ``least`` occurrences.

    A run loses one letter where ``typo`` divides the CRC-32 of its id and itself. Rows of a hot word are counted where they are read.
    """
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        F.translate(F.col("text"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= shortest)
    marked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % typo == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)
    return marked.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class Flat:
    """Words one after the other with GRAM - 1 edge symbols before, between and after them."""

    def __init__(self, words: list[str]):
        cps, bounds = vectext.points(words)
        sizes = np.diff(bounds)
        self.first = bounds[:-1] + (GRAM - 1) * np.arange(1, len(words) + 1)
        self.end = self.first + sizes
        self.x = np.zeros(len(cps) + (GRAM - 1) * (len(words) + 1), np.int64)
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.place = np.arange(len(cps)) + (GRAM - 1) * (self.word + 1)
        self.x[self.place] = _SYMBOL[cps]
        index = np.zeros(len(self.x), np.int64)
        index[self.place] = np.arange(len(cps)) - bounds[self.word]
        longest = int(sizes.max(initial=0)) + 1
        self.index, self.sizes = index, sizes
        self.powers, self.sums = [], []
        for base, _, numbers in _RATES:
            powers = np.full(longest + 1, base)
            powers[0] = 1
            powers = np.cumprod(powers)
            term = np.zeros(len(self.x) + 1, np.uint64)
            term[1 + self.place] = numbers[self.x[self.place]] * powers[index[self.place]]
            self.powers.append(powers)
            self.sums.append(np.cumsum(term, dtype=np.uint64))

    def grams(self) -> np.ndarray:
        at = self.x[: len(self.x) - GRAM + 1].copy()
        for k in range(1, GRAM):
            at = at * SYMBOLS + self.x[k: len(self.x) - GRAM + 1 + k]
        return np.unique(at)

    def names(self) -> list[np.ndarray]:
        return [named(s[self.end] - s[self.first], self.sizes) for s in self.sums]


def named(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return vectext.mix(sums + sizes.astype(np.uint64) * _RATES[0][0])


def _seen(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return (bits[gram >> 3] >> (gram & 7).astype(np.uint8) & 1).astype(bool)


def neighbours(flat: Flat, bits: np.ndarray, letters: np.ndarray):
    """Yields (word, names) of the strings one edit away from each word all of whose groups of four are in ``bits``; each once."""
    x, sums = flat.x, flat.sums
    scale = SYMBOLS ** np.arange(GRAM - 1, -1, -1)

    def out(word, sizes, values):
        return word, [named(v, sizes) for v in values]

    def passing(around: list[np.ndarray], p: np.ndarray, c: int) -> np.ndarray:
        """Which places p keep only observed groups when c stands between the symbols ``around`` (three before, three after)."""
        keep = np.arange(len(p))
        for first in range(GRAM - 1, -1, -1):  # how many symbols of the group stand before c
            window = around[GRAM - 1 - first: GRAM - 1] + [None] + around[GRAM - 1: 2 * GRAM - 2 - first]
            gram = np.zeros(len(keep), np.int64)
            for s, symbols in zip(scale, window, strict=True):
                gram += s * (c if symbols is None else symbols[keep])
            keep = keep[_seen(bits, gram)]
        return keep

    for lo in range(0, len(flat.place), CHUNK_PLACES):
        p, w = flat.place[lo: lo + CHUNK_PLACES], flat.word[lo: lo + CHUNK_PLACES]
        # deletions: of equal letters in a row the first goes
        once = x[p] != x[p - 1]
        q, v = p[once], w[once]
        for first in range(GRAM - 1, 0, -1):
            gram = np.zeros(len(q), np.int64)
            for s, k in zip(scale, [*range(-first, 0), *range(1, GRAM - first + 1)], strict=True):
                gram += s * x[q + k]
            keep = _seen(bits, gram)
            q, v = q[keep], v[keep]
        yield out(v, flat.sizes[v] - 1, [s[q] - s[flat.first[v]] + inverse * (s[flat.end[v]] - s[q + 1]) for s, (_, inverse, _) in zip(sums, _RATES, strict=True)])
        around = [x[p + k] for k in (-3, -2, -1, 1, 2, 3)]
        for c in letters.tolist():
            keep = passing(around, p, c)
            keep = keep[x[p[keep]] != c]
            q, v = p[keep], w[keep]
            yield out(v, flat.sizes[v], [s[flat.end[v]] - s[flat.first[v]] + (numbers[c] - numbers[x[q]]) * powers[flat.index[q]]
                                         for s, powers, (_, _, numbers) in zip(sums, flat.powers, _RATES, strict=True)])
        # insertions before a place or at the word's end: never after the same letter, which would give the same string
        ends = flat.end[w[x[p + 1] == 0]]
        slots, of = np.concatenate((p, ends)), np.concatenate((w, w[x[p + 1] == 0]))
        around = [x[slots + k] for k in (-3, -2, -1, 0, 1, 2)]
        for c in letters.tolist():
            keep = passing(around, slots, c)
            keep = keep[x[slots[keep] - 1] != c]
            q, v = slots[keep], of[keep]
            yield out(v, flat.sizes[v] + 1, [s[q] - s[flat.first[v]] + numbers[c] * powers[q - flat.first[v]] + base * (s[flat.end[v]] - s[q])
                                             for s, powers, (base, _, numbers) in zip(sums, flat.powers, _RATES, strict=True)])


def _flats(batches):
    for batch in batches:
        words, held, size = batch.column("word").to_pylist(), [], 0
        for w in words:
            held.append(w)
            size += len(w)
            if size >= CHUNK_LETTERS:
                yield held, Flat(held)
                held, size = [], 0
        if held:
            yield held, Flat(held)


def observed(words: DataFrame) -> tuple[bytes, list[int]]:
    """Bitmap (compressed) of the groups of four symbols that words hold, edges included, and the letters that they have.

    Rows on their way are bitmaps for the first two symbols, one for each task, or-ed together: at most 91^2 of about 1 KB reach the driver.
    """
    import pyarrow as pa

    tail = SYMBOLS ** 2
    schema = pa.schema([("lead", pa.int32()), ("bits", pa.binary())])

    def bitmaps(batches):
        found = np.empty(0, np.int64)
        for _, flat in _flats(batches):
            found = np.union1d(found, flat.grams())
        leads, at = np.unique(found // tail, return_index=True)
        rows = []
        for own in np.split(found % tail, at[1:]) if len(leads) else []:
            bits = np.zeros(tail, np.uint8)
            bits[own] = 1
            rows.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.record_batch([pa.array(leads, pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    def union(table: pa.Table) -> pa.Table:
        all_bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table([table.column("lead").slice(0, 1), [all_bits.tobytes()]], schema=schema)

    rows = words.select("word").mapInArrow(releasing(bitmaps), "lead int, bits binary").groupBy("lead").applyInArrow(releasing_group(union), "lead int, bits binary").toArrow().to_pylist()
    seen, letters = np.zeros(SYMBOLS ** GRAM, np.uint8), set()
    for r in rows:
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[:tail]
        seen[r["lead"] * tail: (r["lead"] + 1) * tail] = own
        letters |= {r["lead"] // SYMBOLS, r["lead"] % SYMBOLS, *np.unique(np.flatnonzero(own) % SYMBOLS).tolist()}
    return zlib.compress(np.packbits(seen, bitorder="little").tobytes(), 1), sorted(letters - {0})


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with n_near, the number of words one edit away, and best, the most frequent of them with its n (ties: the smaller).

    Letters outside a-z and U+00C0 to U+00FF are not expected in words.
    """
    import pyarrow as pa

    coded_schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    pair_schema = pa.schema([(c, pa.int64()) for c in ("to_a", "to_b", "a", "b")])

    def code(batches):
        for batch in batches:
            at = 0
            for held, flat in _flats([batch]):
                yield pa.record_batch([pa.array(held, pa.string()), batch.column("n").slice(at, len(held)), *(h.view(np.int64) for h in flat.names())], schema=coded_schema)
                at += len(held)

    coded = materialise(words.select("word", "n").mapInArrow(releasing(code), "word string, n long, a long, b long"), "spelling-words")
    packed, letters = observed(coded)

    def neighbourhood(batches):
        bits, alphabet = np.frombuffer(zlib.decompress(packed), np.uint8), np.array(letters, np.int64)
        for _, flat in _flats(batches):
            own = [h.view(np.int64) for h in flat.names()]
            made, size = [], 0
            for word, names in neighbours(flat, bits, alphabet):
                if len(word):
                    made.append([*(n.view(np.int64) for n in names), *(o[word] for o in own)])
                    size += len(word)
                if size >= 1 << 16:
                    yield pa.record_batch(list(map(np.concatenate, zip(*made, strict=True))), schema=pair_schema)
                    made, size = [], 0
            if made:
                yield pa.record_batch(list(map(np.concatenate, zip(*made, strict=True))), schema=pair_schema)

    made = coded.select("word").mapInArrow(releasing(neighbourhood), "to_a long, to_b long, a long, b long")
    target = coded.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.struct((-F.col("n")).alias("m"), "word").alias("near"))
    found = made.join(target.hint("shuffle_hash"), ["to_a", "to_b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    return coded.join(found, ["a", "b"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                        F.struct(F.col("near.word").alias("word"), (-F.col("near.m")).alias("n")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms ends. Ways double in each round, which is written to the shared folder."""
    spark = forms.sparkSession
    now = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    for _ in range(ROUNDS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, now = now, materialise(now.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        drop(spark, before)
        if now.where("moved").isEmpty():
            break
    return now.select("word", "root")


def group(docs: DataFrame, typo: int = 199, least: int = 5, shortest: int = 6, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text).

    A word's form is its most frequent near word, ties going to the smaller, if that has at least ``ratio`` times the
    word's occurrences; else null. A root is where following forms ends, the word itself without one.
    Null and empty texts have no words; a null id marks runs as an empty one does. Repeated rows count each time. Texts and
    words of any length are taken whole. An empty table gives none; other columns play no part.
    """
    if ratio < 5:
        raise ValueError("forms must be at least 5 times as frequent, which bounds the length of a chain")
    near = materialise(near_words(occurrences(docs, typo, least, shortest)), "spelling-near")
    formed = near.select("word", "n", "n_near", *(F.when(F.col("best.n") >= ratio * F.col("n"), F.col(f"best.{c}")).alias(as_) for c, as_ in (("word", "form"), ("n", "form_n"))))
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
