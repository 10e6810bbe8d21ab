"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is cut greedily into
phrases, each the longest match in that language's text; a language's code length is
its number of phrases times the bits that address a phrase (log2 of the length of its
text). The language with the shortest code wins.

An automaton's transitions are laid into each other's gaps, so its size follows its text
and not the alphabet. Texts are parsed at many places at once, and a parse that comes
from before is followed until it meets a phrase that began there, so the phrases are those of one
parse from the text's first letter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import releasing

#: Bounds of the sample that is learned from, for each language: texts, and letters beyond which no further text is added.
TEXTS, LETTERS = 400, 24_000
#: Letters between two places at which parsing begins, and letters parsed side by side.
STRIDE, BLOCK = 256, 1 << 21
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text modulo 4 is 2. A null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_text(docs: DataFrame) -> dict[str, str]:
    """For each label, whole texts of its labelled rows that aren't held out, in order of a hash of the text, until they have LETTERS characters or are TEXTS.

    Texts longer than LETTERS come last, the shortest first, and the first text is always taken. The chance of a text to be
    looked at is set from the number of distinct texts, so that few more than TEXTS for a label reach the driver and a label
    whose rows are copies isn't lost. The choice depends on no order or partition.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("text").alias("key"), F.greatest(F.length("text"), F.lit(LETTERS)).alias("size"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not counts:
        return {}
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, math.ceil((1 << 20) * min(1.0, 2 * TEXTS / max(1, n))))]), F.col("lang"))
    looked = usable.where(F.pmod("key", F.lit(1 << 20)) < limit).select("lang", "key", "size", F.length("text").alias("chars")).distinct().collect()
    chosen: dict[str, list[int]] = {}
    for lang in sorted(counts):
        own, total = sorted((r["size"], r["key"], r["chars"]) for r in looked if r["lang"] == lang)[:TEXTS], 0
        for _, key, chars in own:
            if total and total + chars > LETTERS:
                continue
            chosen.setdefault(lang, []).append(key)
            total += chars
    keys = sorted({k for own in chosen.values() for k in own})
    rows = usable.where(F.col("key").isin(keys)).groupBy("lang", "key").agg(F.min("text").alias("text")).collect() if keys else []
    texts = {(r["lang"], r["key"]): r["text"] for r in rows}
    return {lang: " ".join(texts[lang, k] for k in own) for lang, own in chosen.items()}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, a dictionary for each state."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Automaton:
    """A suffix automaton as a comb: a state is an offset, and the entry at offset + code holds the state that it belongs to and the next one.

    The first state is 0; codes from ``width`` on are in no transition.
    """

    NEXT = np.int64((1 << 32) - 1)

    def __init__(self, codes: np.ndarray, width: int):
        states = suffix_automaton(codes.tolist())
        taken, offset, low = bytearray(4 * width + 64), [0] * len(states), 1
        used = {0}
        for c in states[0]:
            taken[c] = 1
        # states of many transitions first, at the first offset where all their entries are free
        for i in sorted(range(1, len(states)), key=lambda i: -len(states[i])):
            own = sorted(states[i])
            at, tries = low, 0
            while at in used or any(taken[at + c] for c in own):
                at, tries = at + 1, tries + 1
                if at + width >= len(taken):
                    taken.extend(bytes(len(taken)))
            if tries > 16:  # little is free below
                low = max(low, at - 16)
            offset[i] = at
            used.add(at)
            for c in own:
                taken[at + c] = 1
            if at + 2 * width >= len(taken):
                taken.extend(bytes(len(taken)))
        self.comb = np.full(max(offset) + width + 2, -1, np.int64)
        for i, out in enumerate(states):
            for c, to in out.items():
                self.comb[offset[i] + c] = offset[i] << 32 | offset[to]
        # where a phrase that begins with a code goes on; 0 where the code is a phrase by itself
        self.begin = np.zeros(width + 1, np.int64)
        self.begin[list(states[0])] = [offset[to] for to in states[0].values()]

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins with the code."""
        entry = self.comb[state + code]
        on = (entry >> 32) == state
        return np.where(on, entry & self.NEXT, self.begin[code]), ~on | (state == 0)

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a phrase begins at each place of one greedy parse.

        Runs of STRIDE codes are first parsed as if a phrase began at each. Then a run is parsed again from the state in
        which the run before it ends, until a phrase begins where one did before: from there on nothing changes. If none does,
        the run after it is next.
        """
        lanes = -(-len(codes) // STRIDE)
        rows = np.ascontiguousarray(np.append(codes, np.full(lanes * STRIDE - len(codes), len(self.begin) - 1)).reshape(lanes, STRIDE).T)
        marks = np.empty(rows.shape, bool)
        state = np.zeros(lanes, np.int64)
        for t, row in enumerate(rows):
            state, marks[t] = self.step(state, row)
        last, assumed = state, np.zeros(lanes, np.int64)
        while True:
            entry = np.concatenate((assumed[:1], last[:-1]))
            own = np.flatnonzero(entry != assumed)
            if not len(own):
                return marks.T.ravel()[: len(codes)]
            assumed, state = entry, entry[own]
            for t, row in enumerate(rows):
                state, begins = self.step(state, row[own])
                same = begins & marks[t, own]
                marks[t, own] = begins
                if same.any():
                    own, state = own[~same], state[~same]
                    if not len(own):
                        break
            last = last.copy()
            last[own] = state


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


class Model:
    """Automata of all languages. Code 0 is anything between letters, 1 a letter that no sample has."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        lowered = {k: v.lower() for k, v in samples.items()}
        kept = sorted({c for text in lowered.values() for c in set(text) if c.isalpha()})
        self.table = letters().astype(np.uint32)
        self.table[[ord(c) for c in kept]] = np.arange(2, 2 + len(kept), dtype=np.uint32)
        self.own, self.automata, self.bits, self.letter_bits = [], [], [], []
        for lang in self.langs:
            codes = self.codes([lowered[lang]])[0]
            used = np.unique(np.append(codes, 0))
            to = np.full(2 + len(kept), len(used), np.int64)  # codes of the language itself; others are beyond its width
            to[used] = np.arange(len(used))
            self.own.append(to)
            self.automata.append(Automaton(to[codes], len(used)))
            self.bits.append(math.log2(max(2, len(codes))))
            self.letter_bits.append(math.log2(len(used) + 1))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of lower-cased texts with runs of non-letters as one 0, and where each text begins."""
        from .vectext import points

        cps, bounds = points(texts)
        c = self.table[cps]
        keep = np.ones(len(c), bool)
        first = np.zeros(len(c) + 1, bool)
        first[bounds] = True
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | first[1:-1]
        keep &= ~((c == 0) & first[:-1])
        starts = np.concatenate(([0], np.cumsum(keep)))[bounds]
        return c[keep], starts

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) by language (columns), and codes of each text."""
        codes, bounds = self.codes([t.lower() for t in texts])
        # a letter that no sample has ends each text, so no phrase goes on into the next
        codes = np.insert(codes, bounds[1:], 1)
        bounds = bounds + np.arange(len(bounds))
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, (automaton, to) in enumerate(zip(self.automata, self.own, strict=True)):
            before = np.concatenate(([0], np.cumsum(automaton.starts(to[codes]))))
            out[:, k] = before[bounds[1:] - 1] - before[bounds[:-1]]
        return out, np.diff(bounds) - 1

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score (the share of 2^-bits that the shortest code has) and gain of each text: the part of a code letter by letter, the text's two ends included, that phrases save, negative where they are longer."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        found, lens = self.phrases(texts)
        bits = found * np.array(self.bits)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        gain = 1 - bits.min(axis=1) / ((lens + 2) * np.array(self.letter_bits)[best])
        has = np.array([any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts], bool)
        return [self.langs[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0), np.where(has, gain, 0.0)


def predict(docs: DataFrame, samples: dict[str, str], label: str = "lang_pred", share: str = "lang_score", gain: str = "lang_gain") -> DataFrame:
    """``docs`` with the predicted language, its score and its gain as columns ``label``, ``share`` and ``gain`` (replacing columns of these names).

    A null text or one without a letter is ``und`` with score and gain 0; so is every text if nothing was
    learned. Equal texts, repeated rows included, have equal results, and ties go to the first label in order. An empty
    table gives an empty result. A text is parsed whole, whatever its length.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (label, share, gain)])
    shape = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(share, T.DoubleType()), T.StructField(gain, T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(Model(samples))  # a few MB a language, by LETTERS

    def run(batches):
        from .vectext import blocks

        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                labels, scores, gains = [], [], []
                for _, part in blocks([t or "" for t in batch.column("text").to_pylist()], BLOCK):
                    a, b, c = model.value.predict(part)
                    labels += a
                    scores += b.tolist()
                    gains += c.tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(gains, pa.float64())],
                                                 names=[*batch.schema.names, label, share, gain])

    return docs.mapInArrow(releasing(run), shape)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` (text, lang, doc_id) and label all of it: doc_id, held_out, lang_pred, score.

    Repeated rows give a row each; a null doc_id is held out; an empty table gives an empty result; see predict for odd texts.
    """
    found = predict(docs.select("doc_id", "text"), training_text(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
