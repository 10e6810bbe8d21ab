"""Removal of repeated passages by prefix-partitioned suffix trees over words.

Suffixes are split into groups by prefixes of variable length, a group's suffixes are built into
a tree in memory (sorted suffixes and the lengths that neighbours share), and its internal nodes of at least a window's depth are
the repeats; all leaves of such a node but the earliest are removed.

Not every place's suffix is shipped. Of each window the seed of SEED words with the smallest hash marks one place, so equal windows
mark equal places, and one suffix stands for all the windows in a row that mark its start. It takes along the words to
its left that these windows begin with; a group therefore has a second tree, of the reversed left sides, and a window is a node
of depth window - o to the right with one of depth o to the left. Suffixes whose first SEED words occur once are leaves of the root
and go nowhere. Prefixes are SEED words long while they have no more suffixes than a group should; others
are lengthened to the whole window, where a node needs no tree but only its earliest leaf.

Texts are read once, and written in blocks to the shared folder, where later steps read them; only files named in a table that Spark commits count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext
from .shared import drop, fresh_dir, get, materialise, put
from .workers import release, releasing

WINDOW, SEED = 20, 6
#: Code points of a block file, which holds whole documents; suffixes of a group; least suffixes of a prefix that is lengthened.
BLOCK_CHARS, GROUP_SUFFIXES, LEAST_HOT = 1 << 23, 1 << 15, 256
_RATES = vectext.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_OTHER = vectext.mix(_RATES + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Stands for a null id: the last in the order of documents.
NULL_ID = (1 << 63) - 1


def segments(texts: list[str], window: int) -> Iterator[tuple[int, int, str]]:
    """(index of the text, number of its words before, part): a long text comes in parts of which each begins with the last
    window - 1 words of the one before, so that every window is in one part."""
    for i, text in enumerate(texts):
        if len(text) <= vectext.PIECE_CHARS:
            yield i, 0, text
            continue
        tail: list[bytes] = []
        before = 0
        for piece in vectext.pieces(text, vectext.BLOCK_CHARS):
            part = b" ".join(tail).decode() + " " + piece
            yield i, before, part
            own = part.encode().split()
            tail = own[max(0, len(own) - window + 1):]
            before += len(own) - len(tail)


class Sampled:
    """The sampled suffixes of some parts of texts: of the k-th, ``place`` is its start, ``first`` and ``last`` the windows that it stands for."""

    def __init__(self, parts: list[str], window: int, seed: int):
        self.text = "".join(parts)
        cps, bounds = vectext.points(parts)
        self.starts, self.ends, self.bounds = vectext.words(cps, bounds)
        h = vectext.hashes(cps, self.starts, self.ends)
        self.hashes = h
        n = len(h)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        windows = np.flatnonzero(np.arange(n) + window <= last)
        if not len(windows):
            self.place = self.first = self.last = np.empty(0, np.int64)
            self.prefix = np.empty(0, np.int64)
            return
        seeds = np.zeros(n - seed + 1, np.uint64)
        for j in range(seed):
            seeds += h[j: j + len(seeds)] * _RATES[j]
        seeds = vectext.mix(seeds)
        # the leftmost smallest of the seeds of each window, by doubling
        span, best = 1, np.arange(len(seeds))
        while 2 * span <= window - seed + 1:
            best = np.where(seeds[best[:-span]] <= seeds[best[span:]], best[:-span], best[span:])
            span *= 2
        more = window - seed + 1 - span
        if more:
            best = np.where(seeds[best[:-more]] <= seeds[best[more:]], best[:-more], best[more:])
        marked = best[windows]
        new = np.flatnonzero(np.concatenate(([True], (marked[1:] != marked[:-1]) | (windows[1:] != windows[:-1] + 1))))
        self.place, self.first = marked[new], windows[new]
        self.last = windows[np.append(new[1:], len(windows)) - 1]
        self.prefix = seeds[self.place].view(np.int64)

    def part(self) -> np.ndarray:
        return np.searchsorted(self.bounds, self.place, "right") - 1


def _sampled(texts: list[str], window: int, seed: int) -> Iterator[tuple[list[tuple[int, int]], Sampled]]:
    """The suffixes of texts, some parts at a time; with each the (index of the text, words before) of its parts."""
    of, parts, size = [], [], 0
    for i, before, part in segments(texts, window):
        of.append((i, before))
        parts.append(part)
        size += len(part)
        if size >= vectext.BLOCK_CHARS:
            yield of, Sampled(parts, window, seed)
            of, parts, size = [], [], 0
    if parts:
        yield of, Sampled(parts, window, seed)


BLOCK = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("null", pa.bool_()), ("text", pa.large_string())])


def _write(uri: str, rows: list[tuple]) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCK, strict=True)], schema=BLOCK))
    put(uri, sink.getvalue())


def _read(uri: str) -> pa.Table:
    return pa.ipc.open_stream(get(uri)).read_all()


def written(docs: DataFrame, where: str, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Writes the texts in blocks below ``where``; a row (block, uri) for each, and its distinct prefixes, (block, prefix, n)."""
    schema = pa.schema([("block", pa.int64()), ("uri", pa.string()), ("prefix", pa.int64()), ("n", pa.int32())])

    def run(batches):
        rows, size = [], 0

        def out():
            name = uuid.uuid4()
            uri, block = f"{where}/{name.hex}.arrow", name.int >> 64 & NULL_ID
            _write(uri, rows)
            found = [s.prefix for _, s in _sampled([r[3] for r in rows], window, seed)]
            prefix, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            yield pa.record_batch([[block], [uri], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], schema=schema)
            for lo in range(0, len(prefix), 1 << 16):
                own = slice(lo, lo + (1 << 16))
                k = len(prefix[own])
                yield pa.record_batch([np.full(k, block), pa.nulls(k, pa.string()), prefix[own], n[own].astype(np.int32)], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for row in zip(*(c.slice(lo, 64).to_pylist() for c in batch.columns), strict=True):
                    rows.append(row)
                    size += len(row[3])
                    if size >= BLOCK_CHARS:
                        yield from out()
                        rows, size = [], 0
        if rows:
            yield from out()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("tie"), F.col("doc_id").isNull().alias("null"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(texts.mapInArrow(releasing(run), "block long, uri string, prefix long, n int"), "repeats-prefixes")


def shared_prefixes(made: DataFrame) -> DataFrame:
    """(block, prefix, n, total) of the prefixes that several suffixes have."""
    total = F.sum("n").over(Window.partitionBy("prefix"))
    return materialise(made.where("prefix IS NOT NULL").select("block", "prefix", "n", total.alias("total")).where("total > 1"), "repeats-shared")


def _by_block(files: DataFrame, rows: DataFrame, run, shape: str) -> DataFrame:
    """``run(uri, table)`` for each block of ``files`` (block, uri) that has ``rows`` (block, ...); yields record batches."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        uris = [u for u in table.column("uri").to_pylist() if u]
        if uris:
            yield from run(uris[0], table.filter(pa.compute.is_null(table.column("uri"))))
        release()

    # few and small rows stand for much work: the number of partitions is not to be lowered by their size
    both = files.unionByName(rows, allowMissingColumns=True).repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    return both.groupBy("block").applyInArrow(whole, shape)


SUFFIX = "group int, id long, tie long, block long, doc int, place long, left int, text string"


def suffixes(files: DataFrame, shared: DataFrame, groups: int, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The suffixes with the ``shared`` prefixes: their group, document, the word they begin at, the number of words taken along to
    their left, and all these words and those of their windows to the right."""
    schema = pa.schema([("group", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("place", pa.int64()), ("left", pa.int32()), ("text", pa.string())])

    def run(uri, table):
        if not table.num_rows:
            return
        wanted, block = np.sort(table.column("prefix").to_numpy()), table.column("block")[0].as_py()
        held = _read(uri)
        ids, ties = (held.column(c).to_numpy() for c in ("id", "tie"))
        for of, s in _sampled(held.column("text").to_pylist(), window, seed):
            keep = np.flatnonzero(np.isin(s.prefix, wanted))
            if not len(keep):
                continue
            part = s.part()[keep]
            doc, before = np.array(of, np.int64)[part].T
            a, b = s.starts[s.first[keep]].tolist(), s.ends[s.last[keep] + window - 1].tolist()
            group = (vectext.mix(s.prefix[keep].view(np.uint64)) % np.uint64(groups)).astype(np.int32)
            yield pa.record_batch([group, ids[doc], ties[doc], np.full(len(keep), block), doc.astype(np.int32), s.place[keep] - s.bounds[part] + before,
                                   (s.place[keep] - s.first[keep]).astype(np.int32), pa.array([s.text[x:y] for x, y in zip(a, b, strict=True)], pa.string())], schema=schema)

    return _by_block(files, shared.select("block", "prefix"), run, SUFFIX)


def _nodes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lexicographic order, and how many words each shares with the one before: with these, depth d's nodes are the runs that share d."""
    order = np.lexsort(words.T[::-1])
    differs = words[order][1:] != words[order][:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), words.shape[1])
    return order, np.concatenate(([-1], shared))


def _node_of(nodes: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    order, shared = nodes
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


FLAG = pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("place", pa.int64()), ("windows", pa.int64())])


def trees(leaves: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(block, doc, place, windows): for each suffix those of its windows, as bits of their distance to the left, that begin earlier too."""
    side = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        hashed, counts = [], [np.zeros(1, np.int64)]
        for _, texts in vectext.blocks(table.column("text").to_pylist(), vectext.BLOCK_CHARS // 2):
            cps, bounds = vectext.points(texts)
            starts, ends, first = vectext.words(cps, bounds)
            hashed.append(vectext.hashes(cps, starts, ends))
            counts.append(np.diff(first))
        table = table.drop_columns(["text"])
        word = np.unique(np.concatenate(hashed), return_inverse=True)[1].astype(np.int32)
        first = np.cumsum(np.concatenate(counts))
        del hashed
        left = table.column("left").to_numpy().astype(np.int64)
        at, count = first[:-1] + left, np.diff(first)
        least = left - (count - window)  # the nearest of a suffix's windows begins so many words to its left
        word = np.append(word, np.int32(-1))
        right = np.stack([np.where(at + k < first[1:], word[np.minimum(at + k, len(word) - 1)], -1) for k in range(window)], axis=1)
        back = np.stack([np.where(k <= left, word[np.maximum(at - k, 0)], -1) for k in range(1, side + 1)], axis=1)
        right_nodes, left_nodes = _nodes(right), _nodes(back)
        # equal ids, ties and places are one place of rows that are listed twice
        id_, tie, place = (table.column(c).to_numpy() for c in ("id", "tie", "place"))
        order = np.lexsort((place, tie, id_))
        new = np.concatenate(([True], (np.diff(id_[order]) != 0) | (np.diff(tie[order]) != 0) | (np.diff(place[order]) != 0)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        bits = np.zeros(len(order), np.int64)
        for o in range(side):
            own = np.flatnonzero((least <= o) & (o <= left))
            if not len(own):
                continue
            node = _node_of(right_nodes, window - o)[own] * (len(order) + 1) + _node_of(left_nodes, o)[own]
            _, node = np.unique(node, return_inverse=True)
            earliest = np.full(node.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(earliest, node, rank[own])
            bits[own[rank[own] > earliest[node]]] |= 1 << o
        hit = np.flatnonzero(bits)
        yield pa.record_batch([table.column("block").to_numpy()[hit], table.column("doc").to_numpy()[hit], place[hit], bits[hit]], schema=FLAG)
        release()

    return leaves.groupBy("group").applyInArrow(run, "block long, doc int, place long, windows long")


HOT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("place", pa.int64()), ("later", pa.bool_())])


def _ranked(a: np.ndarray, b: np.ndarray, id_: np.ndarray, tie: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: where a window's rows begin, and which rows equal the earliest of their window."""
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    earliest = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    return first, (id_ == id_[earliest]) & (tie == tie[earliest]) & (place == place[earliest])


def hot_windows(files: DataFrame, hot: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """As trees(), for the windows of prefixes that are lengthened to the whole window, each named by 128 bits.

    Of a window's places in one block only the earliest is shipped. What is shipped is dealt by ranges of
    (name, document, place), so a window that is in all documents is spread over many tasks; each finds the earliest place of
    its windows, and whether its first window began in the range before is decided by the ends of all ranges, a row each.
    """
    def run(uri, table):
        if not table.num_rows:
            return
        wanted, block = np.sort(table.column("prefix").to_numpy()), table.column("block")[0].as_py()
        held = _read(uri)
        ids, ties = (held.column(c).to_numpy() for c in ("id", "tie"))
        found = []
        for of, s in _sampled(held.column("text").to_pylist(), window, seed):
            keep = np.flatnonzero(np.isin(s.prefix, wanted))
            if not len(keep):
                continue
            many = s.last[keep] - s.first[keep] + 1
            ends = np.cumsum(many)
            start = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(s.first[keep], many)
            doc, before = np.array(of, np.int64)[part := np.repeat(s.part()[keep], many)].T
            names = [np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)]
            for j in range(window):
                h = s.hashes[start + j]
                for name, rates in zip(names, (_RATES, _OTHER), strict=True):
                    name += vectext.mix(h + rates[j % len(rates)]) * rates[(7 * j + 3) % len(rates)]
            found.append([*(vectext.mix(x).view(np.int64) for x in names), ids[doc], ties[doc], doc.astype(np.int32), start - s.bounds[part] + before])
        if not found:
            return
        a, b, id_, tie, doc, place = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((place, tie, id_, b, a))
        a, b, id_, tie, doc, place = (x[order] for x in (a, b, id_, tie, doc, place))
        _, early = _ranked(a, b, id_, tie, place)
        for lo in range(0, len(a), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            yield pa.record_batch([a[own], b[own], id_[own], tie[own], np.full(len(a[own]), block), doc[own], place[own], ~early[own]], schema=HOT)

    shape = "a long, b long, id long, tie long, block long, doc int, place long, later boolean"
    rows = materialise(_by_block(files, hot.select("block", "prefix"), run, shape), "repeats-hot")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``later`` rows, and as undecided those that equal the earliest of the range's first window; with the latter the names of the range's first and last window."""
        from pyspark import TaskContext

        if not (held := [x for x in batches if x.num_rows]):
            return
        table = pa.Table.from_batches(held)
        a, b, id_, tie, block, doc, place = (table.column(c).to_numpy() for c in HOT.names[:-1])
        first, early = _ranked(a, b, id_, tie, place)
        begun = np.cumsum(first)
        keep = np.flatnonzero(~early | (begun == 1))
        n, undecided = len(keep), early[keep]
        number = TaskContext.get().partitionId()
        yield pa.record_batch([block[keep], doc[keep], place[keep], pa.array(np.full(n, number, np.int32), mask=~undecided),
                               *(pa.array(np.full(n, x), mask=~undecided) for x in (a[0], b[0], a[-1], b[-1]))], schema=pa.schema(
            [("block", pa.int64()), ("doc", pa.int32()), ("place", pa.int64()), ("range", pa.int32()), ("first_a", pa.int64()), ("first_b", pa.int64()), ("last_a", pa.int64()), ("last_b", pa.int64())]))

    order = ["a", "b", "id", "tie", "place"]
    shipped = rows.where("NOT later").repartitionByRange(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    marked = materialise(shipped.mapInArrow(releasing(mark), "block long, doc int, place long, range int, first_a long, first_b long, last_a long, last_b long"), "repeats-marked")
    ends = marked.where("range IS NOT NULL").select("range", "first_a", "first_b", "last_a", "last_b").distinct().orderBy("range").collect()  # one for each range
    carried = [r["range"] for before, r in zip(ends, ends[1:]) if (before["last_a"], before["last_b"]) == (r["first_a"], r["first_b"])]
    later = rows.where("later").select("block", "doc", "place").union(marked.where(F.col("range").isNull() | F.col("range").isin(carried)).select("block", "doc", "place"))
    return later.select("block", "doc", "place", F.lit(1).cast("long").alias("windows"))


def removed(files: DataFrame, flags: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """The documents of all blocks without the words that flagged windows cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                        *[("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] * texts])

    def run(uri, table):
        doc, place, windows = (table.column(c).to_numpy() for c in ("doc", "place", "windows"))
        each = [(doc[hit], place[hit] - o) for o in range(window) if len(hit := np.flatnonzero(windows >> o & 1))]
        doc = np.concatenate([np.empty(0, np.int32), *(x[0] for x in each)])
        start = np.concatenate([np.empty(0, np.int64), *(x[1] for x in each)])
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        held = _read(uri)
        cuts = np.searchsorted(doc, np.arange(held.num_rows + 1))
        made = []
        for i in range(held.num_rows):
            words = held.column("text")[i].as_py().encode().split()  # bytes are split at just the space and the controls 9 to 13
            own, spans = start[cuts[i]: cuts[i + 1]], []
            kept = words
            if len(own):
                depth = np.zeros(len(words) + 1, np.int32)
                np.add.at(depth, own, 1)
                np.add.at(depth, own + window, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = list(compress(words, (~gone).tolist()))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
            text = b" ".join(kept)
            id_ = None if held.column("null")[i].as_py() else held.column("id")[i].as_py()
            made.append((id_, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), *[text.decode(), spans][: 2 * texts]))
            if len(made) >= 256:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                made = []
        if made:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<start: long, end: long>>" * texts
    return _by_block(files, flags, run, shape)


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) without the words covered by a window of ``window`` words that also begins earlier:
    in a document of smaller id, or before in the same one. Windows are judged on the input.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces), with ``texts`` also kept, and spans,
    the ranges of words that were removed. Null and empty texts have no words; a text shorter than a window keeps all. A null id
    comes last. Rows that share an id but not the text are ordered by a hash of the text; rows that repeat both are one
    document, judged alike. Long texts are worked on in overlapping parts. An empty table gives none; other columns play no part.
    """
    spark, seed = docs.sparkSession, min(SEED, window)
    where = fresh_dir(spark, "repeats-texts")
    made = written(docs, where, window, seed)
    files = made.where("uri IS NOT NULL").select("block", "uri")
    shared = shared_prefixes(made)
    leaves = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves // GROUP_SUFFIXES))
    hot = max(LEAST_HOT, leaves // groups)
    flags = trees(suffixes(files, shared.where(F.col("total") <= hot), groups, window, seed), window, seed)
    out = materialise(removed(files, flags.unionByName(hot_windows(files, shared.where(F.col("total") > hot), window, seed)), window, texts), "repeats-kept")
    drop(spark, made, shared, where)
    return out
