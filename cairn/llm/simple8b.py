"""Token ids in word-aligned binary files: Simple-8b.

A 64-bit word has a selector in its top four bits and the same number of equally
wide ids below, the first in the lowest bits. Selector 15 is the escape: the next
word is one id in full. A file holds blocks of ids, each decodable alone, then an
index of blocks and documents, then a fixed trailer:

    magic "S8B1"+4 zero bytes | blocks | block index: (byte offset, first id, ids, words) int64 each
    | document index: (doc_id, first id, ids) int64 each | blocks int64, documents int64, index offset int64, magic
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext
from .shared import fresh_dir, materialise, open_uri, partitions
from .workers import releasing

MAGIC = b"S8B1\0\0\0\0"
#: Ids in a word, by selector; each has 60 // count bits. Selector 15 escapes.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK_IDS = 1 << 16
#: Words remembered by a worker; beyond that it forgets all.
MEMO_WORDS = 1 << 20


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words of the ids (unsigned 64-bit), each word as full as can be from left to right."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    edges = [60 // c for c in COUNTS]  # ascending widths
    need = np.zeros(n, np.uint8)  # index of the narrowest width that holds the id
    for w in edges:
        need += (ids >> np.uint64(w)) > 0 if w < 64 else 0
    pick = np.full(n, len(COUNTS), np.uint8)  # selector at each position, escapes by default
    most = need.copy()
    size = 1
    longest = {1: most}
    for c in reversed(COUNTS):  # greatest need within the next c ids, from the shortest windows up
        if c > n:
            break
        while size * 2 <= c:
            prev = longest[size]
            if size >= len(prev):
                break
            longest[size * 2] = np.maximum(prev[:-size], prev[size:])
            size *= 2
        base = longest[size]
        top = base if size == c else np.maximum(base[: n - c + 1], base[c - size: c - size + n - c + 1])
        sel = COUNTS.index(c)
        fits = top[: n - c + 1] <= sel
        pick[: n - c + 1][fits] = sel
    # the widest window wins: larger counts are visited last and overwrite smaller ones
    step = np.array([*COUNTS, 1], np.int64)[pick]
    hop, at, i = (np.arange(n) + step).tolist(), [], 0
    while i < n:
        at.append(i)
        i = hop[i]
    at = np.array(at, np.int64)
    sel = pick[at]
    room = np.where(sel == len(COUNTS), 2, 1)
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint64)
    for s, c in enumerate(COUNTS):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            word = np.full(len(mine), s, np.uint64) << np.uint64(60)
            for k in range(c):
                word |= ids[at[mine] + k] << np.uint64(k * (60 // c))
            out[place[mine]] = word
    mine = np.flatnonzero(sel == len(COUNTS))
    out[place[mine]] = np.uint64(ESCAPE) << np.uint64(60)
    out[place[mine] + 1] = ids[at[mine]]
    return out


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block; all words of a selector are decoded at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # a word after an escape is data; walk from escape to escape
        data, i = np.zeros(len(words), bool), 0
        for e in np.flatnonzero(sel == ESCAPE).tolist():
            if e >= i:
                data[e + 1] = True
                i = e + 2
    else:
        data = None
    head = np.arange(len(words)) if data is None else np.flatnonzero(~data)
    sel = sel[head]
    counts = np.array([*COUNTS, 0, 1], np.int64)[sel]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, c in enumerate(COUNTS):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            width, w = 60 // c, words[head[mine]]
            mask = np.uint64((1 << width) - 1)
            for k in range(c):
                out[place[mine] + k] = (w >> np.uint64(k * width)) & mask
    mine = np.flatnonzero(sel == ESCAPE)
    if len(mine):
        out[place[mine]] = words[head[mine] + 1]
    if len(out) != n:
        raise ValueError(f"a block of {n} ids has {len(out)}")
    return out


class Writer:
    """One file; ids are appended document by document."""

    def __init__(self, out, block_ids: int = BLOCK_IDS):
        self.out, self.block_ids = out, block_ids
        self.at, self.held, self.n, self.ids = len(MAGIC), [], 0, 0
        self.block_index: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def append(self, doc_ids: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Several documents: their ids one after the other, and where each ends."""
        first = self.ids
        start = 0
        for d, e in zip(doc_ids, ends.tolist(), strict=True):
            self.docs.append((d, first + start, e - start))
            start = e
        self.ids += len(ids)
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.block_ids:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        done = 0
        while len(ids) - done >= self.block_ids or all_of_it and done < len(ids):
            part = ids[done: done + self.block_ids]
            words = encode_block(part)
            self.out.write(words.astype("<u8").tobytes())
            self.block_index.append((self.at, self.ids - len(ids) + done, len(part), len(words)))
            self.at += 8 * len(words)
            done += len(part)
        self.held, self.n = [ids[done:]], len(ids) - done

    def close(self) -> None:
        self._flush(True)
        for index in (self.block_index, self.docs):
            self.out.write(np.array(index, "<i8").tobytes())
        self.out.write(np.array([len(self.block_index), len(self.docs), self.at], "<i8").tobytes() + MAGIC)


def read(source, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, id's place in the file, ids) of each document; ``source`` can seek. Holds a block and a document at a time."""
    source.seek(size - 32)
    tail = source.read(32)
    if tail[24:] != MAGIC:
        raise ValueError("not a file of this format")
    n_blocks, n_docs, at = np.frombuffer(tail[:24], "<i8")
    source.seek(int(at))
    index = np.frombuffer(source.read(int(n_blocks) * 32), "<i8").reshape(-1, 4)
    docs = np.frombuffer(source.read(int(n_docs) * 24), "<i8").reshape(-1, 3)
    held, b = np.empty(0, np.uint32), 0
    begins = 0  # place of held[0]
    for doc_id, start, n in docs.tolist():
        if start + n > begins + len(held):
            parts = [held[start - begins:]]
            have = begins + len(held)
            begins = start
            while have < start + n:
                offset, first, ids, words = index[b].tolist()
                source.seek(offset)
                parts.append(decode_block(np.frombuffer(source.read(8 * words), "<u8").astype(np.uint64), ids))
                have, b = first + ids, b + 1
            held = np.concatenate(parts)
        yield doc_id, start, held[start - begins: start - begins + n]


#: The normalizing and cutting that WordEncoder does itself.
RULES = {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
         "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
             {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}


class WordEncoder:
    """Ids of whole texts. A lower-casing tokenizer that cuts at white space, between letters, numbers and others, and
    before contractions, by RULES, encodes each distinct piece once; any other is given whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.known = all(spec[c] == rule for c, rule in RULES.items())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        # hashes of the pieces learned, in order, with their rows; the rows' ids
        self.seen, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.values, self.used = np.empty(1 << 16, np.uint32), 0
        self.ends, self.n = np.zeros(1 << 16, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        total = int(lens.sum())
        while self.used + total > len(self.values):
            self.values = np.concatenate((self.values, np.empty_like(self.values)))
        while self.n + len(got) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.values[self.used: self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.ends[self.n + 1: self.n + 1 + len(got)] = self.used + np.cumsum(lens)
        self.used += total
        self.n += len(got)

    def __call__(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each with ``end_id`` at its end, and where each ends.

        Words are cut and A-Z lower-cased as the tokenizer itself does first, unless a text holds one of
        its special tokens, which would be cut too; then its block goes by white space alone.
        """
        if not self.known:
            each = [np.array(e.ids + ([] if end_id is None else [end_id]), np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *each]), np.cumsum([len(x) for x in each])
        if len(texts) == 1 and len(texts[0]) > vectext.PIECE_CHARS and (cut := list(vectext.pieces(texts[0], vectext.PIECE_CHARS // 2)))[1:]:
            ids = np.concatenate([self([piece], None)[0] for piece in cut] + ([] if end_id is None else [np.array([end_id], np.uint32)]))
            return ids, np.array([len(ids)])
        if self.n > MEMO_WORDS:
            self._forget()
        joined = "".join(texts)
        cps, bounds = vectext.points(texts)
        if any(t in joined for t in self.special):
            starts, ends, text_first = vectext.words(cps, bounds)
            lower = str
        else:
            cps = np.where((cps - np.uint32(65)) <= 25, cps + np.uint32(32), cps)
            starts, ends, text_first = vectext.fine_spans(cps, bounds)
            lower = lambda w: w.lower() if w.isascii() else w.translate(_LOWER)
        found, at, inverse = np.unique(vectext.hashes(cps, starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.seen, found)
        known = self.seen[np.minimum(where, len(self.seen) - 1)] == found if len(self.seen) else np.zeros(len(found), bool)
        new = np.flatnonzero(~known)
        if len(new):
            first = self.n
            self._learn([lower(joined[a:b]) for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            self.seen = np.insert(self.seen, where[new], found[new])
            self.row = np.insert(self.row, where[new], np.arange(first, self.n))
            where = np.searchsorted(self.seen, found)
        rows = self.row[where][inverse] if len(found) else inverse
        ids, word_ends = vectext.gather(self.values, self.ends, rows)
        text_ends = np.concatenate(([0], word_ends))[text_first[1:]]
        if end_id is None:
            return ids, text_ends
        return np.insert(ids, text_ends, end_id), text_ends + np.arange(1, len(texts) + 1)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _workers_encoder(path: str, kept: dict = {}) -> WordEncoder:  # noqa: B006  one per Python worker
    if path not in kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept[path] = WordEncoder(path)
    return kept[path]


def write(docs: DataFrame, tokenizer: str, end_id: int | None, where: str | None = None) -> DataFrame:
    """Encode every text and write the ids in ascending doc_id order; a file for each range of ids.

    Returns the manifest (part, uri, bytes, ids, documents), one row a file, itself a committed
    table: files of attempts that were lost or repeated are in no manifest. Null texts are empty
    texts; null ids come first; rows of one id follow each other in order of text; other columns play no part.
    """
    where = where or fresh_dir(docs.sparkSession, "simple8b")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, name = _workers_encoder(tokenizer), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.s8b"
        fs, path = open_uri(f"{where}/{name}")
        out, writer = None, None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            # a slice at a time: a batch's texts aren't all held as Python strings
            for lo in range(0, len(keys), 256):
                own = texts.slice(lo, 256).to_pylist()
                for first, block in vectext.blocks(own):
                    if writer is None:
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path)
                        writer = Writer(out)
                    ids, ends = encode(block, end_id)
                    writer.append(keys[lo + first: lo + first + len(block)], ids, ends)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch({"part": [TaskContext.get().partitionId()], "uri": [f"{where}/{name}"],
                                   "bytes": [fs.get_file_info(path).size], "ids": [writer.ids], "documents": [len(writer.docs)]},
                                  schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("bytes", pa.int64()), ("ids", pa.int64()), ("documents", pa.int64())]))

    spark = docs.sparkSession
    n = partitions(docs)
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .repartitionByRange(n, "doc_id", F.crc32(F.col("text").cast("binary"))).sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(releasing(run), "part int, uri string, bytes long, ids long, documents long"), "simple8b-manifest")


#: Stands for a null id in files and in the order.
NULL_ID = -(1 << 63)


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of a manifest.

    ``start`` counts the ids of all documents before it; a file's own start is a sum over the
    manifest, which has a row for each file.
    """
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_uri(row["uri"])
                got: list[tuple] = []
                with fs.open_input_file(path) as f:
                    for doc_id, start, ids in read(f, row["bytes"]):
                        got.append((None if doc_id == NULL_ID else doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(got) == 8192:
                            yield pa.record_batch(list(map(list, zip(*got, strict=True))), schema=schema)
                            got = []
                if got:
                    yield pa.record_batch(list(map(list, zip(*got, strict=True))), schema=schema)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("uri", "bytes", "base").repartition(n, "uri").mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write every document's ids and read them back; see write and read_back. An empty table gives no file and no row."""
    return read_back(write(docs, tokenizer, end_id))
