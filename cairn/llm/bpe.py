"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. A block of documents gives each distinct pre-token a
number and keeps its documents as sequences of numbers (the positions). The blocks'
distinct pre-tokens are shuffled by word, so that each is merged once; its ids go
back to the blocks that have it, where the sequences are reassembled by position.
Decoding looks ids up in the token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .shared import partitions
from .workers import releasing, releasing_group

#: Code points of the documents of a block; a longer document is a block of its own.
BLOCK_CHARS = 4 << 20
PART_CHARS, GROUP = 1 << 19, 1 << 17
#: Bytes of documents for each bucket of words; a task holds the distinct words of one bucket.
BUCKET_BYTES = 128 << 20


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _tables(path: str, kept: dict = {}):  # noqa: B006  one per Python worker
    """Merger of single pre-tokens, and the token-byte table as a ragged array."""
    if path not in kept:
        import tiktoken

        own = ranks(path)
        merger = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=own, special_tokens={})
        by_id: list[bytes] = [b""] * (max(own.values(), default=-1) + 1)
        for token, i in own.items():
            by_id[i] = token
        ends = np.concatenate(([0], np.cumsum([len(t) for t in by_id]))).astype(np.int64)
        kept[path] = merger._core_bpe.encode_single_piece, np.frombuffer(b"".join(by_id), np.uint8), ends
    return kept[path]


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import pyarrow as pa

    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = next((k for k in (1, 2, 3) if not planes[k:].any()), 4)
    return bytes([used]) + len(x).to_bytes(4, "little") + pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True)


def squeeze(b: bytes) -> bytes:
    import pyarrow as pa

    return len(b).to_bytes(8, "little") + (pa.compress(b, codec="zstd", asbytes=True) if b else b"")


def stretch(b: bytes) -> bytes:
    import pyarrow as pa

    n = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], n, codec="zstd", asbytes=True) if n else b""


def unpack(b: bytes) -> np.ndarray:
    import pyarrow as pa

    used, n = b[0], int.from_bytes(b[1:5], "little")
    out = np.zeros((4, n), np.uint8)
    if n:
        out[:used] = np.frombuffer(pa.decompress(b[5:], used * n, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u4").ravel()


class Block:
    """Distinct pre-tokens and number sequences of the documents added so far."""

    def __init__(self) -> None:
        self.number = np.empty(0, np.int64)
        self.seen = np.empty(0, np.uint64)  # hashes in order, with their numbers in the same order
        self.words: list[str] = []
        self.hashes: list[np.ndarray] = []  # of the words, by number
        self.parts: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []
        self.keys: list = []
        self.chars = 0

    def add(self, keys: list, texts: list[str]) -> None:
        joined = "".join(texts)
        cps, bounds = vectext.points(texts)
        starts, ends = vectext.pretokens(cps, bounds)
        found, at, inverse = np.unique(vectext.hashes(cps, starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.seen, found)
        known = np.zeros(len(found), bool)
        if len(self.seen):
            known = self.seen[np.minimum(where, len(self.seen) - 1)] == found
        numbers = np.empty(len(found), np.int64)
        numbers[known] = self.number[where[known]]
        new = np.flatnonzero(~known)
        new = new[np.argsort(at[new])]  # numbered as they appear: frequent ones come early and are small
        numbers[new] = np.arange(len(self.words), len(self.words) + len(new))
        self.words += [joined[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
        self.hashes.append(found[new])
        fresh = np.sort(new)
        self.seen, self.number = np.insert(self.seen, where[fresh], found[fresh]), np.insert(self.number, where[fresh], numbers[fresh])
        self.parts.append(numbers[inverse].astype(np.uint32))
        self.lens.append(np.diff(np.searchsorted(starts, bounds)))
        self.keys += keys
        self.chars += len(joined)

    def add_long(self, key, text: str) -> None:
        """One document in pieces; their pre-tokens are the document's."""
        before = len(self.lens)
        for piece in vectext.pieces(text, PART_CHARS):
            self.add([], [piece])
        self.lens[before:] = [np.sum(self.lens[before:], axis=0)]
        self.keys.append(key)


def blocks(batches, chars: int) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for lo in range(0, len(keys), 256):
            own = batch.column(1).slice(lo, 256).to_pylist()
            for first, texts in vectext.blocks(own, PART_CHARS):
                if len(texts[0]) > 2 * PART_CHARS:
                    block.add_long(keys[lo + first], texts[0])
                else:
                    block.add(keys[lo + first: lo + first + len(texts)], texts)
                if block.chars >= chars:
                    yield block
                    block = Block()
    if block.keys:
        yield block


def _named(block: Block, i: int) -> tuple[bytes, int]:
    """Key and digest of a block; both passes over the documents make the same ones from the same rows."""
    from pyspark import TaskContext

    digest = hashlib.blake2b(digest_size=8)
    for keys in (repr(block.keys), *block.words):
        digest.update(keys.encode("utf-8", "surrogatepass"))
    return TaskContext.get().partitionId() << 32 | i, int.from_bytes(digest.digest(), "little", signed=True)


def encode(docs: DataFrame, path: str, vectors: bool = False, decoded: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Ids of every whole text by the ranks in the file ``path``, and their decoding.

    Columns: doc_id, n_tokens, ids_sha256 (of unsigned 32-bit little-endian ids), decoded_sha256, with
    ``vectors`` also ids (array<int>), and with ``decoded`` also the decoded bytes. A null text is an empty text, with no ids.
    Repeated rows give a row each; an empty table gives none; other columns play no part.

    A block sends its words in one row for each bucket, of which there is one for BUCKET_BYTES of documents; a
    word is in it once however often it occurs, and all blocks' copies of it meet in one bucket's task, which merges it once. The two passes over the documents must cut the same blocks; each word row and each block
    carries a digest of the block, and a difference (an input whose rows change between reads) raises.
    """
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(docs, BUCKET_BYTES)
    word_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("digest", pa.int64()), ("numbers", pa.binary()), ("lens", pa.binary()), ("words", pa.binary())])
    seq_schema = pa.schema([("block", pa.int64()), ("digest", pa.int64()), ("words", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("seq", pa.binary())])
    id_schema = pa.schema([("block", pa.int64()), ("digest", pa.int64()), ("numbers", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary())])

    def distinct(batches):
        for i, block in enumerate(blocks(batches, block_chars)):
            key, digest = _named(block, i)
            bucket = (np.concatenate(block.hashes) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for at in np.split(order, cuts[1:]) if len(order) else []:
                raw = [block.words[k].encode() for k in at.tolist()]
                yield pa.record_batch([[int(bucket[at[0]])], [key], [digest], [pack(np.diff(at, prepend=0))], [pack(np.array(list(map(len, raw))))],
                                       [squeeze(b"".join(raw))]], schema=word_schema)

    def sequences(batches):
        for i, block in enumerate(blocks(batches, block_chars)):
            key, digest = _named(block, i)
            yield pa.record_batch([[key], [digest], [len(block.words)], [block.keys], [pack(np.concatenate(block.lens))], [pack(np.concatenate(block.parts))]], schema=seq_schema)

    def merge(batches):
        piece, at, known = _tables(path)[0], None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != at:  # a bucket's rows come one after the other, and no word is in two buckets
                    at, known = row["bucket"], {}
                raw, got, a = stretch(row["words"]), [], 0
                for size in unpack(row["lens"]).tolist():
                    w = raw[a: a + size]
                    a += size
                    if (ids := known.get(w)) is None:
                        ids = known[w] = piece(w)
                    got.append(ids)
                flat = np.fromiter((i for ids in got for i in ids), np.uint32)
                yield pa.record_batch([[row["block"]], [row["digest"]], [row["numbers"]], [pack(np.fromiter(map(len, got), np.uint32, len(got)))], [pack(flat)]], schema=id_schema)

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                            *[("ids", pa.list_(pa.int32()))] * vectors, *[("decoded", pa.binary())] * decoded])

    def reassemble(seqs: pa.Table, words: pa.Table) -> pa.Table:
        _, token_bytes, token_ends = _tables(path)
        parts = words.to_pylist()
        numbers = np.concatenate([np.empty(0, np.int64), *(np.cumsum(unpack(r["numbers"]).astype(np.int64)) for r in parts)])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(unpack(r["lens"]).astype(np.int64) for r in parts)]))]).astype(np.int64)
        values = np.concatenate([np.empty(0, np.uint32), *(unpack(r["ids"]) for r in parts)])
        order = np.argsort(numbers)
        made: list[tuple] = []
        for row in seqs.to_pylist():
            if len(numbers) != row["words"] or any(r["digest"] != row["digest"] for r in parts):
                raise ValueError("the documents changed between two reads; write them to a table first")
            seq, doc_ends = order[unpack(row["seq"]).astype(np.int64)], np.cumsum(unpack(row["lens"]).astype(np.int64))
            # documents in groups of about GROUP pre-tokens
            begin, d = 0, 0
            while d < len(doc_ends):
                e = max(d + 1, int(np.searchsorted(doc_ends, begin + GROUP, "right")))
                ids, ends = vectext.gather(values, offsets, seq[begin: doc_ends[e - 1]])
                id_ends = np.concatenate(([0], ends))[doc_ends[d:e] - begin]
                text, text_ends = vectext.gather(token_bytes, token_ends, ids.astype(np.int64))
                byte_ends = np.concatenate(([0], text_ends))[id_ends]
                raw, shown, a, x = ids.astype("<u4").tobytes(), text.tobytes(), 0, 0
                for k, b, y in zip(range(d, e), id_ends.tolist(), byte_ends.tolist(), strict=True):
                    made.append((row["doc_ids"][k], b - a, hashlib.sha256(raw[4 * a: 4 * b]).hexdigest(), hashlib.sha256(shown[x:y]).hexdigest(),
                                 *[ids[a:b].astype(np.int32)] * vectors, *[shown[x:y]] * decoded))
                    a, x = b, y
                begin, d = int(doc_ends[e - 1]), e
        columns = list(map(list, zip(*made, strict=True))) if made else [[] for _ in out_schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    merged = rows.mapInArrow(releasing(distinct), "bucket int, block long, digest long, numbers binary, lens binary, words binary").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(
        releasing(merge), "block long, digest long, numbers binary, lens binary, ids binary")
    seqs = rows.mapInArrow(releasing(sequences), "block long, digest long, words int, doc_ids array<long>, lens binary, seq binary")
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * vectors + ", decoded binary" * decoded
    return seqs.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(releasing_group(reassemble), shape)
