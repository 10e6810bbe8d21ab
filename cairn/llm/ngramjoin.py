"""Exact Jaccard join of documents' sets of word n-grams, by filters under several global token orders.

A pair can reach the threshold only if it shares a token among the first
n - ceil(t n) + 1 of both sets, under any order of all tokens. Three orders are used, all
rarest first so that tokens of a single set drop out at once, with different ties and
grains. Sets that could meet under the first order form groups, which the second and
third order split again; within a group a pair must pass all three filters before its
overlap is counted.

Texts are read once. A task writes their words, as numbers, to files of bounded size in the shared
folder, from which sets are made anew, and asks for the frequency of each of a file's tokens once; a token that many sets of a
file have is one number on its way, so a frequent token is counted in parts. Groups are
cut into bins of bounded size, by size band and hash, and bins are compared from their
files: no set is copied for a pair of bins.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectext
from .bpe import pack, unpack
from .components import components
from .shared import drop, fresh_dir, get, materialise, put
from .workers import releasing, releasing_group

WORDS = 5
#: Two sets link if 100 * shared >= THRESHOLD * union.
THRESHOLD = 75
#: Words and texts of a file, tokens of a bucket that is counted at once, tokens of a bin (a set counts as SET_TOKENS more).
FILE_WORDS, FILE_TEXTS, BUCKET_TOKENS, BIN_TOKENS, SET_TOKENS = 1 << 21, 1 << 16, 1 << 21, 1 << 20, 1 << 10
#: Sets that a task remembers in order to write copies once.
MEMO_SETS = 1 << 18
#: Rows of a group that is looked up are dealt to so many parts.
SALTS = 64
_RATES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's words in order, A-Z lower-cased."""
    out: list[np.ndarray] = []

    def hashed(part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cps, bounds = vectext.points(part)
        cps = np.where((cps - np.uint32(65)) <= 25, cps + np.uint32(32), cps)
        starts, ends, first = vectext.words(cps, bounds)
        return vectext.hashes(cps, starts, ends), first

    for _, part in vectext.blocks(texts):
        if len(part[0]) > vectext.PIECE_CHARS:
            out.append(np.concatenate([hashed([piece])[0] for piece in vectext.pieces(part[0], vectext.BLOCK_CHARS)]))
        else:
            h, first = hashed(part)
            out += [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def sets_of(texts: list[np.ndarray], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each sequence of word hashes; all words as one if there are fewer."""
    rates = _RATES if words == WORDS else vectext.mix(np.arange(1, words + 1, dtype=np.uint64) * _RATES[0]) | np.uint64(1)
    h = np.concatenate([np.empty(0, np.uint64), *texts])
    grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words if len(grams) else 0):
        grams += h[k: k + len(grams)] * rates[k]
    grams, out, a = vectext.mix(grams), [], 0
    for own in texts:
        b = a + len(own)
        if b - a >= words:
            out.append(np.unique(grams[a: b - words + 1]))
        elif b > a:
            out.append(vectext.mix((own * rates[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(own)
        a = b
    return out


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    return sets_of(word_hashes(texts), words)


def least_linking(threshold: int) -> int:
    """Sets of fewer tokens link only with equal sets: one token more makes too large a union."""
    return 1 << 62 if threshold >= 100 else -(-threshold // (100 - threshold))


def node_of(tokens: np.ndarray, text: str, words: int = WORDS) -> bytes:
    """128-bit name of a set. Names of one or two tokens are made of the words themselves, as a single 64-bit hash could be met by chance."""
    if len(tokens) > 2:
        return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    w = _WORD.findall(text.translate(_LOWER))
    grams = sorted({"\n".join(w[i: i + words]) for i in range(max(1, len(w) - words + 1))})
    return hashlib.blake2b("\n\n".join(grams).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def framed(texts: list[np.ndarray]) -> bytes:
    """Sequences of word hashes as the content of a file: their lengths, the distinct words, and the words' numbers, all as byte planes."""
    known, index = np.unique(np.concatenate(texts), return_inverse=True)
    parts = [pack(np.array([len(x) for x in texts])), pack(known >> np.uint64(32)), pack(known & np.uint64(0xFFFFFFFF)), pack(index)]
    return np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(parts)


def unframed(content: bytes) -> list[np.ndarray]:
    ends = np.cumsum(np.frombuffer(content[:32], "<i8")) + 32
    sizes, high, low, index = (unpack(content[a:b]) for a, b in zip([32, *ends[:-1].tolist()], ends.tolist(), strict=True))
    words = (high.astype(np.uint64) << np.uint64(32) | low)[index.astype(np.int64)]
    return np.split(words, np.cumsum(sizes.astype(np.int64))[:-1])


#: Stands for a null doc_id; larger than all others, so a null is no component's name where an id can be.
NULL_ID = (1 << 63) - 1


def written(docs: DataFrame, where: str, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Writes the words of all texts, as numbers, to files below ``where`` and returns a row for each document and for each file.

    Documents: key (its id), mark (hash of the text), n (size of its set), node (name of its set), and the place of the
    set, (flush, at), where it is large enough to link with another set. Files: flush, uri, tokens.
    """
    import pyarrow as pa

    schema = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("flush", pa.int64()), ("at", pa.int32()), ("uri", pa.string()), ("tokens", pa.int64())])
    least = least_linking(threshold)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 19
        flush, rows, held, size, memo = first, [], [], 0, {}

        def out():
            nonlocal flush, rows, held, size
            if held:
                uri = f"{where}/{uuid.uuid4().hex}.sets"
                put(uri, framed(held))
                rows.append((None, None, None, None, flush, None, uri, size))
                flush, held, size = flush + 1, [], 0
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                keys, marks, texts = (c.slice(lo, 256).to_pylist() for c in batch.columns)
                hashed = word_hashes(texts)
                for key, mark, text, h, tokens in zip(keys, marks, texts, hashed, sets_of(hashed, words), strict=True):
                    place = node = None
                    if len(tokens):
                        node = node_of(tokens, text, words)
                    if len(tokens) >= least:
                        place = memo.get(node)
                        if place is None:
                            if len(memo) >= MEMO_SETS:
                                memo.clear()
                            place = memo[node] = flush, len(held)
                            held.append(h)
                            size += len(h)
                    rows.append((key, mark, len(tokens), node, *(place or (None, None)), None, None))
                    if size >= FILE_WORDS or len(held) >= FILE_TEXTS:
                        yield from out()
                if len(rows) >= 1 << 14 and not held:
                    yield from out()
        if rows:
            yield from out()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(releasing(run), "key long, mark long, n long, node binary, flush long, at int, uri string, tokens long")


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the token."""
    return (token >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)


def frequencies(files: DataFrame, total: int, words: int = WORDS) -> DataFrame:
    """(flush, bucket, ranks): for the distinct tokens of each file in order, bucket by bucket, how many sets have each.

    Tokens go to buckets of about BUCKET_TOKENS, sorted and as compressed byte planes, each with its number within the file.
    """
    import pyarrow as pa

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(2 * n, -(-total // BUCKET_TOKENS))
    asked = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("many", pa.binary())])
    said = pa.schema([("flush", pa.int64()), ("bucket", pa.int32()), ("ranks", pa.binary())])

    def ask(batches):
        for batch in batches:
            for flush, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                token, many = np.unique(np.concatenate(sets_of(unframed(get(uri)), words)), return_counts=True)
                cuts = np.searchsorted(bucket_of(token, buckets), np.arange(buckets + 1))
                high, low = (token >> np.uint64(32)).astype(np.uint32), (token & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[b], cuts[b + 1])
                    yield pa.record_batch([[b], [flush], [pack(high[own])], [pack(low[own])], [pack(many[own])]], schema=asked)

    def count(table: pa.Table) -> pa.Table:
        high, low, many = ([unpack(x) for x in table.column(c).to_pylist()] for c in ("high", "low", "many"))
        sizes = [len(x) for x in low]
        token = np.concatenate(high).astype(np.uint64) << np.uint64(32) | np.concatenate(low)
        order = np.argsort(token, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(token[order]) > 0)))
        sums = np.add.reduceat(np.concatenate(many).astype(np.int64)[order], first)
        rank = np.empty(len(token), np.uint32)
        # beyond 32 bits frequencies are equal, and ties have an order of their own
        rank[order] = np.repeat(np.minimum(sums, (1 << 32) - 1), np.diff(np.append(first, len(token)))).astype(np.uint32)
        return pa.table([table.column("flush"), table.column("bucket"), [pack(x) for x in np.split(rank, np.cumsum(sizes)[:-1])]], schema=said)

    many_files = max(1, min(4 * n, files.count()))
    return files.select("flush", "uri").repartition(many_files, "uri").mapInArrow(releasing(ask), "bucket int, flush long, high binary, low binary, many binary").groupBy("bucket").applyInArrow(
        releasing_group(count), "flush long, bucket int, ranks binary")


SETS = "owner long, n long, tokens array<long>, p1 array<long>, p2 array<long>, p3 array<long>"


def prefixes(files: DataFrame, firsts: DataFrame, ranks: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """SETS rows of those of the sets at ``firsts`` (flush, at) whose prefix holds a token that another set has; tokens of that set alone are left out.

    Tokens of one set come first under every order and link nothing, so a prefix is cut by their number.
    """
    import pyarrow as pa

    longs = pa.list_(pa.int64())
    schema = pa.schema([("owner", pa.int64()), ("n", pa.int64()), *((c, longs) for c in ("tokens", "p1", "p2", "p3"))])

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        uri = next((u for u in table.column("uri").to_pylist() if u), None)
        chosen = np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in table.column("ats").to_pylist() if x is not None)])
        if uri is None or not len(chosen):
            return schema.empty_table()
        each = sets_of(unframed(get(uri)), words)
        tokens, sizes = np.concatenate(each), np.array(list(map(len, each)), np.int64)
        _, inverse = np.unique(tokens, return_inverse=True)
        rank = np.concatenate([unpack(x) for x in table.column("ranks").to_pylist() if x is not None])[inverse].astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        shared = np.bincount(owner[rank > 1], minlength=len(sizes))
        # the ceiling of t n, in whole numbers
        room = sizes - (sizes * threshold + 99) // 100 + 1 - (sizes - shared)
        wanted = np.zeros(len(sizes), bool)
        wanted[chosen] = True
        wanted &= room > 0
        keep = wanted[owner] & (rank > 1)
        token, rank, owner = tokens[keep], rank[keep], owner[keep]
        sets = np.flatnonzero(wanted)
        ends = np.concatenate(([0], np.cumsum(shared[sets])))
        nth = np.arange(len(token)) - np.repeat(ends[:-1], shared[sets])
        flush = table.column("flush")[0].as_py()
        columns = [pa.array(flush << 20 | sets), pa.array(sizes[sets]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token.view(np.int64)))]
        coarse = np.floor(np.log2(np.maximum(rank, 1))).astype(np.int64)
        for by, tie in ((rank, token), (rank, vectext.mix(token ^ _RATES[1])), (coarse, vectext.mix(token ^ _RATES[2]))):
            order = np.lexsort((tie, by, owner))
            head = nth < np.repeat(room[sets], shared[sets])
            at = np.concatenate(([0], np.cumsum(np.minimum(room[sets], shared[sets]))))
            columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(token[order][head].view(np.int64))))
        return pa.table(columns, schema=schema)

    rows = ranks.select("flush", "bucket", "ranks", F.lit(None).cast("array<int>").alias("ats"), F.lit(None).cast("string").alias("uri")).union(
        firsts.groupBy("flush").agg(F.collect_list("at").alias("ats")).select("flush", F.lit(-1), F.lit(None).cast("binary"), "ats", F.lit(None).cast("string"))).union(
        files.select("flush", F.lit(-2), F.lit(None).cast("binary"), F.lit(None).cast("array<int>"), "uri"))
    # few rows are much work: a task has a file or so
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(max(n, min(1 << 16, files.count())), "flush").groupBy("flush").applyInArrow(releasing_group(cut), SETS)


def meeting(sets: DataFrame) -> DataFrame:
    """(owner, group): sets linked by tokens of the first order's prefixes, and so again by the second's and third's within a group.

    A token ties all its sets to the smallest of them, so tokens of many sets cost a row for each set and no pairs.
    """
    groups = sets.select("owner", F.lit(0).cast("long").alias("group"))
    for k in ("p1", "p2", "p3"):
        tied = sets.select("owner", F.explode(k).alias("token")).join(groups, "owner")
        pivot = tied.groupBy("token", "group").agg(F.min("owner").alias("pivot"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
        edges = tied.join(pivot, ["token", "group"]).select(F.col("owner").alias("a"), F.col("pivot").alias("b"))
        groups = materialise(components(edges, "ngram-groups").select(F.col("node").alias("owner"), F.col("component").alias("group")), "ngram-groups")
    return groups


def overlaps(at_a: np.ndarray, token_a: np.ndarray, n_a: int, at_b: np.ndarray, token_b: np.ndarray, n_b: int) -> np.ndarray:
    """Tokens that each row of a shares with each row of b. Frequent tokens by matrix products, the others by their few pairs."""
    out = np.zeros((n_a, n_b), np.float32)
    both = np.intersect1d(token_a, token_b)
    if not len(both):
        return out
    ia, ib = np.searchsorted(both, token_a), np.searchsorted(both, token_b)
    own_a, own_b = both[np.minimum(ia, len(both) - 1)] == token_a, both[np.minimum(ib, len(both) - 1)] == token_b
    ia, at_a, ib, at_b = ia[own_a], at_a[own_a], ib[own_b], at_b[own_b]
    ca, cb = np.bincount(ia, minlength=len(both)), np.bincount(ib, minlength=len(both))
    dense = ca * cb > 64
    place = np.cumsum(dense) - 1
    da, db = dense[ia], dense[ib]
    for lo in range(0, int(dense.sum()), 4096):
        a, b = place[ia], place[ib]
        ma, mb = da & (a >= lo) & (a < lo + 4096), db & (b >= lo) & (b < lo + 4096)
        left, right = np.zeros((n_a, 4096), np.float32), np.zeros((n_b, 4096), np.float32)
        left[at_a[ma], a[ma] - lo] = 1
        right[at_b[mb], b[mb] - lo] = 1
        out += left @ right.T
    ia, at_a, ib, at_b = ia[~da], at_a[~da], ib[~db], at_b[~db]
    order = np.argsort(ib, kind="stable")
    ib, at_b = ib[order], at_b[order]
    first, last = np.searchsorted(ib, ia), np.searchsorted(ib, ia, "right")
    many = last - first
    if many.sum():
        ends = np.cumsum(many)
        which = np.arange(ends[-1]) - np.repeat(ends - many - first, many)
        np.add.at(out, (np.repeat(at_a, many), at_b[which]), 1)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the edges (a, b) connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def band_of(n: Column, threshold: int) -> Column:
    """Sets two bands apart differ too much in size to link."""
    return F.floor(F.log(n.cast("double")) / F.lit(np.log(100 / threshold) * 1.001 if threshold < 100 else 1e-9)).cast("long")


def salted(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows join few on ``keys`` and a salt, so that no key's rows meet in one task; ``rows`` has ``owner``, ``few`` one row a key."""
    a = rows.withColumn("salt", F.pmod(F.xxhash64("owner", F.lit(5)), F.lit(SALTS)).cast("int"))
    b = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, [*keys, "salt"], how).drop("salt")


def _ragged(rows, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column(name).combine_chunks()
    lens = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lens), column.flatten().to_numpy()


def matched(a, b, same: bool, threshold: int, most: int = 1024) -> np.ndarray:
    """Pairs of owners that connect what the links between the rows of ``a`` and ``b`` (SETS tables of one group) connect."""
    found = [np.empty((0, 2), np.int64)]
    for i in range(0, a.num_rows, most):
        for j in range(i if same else 0, b.num_rows, most):
            found.append(_matched(a.slice(i, most), b.slice(j, most), same and i == j, threshold))
    return np.concatenate(found)


def _matched(a, b, same: bool, threshold: int) -> np.ndarray:
    na, nb = a.column("n").to_numpy(), b.column("n").to_numpy()
    own_a, own_b = a.column("owner").to_numpy(), b.column("owner").to_numpy()
    met = np.minimum.outer(na, nb) * 100 >= np.maximum.outer(na, nb) * threshold
    met = np.triu(met, 1) if same else met & (own_a[:, None] != own_b[None, :])
    for name in ("p1", "p2", "p3"):
        if not met.any():
            return np.empty((0, 2), np.int64)
        met &= overlaps(*_ragged(a, name), len(na), *_ragged(b, name), len(nb)) > 0
    if not met.any():
        return np.empty((0, 2), np.int64)
    shared = overlaps(*_ragged(a, "tokens"), len(na), *_ragged(b, "tokens"), len(nb))
    u, v = np.nonzero(met & (100 * shared >= threshold * (np.add.outer(na, nb) - shared)))
    names, at = np.unique(np.concatenate((own_a[u], own_b[v])), return_inverse=True)
    label = forest(at[: len(u)], at[len(u):], len(names))
    far = label != np.arange(len(names))
    return np.column_stack((names[far], names[label[far]]))


def _table(content: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(content).read_all().combine_chunks()


BIN = "a long, b long, group long, band long, slice int, uri string"


def binned(sets: DataFrame, where: str, threshold: int) -> DataFrame:
    """``sets``: SETS with group, band and slice. Compares the sets of each bin; a bin of one group alone (group >= 0) is also written to a file.

    Returns rows of linked pairs (a, b) and of files (group, band, slice, uri).
    """
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64()), ("band", pa.int64()), ("slice", pa.int32()), ("uri", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["owner", "n", "tokens", "p1", "p2", "p3", "of"]).combine_chunks()
        uri = None
        group, band, part = (table.column(c)[0].as_py() for c in ("group", "band", "slice"))
        if group >= 0:
            uri = f"{where}/{uuid.uuid4().hex}.bin"
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            put(uri, sink.getvalue().to_pybytes())
            pairs = matched(rows, rows, True, threshold)
        else:
            of = rows.column("of").to_numpy()
            order = np.argsort(of, kind="stable")
            rows, of = rows.take(pa.array(order)).combine_chunks(), of[order]
            cuts = [*np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist(), len(of)]
            pairs = np.concatenate([np.empty((0, 2), np.int64), *(matched(own, own, True, threshold) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j - i > 1 for own in [rows.slice(i, j - i)])])
        n = len(pairs)
        none = lambda k, t: pa.nulls(k, t)
        links = pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.string())], schema=schema)
        if uri is None:
            return links
        return pa.concat_tables([links, pa.table([none(1, pa.int64()), none(1, pa.int64()), [group], [band], pa.array([part], pa.int32()), [uri]], schema=schema)])

    return sets.groupBy("group", "band", "slice").applyInArrow(releasing_group(run), BIN)


def tiled(tiles: DataFrame, threshold: int) -> DataFrame:
    """Linked pairs (a, b) between the two files of each of ``tiles`` (left, right)."""
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held = None, None
        for batch in batches:
            for left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] != left:
                    held = left, _table(get(left))
                pairs = matched(held[1], _table(get(right)), False, threshold)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    n = max(1, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tiles.select("left", "right").repartition(max(n, min(1 << 16, tiles.count() // 8)), "left", F.pmod(F.xxhash64("right"), F.lit(8))).sortWithinPartitions("left").mapInArrow(releasing(run), "a long, b long")


def links(sets: DataFrame, groups: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of linked owners that connect what all links connect; ``sets``: SETS, ``groups``: (owner, group).

    Groups of less than half a bin share bins. A larger group is dealt to bins of its own, by
    band of size and hash; each is compared with itself and with the next. Most sets of a group
    of near copies are one component then; what isn't, the strays, is compared with all bins of the group
    whose sizes allow a link. Two sets that are linked and not yet connected have a stray among them, so no link is
    missed; the work is that of strays times members, not of members squared.
    """
    spark = sets.sparkSession
    where = fresh_dir(spark, "ngram-bins")
    weight = F.size("tokens") + SET_TOKENS
    placed = materialise(groups.join(sets.select("owner", band_of(F.col("n"), threshold).alias("band"), weight.cast("long").alias("weight")), "owner"), "ngram-placed")
    cells = placed.groupBy("group", "band").agg(F.sum("weight").alias("weight"))
    # a group's bands are few, whatever its size
    large = materialise(cells.join(cells.groupBy("group").agg(F.sum("weight").alias("whole")).where(F.col("whole") > BIN_TOKENS // 2), "group").select(
        "group", "band", F.ceil(F.col("weight") / BIN_TOKENS).cast("int").alias("slices")), "ngram-large")
    bins = max(1, -(-(placed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]) // BIN_TOKENS))
    own = F.col("slices").isNotNull()
    put_in = salted(placed, large, ["group", "band"], "left").select(
        "owner", F.col("group").alias("of"), F.when(own, F.col("group")).otherwise(F.lit(-1)).alias("group"), F.when(own, F.col("band")).otherwise(F.lit(0)).alias("band"),
        F.when(own, F.pmod(F.xxhash64("owner", F.lit(7)), F.col("slices"))).otherwise(F.pmod(F.xxhash64("group"), F.lit(bins))).cast("int").alias("slice"))
    found = materialise(binned(put_in.join(sets, "owner"), where, threshold), "ngram-links")
    pairs, files = found.where("uri IS NULL").select("a", "b"), found.where("uri IS NOT NULL").select("group", "band", "slice", "uri")
    if files.isEmpty():
        return pairs
    # rows of windows and tiles are files, not sets
    chain = files.select(F.col("uri").alias("left"), F.lead("uri").over(Window.partitionBy("group").orderBy("band", "slice")).alias("right")).where("right IS NOT NULL")
    pairs = pairs.union(materialise(tiled(chain, threshold), "ngram-links"))
    parts = components(pairs, "ngram-near")
    members = salted(placed, large.select("group").distinct(), ["group"], "left_semi")
    named = materialise(members.join(parts.withColumnRenamed("node", "owner"), "owner", "left").select("owner", "group", "band", "weight", F.coalesce("component", "owner").alias("part")), "ngram-named")
    main = named.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    strays = materialise(salted(named, main, ["group"], "inner").where("part <> main").select("owner", "group", "band", "weight"), "ngram-strays")
    some = strays.groupBy("group", "band").agg(F.ceil(F.sum("weight") / BIN_TOKENS).cast("int").alias("slices"))
    dealt = salted(strays, some, ["group", "band"], "inner").select("owner", F.col("group").alias("of"), "group", "band", F.pmod(F.xxhash64("owner", F.lit(11)), F.col("slices")).cast("int").alias("slice"))
    again = materialise(binned(dealt.join(sets, "owner"), where, threshold), "ngram-links")
    x, y = again.where("uri IS NOT NULL").alias("x"), files.alias("y")
    tiles = materialise(x.join(y, (F.col("x.group") == F.col("y.group")) & F.col("y.band").between(F.col("x.band") - 1, F.col("x.band") + 1)).select(F.col("x.uri").alias("left"), F.col("y.uri").alias("right")), "ngram-tiles")
    far = materialise(tiled(tiles, threshold), "ngram-links")
    drop(spark, where, placed, large, named, strays, tiles)
    return pairs.union(again.where("uri IS NULL").select("a", "b")).union(far)


def labelled(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(key, mark, n, part, least) of every row of (doc_id, text): its id or NULL_ID, a hash of its text, the size of its set, its component and the least key of that (null for an empty set)."""
    spark = docs.sparkSession
    where = fresh_dir(spark, "ngram-files")
    found = materialise(written(docs, where, words, threshold), "ngram-documents")
    rows, files = found.where("uri IS NULL"), found.where("uri IS NOT NULL").select("flush", "uri", "tokens")
    # copies are one node from here on, named by the first of their places
    nodes = materialise(rows.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min(F.struct("flush", "at")).alias("place")).select(
        "node", "key", "place.*", F.shiftleft("place.flush", 20).bitwiseOR(F.col("place.at")).alias("owner")), "ngram-nodes")
    total = files.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    ranks = frequencies(files, total, words)
    sets = materialise(prefixes(files, nodes.where("flush IS NOT NULL").select("flush", "at"), ranks, words, threshold), "ngram-sets")
    drop(spark, where)
    groups = meeting(sets)
    linked = materialise(links(sets, groups, threshold), "ngram-linked")
    drop(spark, sets, groups)
    parts = components(linked, "ngram-parts").withColumnRenamed("node", "owner")
    named = nodes.join(parts, "owner", "left").select(F.col("node").alias("set"), "key", F.coalesce("component", "owner").alias("component"))
    # a set too small to link has no place: it is a component itself
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("key").alias("least"))
    whole = named.join(least, "component", "left").select("set", F.coalesce(F.col("component").cast("string").cast("binary"), "set").alias("part"), F.coalesce("least", "key").alias("least"))
    return rows.join(whole, F.col("node") == F.col("set"), "left").select("key", "mark", "n", "part", "least")


def join(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of every row of (doc_id, text).

    Equal sets are one node throughout, so copies cost nothing after the first step. A text without
    words, or null, has an empty set and links with nothing: its component is its own id. Rows of
    one doc_id get a row each; a null doc_id names a component only if all its members are null.
    An empty table gives an empty result; other columns of the input play no part.

    Tokens are 64-bit hashes; sets that can link with an unequal set share three of them at least at the
    usual threshold, and smaller sets are named by their words.
    """
    own = F.nullif("key", F.lit(NULL_ID))
    return labelled(docs, words, threshold).select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, own).otherwise(F.nullif("least", F.lit(NULL_ID))).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component of ``docs``, with the columns of ``docs``: that of the least doc_id, of those the least hash of the text.

    Texts without words link with nothing and stay; of rows with the same id and text one stays.
    """
    spare = lambda name: name if name not in docs.columns else spare(name + "_")
    key, mark, nth = spare("key"), spare("mark"), spare("nth")
    found = materialise(labelled(docs, words, threshold), "ngram-labels")
    first = found.where("n > 0 AND key = least").groupBy("part").agg(F.min("key").alias("key"), F.min("mark").alias("mark")).select("key", "mark")
    first = first.union(found.where("n = 0").select("key", "mark")).select(F.col("key").alias(key), F.col("mark").alias(mark)).distinct()
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(mark, F.xxhash64("text"))
    same = Window.partitionBy(key, mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return rows.join(first, [key, mark], "left_semi").withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
