"""Texts as arrays: code points, word and pre-token spans, and 64-bit hashes of spans.

Everything works on a block of texts at once, so its memory is some tens of bytes
for each code point of the block; ``blocks`` cuts a batch of texts accordingly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_CHARS = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD1342543DE82EF95)


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) with about ``chars`` code points each; a longer text is a block of its own."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > chars:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


#: Texts beyond this many code points are worked on in pieces.
PIECE_CHARS = 1 << 22


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces of at least ``chars`` code points, but for the last, each beginning with a single space between two words.

    No word, pre-token or contraction crosses such a place. A text without one stays whole.
    """
    start, n = 0, len(text)
    while n - start > chars:
        at = text.find(" ", start + chars)
        while 0 <= at < n - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at >= n - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text begins (and the last ends)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run crosses a text's bound."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (edge[:-1] | ~before)), np.flatnonzero(inside & (edge[1:] | ~after)) + 1


def is_space(cps: np.ndarray) -> np.ndarray:
    """Space and the controls 9 to 13."""
    return (cps == 32) | ((cps - np.uint32(9)) <= 4)


def words(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and the index of each text's first word (and one past the last): runs of anything but is_space."""
    starts, ends = spans(~is_space(cps), bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are in order and don't overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    pos = np.arange(starts[0], ends[-1])
    mark = np.zeros(len(pos) + 1, np.int64)
    mark[starts - starts[0]] = starts
    pos -= np.maximum.accumulate(mark[:-1])
    own = pos < np.repeat(lens, np.diff(np.concatenate((starts, ends[-1:]))))
    powers = np.cumprod(np.full(int(lens.max()), _STEP))
    x = (cps[starts[0]:ends[-1]].astype(np.uint64) + np.uint64(1)) * _MULT
    x ^= x >> np.uint64(32)
    x *= powers[np.minimum(pos, len(powers) - 1)]
    x[~own] = 0
    return mix(np.add.reduceat(x, starts - starts[0]) + lens.astype(np.uint64) * _MIX2)


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of the ragged array (values, offsets), one after the other, and where each ends."""
    lens = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(lens)
    if not len(which) or not ends[-1]:
        return values[:0], ends
    at = np.arange(ends[-1])
    at += np.repeat(offsets[:-1][which] - (ends - lens), lens)
    return values[at], ends


_CLASSES: np.ndarray | None = None
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other, as the pre-tokenizers' patterns see them."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
        _CLASSES = table
    return _CLASSES


def pretokens(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of public_tokenizers.PATTERN in each text.

    Runs of one class are tokens and take a single space before them. Of a longer run
    of white space all but its last character is a token; at a text's end the whole run is.
    An apostrophe that no space joins, alone before letters, takes a contraction's letters.
    """
    n = len(cps)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = classes()[cps]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | first[:-1]
    run = np.flatnonzero(change)  # starts of runs
    stop = np.concatenate((run[1:], [n]))
    k = kind[run]
    at_end = first[stop]
    start = np.zeros(n + 1, bool)
    start[run] = True
    start[n] = True
    white = k == SPACE
    inner = white & ~at_end  # white space before something
    last = stop[inner] - 1
    start[last] = True  # all but the last character is a token of its own
    joined = cps[last] == 32  # a space belongs to what follows
    start[stop[inner][joined]] = False
    # contractions
    quote = (k == OTHER) & (stop - run == 1) & (cps[run] == 39) & ~at_end & start[run]
    for q in run[quote]:
        nxt = q + 1
        if kind[nxt] != LETTER:
            continue
        a = chr(cps[nxt])
        b = chr(cps[nxt + 1]) if nxt + 1 < n and not first[nxt + 1] else ""
        took = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
        if took:
            start[nxt] = False
            start[nxt + took] = True
    at = np.flatnonzero(start)
    return at[:-1], at[1:]


#: The characters whose neighbours a normalizer never changes end before this code point.
PLAIN = 0x300


def fine_spans(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where the class changes: runs of letters, single numbers, runs of others, contractions.

    As words(), starts, ends and each text's first. A word with a character that normalizing may join to
    its neighbours or change in class (from PLAIN on, unusual white space, dotted capital I) stays whole.
    """
    starts, ends, _ = words(cps, bounds)
    if not len(starts):
        return starts, ends, np.searchsorted(starts, bounds)
    kind = classes()[cps]
    glue = (cps >= PLAIN) | (cps == 0x130) | ((kind == SPACE) & ~is_space(cps)) | ((cps >= 28) & (cps < 32))
    so_far = np.concatenate(([0], np.cumsum(glue)))
    whole = so_far[ends] > so_far[starts]
    cut = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)))
    inside = np.zeros(len(cps) + 1, np.int8)
    inside[starts[~whole]] += 1
    inside[ends[~whole]] -= 1
    cut &= np.cumsum(inside[:-1]) > 0
    cut[starts] = True
    at = np.flatnonzero(cut)
    to = np.minimum(np.append(at[1:], len(cps)), ends[np.searchsorted(ends, at, "right")])
    begins = np.zeros(len(cps) + 1, bool)
    begins[starts] = True
    quote = np.flatnonzero((cps[at] == 39) & (to - at == 1) & ~begins[to])
    moved = {}
    for q in quote.tolist():
        if q + 1 < len(at) and at[q + 1] == to[q] and kind[at[q + 1]] == LETTER:
            a, size = int(at[q + 1]), int(to[q + 1] - at[q + 1])
            text = "".join(map(chr, cps[a: a + min(2, size)])).lower()
            took = 1 if text[0] in "stmd" else 2 if text in ("re", "ve", "ll") else 0
            if took:
                moved[q] = took
    if moved:
        q = np.array(list(moved))
        to[q] += list(moved.values())
        at[q + 1] = to[q]
        keep = at < to
        at, to = at[keep], to[keep]
    return at, to, np.searchsorted(at, bounds)
