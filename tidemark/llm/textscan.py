"""Array scans over slices of whole texts: character classes, token spans, span hashes and comparisons, in numpy.

A slice is some whole documents laid end to end as code points; a document longer than the slice size makes a
slice of its own, so that memory follows the longest text, not the batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow.compute as pc

SLICE_CHARS = 1 << 16
#: Rows, and about the bytes, of an Arrow batch that are Python strings at one time.
ROWS, CHUNK_BYTES = 512, 1 << 20
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode White_Space, fixed by the standard.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
U = np.uint64


@lru_cache(1)
def classes() -> np.ndarray:
    major = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
    out = np.zeros(0x110000, np.int8)
    out[major == ord("L")] = LETTER
    out[major == ord("N")] = NUMBER
    out[WHITE] = SPACE
    return out


@lru_cache(1)
def lower_codes() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Code points to a block: three fill 63 bits, so that equal blocks mean equal letters.
TRIPLE = 3
#: Blocks of a span that are chained; what a longer one has beyond them is chained as one digest.
CHAINED = 32
_MASKS = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], np.uint64)


def packed(codes: np.ndarray) -> np.ndarray:
    """At each place, the block of the code points there and at the next two."""
    wide = np.zeros(len(codes) + TRIPLE, np.uint64)
    wide[: len(codes)] = codes
    out = wide[2:] << U(21)
    out |= wide[1:-1]
    out <<= U(21)
    out |= wide[:-2]
    return out


def span_hashes(blocks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span that chains its blocks; each step is a bijection of hash and block, so nothing cancels out."""
    left = end - start
    out = mix(left.astype(np.uint64) * U(GOLDEN) ^ (blocks[start] & _MASKS[np.minimum(left, TRIPLE)]))
    live = np.flatnonzero(left > TRIPLE)
    at, left = start[live] + TRIPLE, left[live] - TRIPLE
    for _ in range(CHAINED - 1):
        if not len(live):
            return out
        out[live] = mix(out[live] * U(GOLDEN) ^ (blocks[at] & _MASKS[np.minimum(left, TRIPLE)]))
        more = np.flatnonzero(left > TRIPLE)
        live, at, left = live[more], at[more] + TRIPLE, left[more] - TRIPLE
    for i, a, n in zip(live.tolist(), at.tolist(), left.tolist(), strict=True):
        digest = int.from_bytes(blake2b(_own_blocks(blocks, a, n).tobytes(), digest_size=8).digest(), "little")
        out[i] = mix(out[i : i + 1] * U(GOLDEN) ^ U(digest))[0]
    return out


def _own_blocks(blocks: np.ndarray, at: int, n: int) -> np.ndarray:
    own = blocks[at : at + n : TRIPLE].copy()
    own[-1] &= _MASKS[(n - 1) % TRIPLE + 1]
    return own


def same_spans(blocks: np.ndarray, start: np.ndarray, end: np.ndarray, others: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each span has the letters of the other one."""
    out = end - start == other_end - other_start
    live = np.flatnonzero(out & (end > start))
    at, to, left = start[live], other_start[live], (end - start)[live]
    while len(live):
        good = ((blocks[at] ^ others[to]) & _MASKS[np.minimum(left, TRIPLE)]) == 0
        out[live[~good]] = False
        more = np.flatnonzero(good & (left > TRIPLE))
        live, at, to, left = live[more], at[more] + TRIPLE, to[more] + TRIPLE, left[more] - TRIPLE
        if len(live) and len(live) < 4:
            break
    for i, a, b, n in zip(live.tolist(), at.tolist(), to.tolist(), left.tolist(), strict=True):
        out[i] = np.array_equal(_own_blocks(blocks, a, n), _own_blocks(others, b, n))
    return out


def classes_of(hashes: np.ndarray, blocks: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one span for each distinct text, class of each span); letters are compared, so that a shared hash is not enough."""
    _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    if len(first) == len(hashes):
        return first, at
    rep = first[at]
    odd = np.flatnonzero(~same_spans(blocks, start, end, blocks, start[rep], end[rep]))
    for i in odd.tolist():  # two texts of one hash: as good as never
        at[i] = len(first)
        first = np.append(first, i)
    return first, at


class Slice:
    """Whole texts as one array of code points; ``edges`` has where each begins and the last ends."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.text = "".join(texts)
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def begins(self) -> np.ndarray:
        flags = np.zeros(len(self.codes) + 1, bool)
        flags[self.edges] = True
        return flags[:-1]

    def doc_of(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, start, side="right") - 1


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, Slice]]:
    """(index of the first text, slice) over all texts."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, Slice(texts[first:i])
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, Slice(texts[first:])


def row_chunks(column) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of parts of an Arrow string column, some rows and about some bytes at a time."""
    sizes = pc.binary_length(column)
    total = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(total, total[at] + CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, at + 1), at + ROWS, len(column))
        yield at, stop
        at = stop


def text_chunks(column) -> Iterator[tuple[int, list[str]]]:
    """(index of the first row, texts) of an Arrow string column, part by part; null is the empty text."""
    for at, stop in row_chunks(column):
        yield at, [t or "" for t in column.slice(at, stop - at).to_pylist()]


def slices_of(column) -> Iterator[tuple[int, Slice]]:
    """(index of the first row, slice) over an Arrow string column."""
    for at, texts in text_chunks(column):
        for first, s in slices(texts):
            yield at + first, s


def _contractions(codes: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> None:
    """Move starts for ``'s 't 're 've 'm 'll 'd`` where an apostrophe begins a token."""
    n = len(codes)
    at = np.flatnonzero((codes == 39) & starts)
    at = at[at + 1 < n]
    at = at[~begins[at + 1]]
    if not len(at):
        return
    one = codes[at + 1]
    short = at[np.isin(one, [ord(c) for c in "stmd"])]
    long_ = at[(at + 2 < n)]
    long_ = long_[~begins[long_ + 2]]
    pair = codes[long_ + 1].astype(np.int64) * 0x110000 + codes[long_ + 2]
    long_ = long_[np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])]
    for p, size in ((short, 2), (long_, 3)):
        starts[p + 1] = begins[p + 1]
        after = p + size
        starts[after[after < n]] = True


def spans(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Matches of ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+`` in each text; they cover it."""
    codes, begins = s.codes, s.begins()
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes()[codes]
    new = begins.copy()
    new[1:] |= cls[1:] != cls[:-1]
    starts = new.copy()
    after = np.flatnonzero(new & (cls != SPACE) & ~begins)
    after = after[cls[after - 1] == SPACE]
    starts[after - 1] = True
    starts[after[codes[after - 1] == 32]] = False
    _contractions(codes, starts, begins)
    start = np.flatnonzero(starts)
    return start, np.append(start[1:], n)


def plain_spans(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Matches of ``'s|'t|'re|'ve|'m|'ll|'d|L+|N|[^sLN]+`` in each text; white space is left out."""
    codes, begins = s.codes, s.begins()
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes()[codes]
    new = begins.copy()
    new[1:] |= cls[1:] != cls[:-1]
    new |= cls == NUMBER
    _contractions(codes, new, begins)
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    keep = cls[start] != SPACE
    return start[keep], end[keep]


def runs(s: Slice, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` code points inside each text."""
    begins = s.begins()
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member & (begins | ~np.concatenate([[False], member[:-1]]))
    ends_here = member & np.concatenate([begins[1:] | ~member[1:], [True]])
    return np.flatnonzero(first), np.flatnonzero(ends_here) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the given ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out_start = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - out_start, lengths)


class Memo:
    """What was made of strings before, by the string itself. Of two halves the older goes when the newer is full."""

    def __init__(self, limit: int):
        self.limit, self.size = limit // 2, 0
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key: str):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key: str, value) -> None:
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += 200 + 2 * len(key) + (len(value) if isinstance(value, bytes) else 0)


class PerfectHash:
    """A minimal perfect hash from strings to values: hash and displace, one slot for each string.

    A span counts as found only if its letters are those of the string in its slot.
    """

    def __init__(self, strings: list[str], values: list[int]):
        n = self.n = len(strings)
        mask = (1 << 64) - 1
        s = Slice(strings)
        blocks = packed(s.codes)
        listed = span_hashes(blocks, s.edges[:-1], s.edges[1:]).tolist()

        def slot(key: int, d: int) -> int:
            x = (key + d * GOLDEN) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            return (x ^ (x >> 31)) % n

        buckets: dict[int, list[int]] = {}
        for i, k in enumerate(listed):
            buckets.setdefault((k >> 32) % n, []).append(i)
        self.displace = np.zeros(n, np.int32)
        taken, order = bytearray(n), np.zeros(n, np.int64)
        free = None
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) > 1:
                d = 1
                while True:
                    got = [slot(listed[i], d) for i in members]
                    if len(set(got)) == len(got) and not any(taken[g] for g in got):
                        break
                    d += 1
                self.displace[b] = d
            else:
                free = free if free is not None else iter([i for i in range(n) if not taken[i]])
                got = [next(free)]
                self.displace[b] = -got[0] - 1
            for i, g in zip(members, got, strict=True):
                taken[g] = 1
                order[g] = i
        self.values, self.blocks = np.asarray(values, np.int32)[order], blocks
        self.start, self.end = s.edges[:-1][order].astype(np.int32), s.edges[1:][order].astype(np.int32)
        self.keys = np.array(listed, np.uint64)[order]

    def find(self, keys: np.ndarray, blocks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The value of each span, given its hash; -1 where the string is not there."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        d = self.displace[(keys >> U(32)) % U(self.n)].astype(np.int64)
        at = -d - 1
        moved = np.flatnonzero(d >= 0)
        at[moved] = (mix(keys[moved] + d[moved].astype(np.uint64) * U(GOLDEN)) % U(self.n)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(self.keys[at] == keys)
        own = at[hit]
        hit = hit[same_spans(blocks, start[hit], end[hit], self.blocks, self.start[own].astype(np.int64), self.end[own].astype(np.int64))]
        out[hit] = self.values[at[hit]]
        return out
