"""Token counts with a whole-token shortcut, for a BPE vocabulary with word ends.

Offline, every vocabulary string that ends a word is merged alone; those that come out as one token make the shortcut
table. A pre-token in that table counts as one without merging; only the others are merged, each distinct one once.

Defined cases: null text counts as empty (0 tokens, 0 bytes); special strings inside a text count as one token each,
as the library does by default; texts of any length are counted whole; repeated rows are kept; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textscan import SLICE_CHARS, Memo, PerfectHash, Slice, classes_of, packed, plain_spans, slices, span_hashes, text_chunks

#: Bytes of text that a worker remembers of pre-tokens it has merged.
MEMO_BYTES = 24 << 20


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return [letters[b] for b in range(256)]


class Counter:
    """Tables of a vocabulary file; of fixed size, built once on the driver and broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.letters = _byte_letters()
        self.ids = {w: i for w, i in vocabulary.items()}
        self.rank = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault(self.ids[a] << 20 | self.ids[b], (i, self.ids[a + b]))
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int32)[order]
        self.result = np.array([self.ids[a + b] for a, b in merges], np.int64)
        self.of_byte = np.array([self.ids[c] for c in self.letters], np.int64)
        self.of_last = np.array([self.ids[c + self.suffix] for c in self.letters], np.int64)
        back = {c: b for b, c in enumerate(self.letters)}
        words = [w.removesuffix(self.suffix) for w in vocabulary if w.endswith(self.suffix) and w not in self.specials]
        raws = [bytes(back[c] for c in w) for w in words if w and all(c in back for c in w)]
        proven = []
        for raw, size in zip(raws, self.merged_many(raws).tolist(), strict=True):
            if size == 1:
                try:
                    proven.append(raw.decode())
                except UnicodeDecodeError:
                    continue
        self.whole = PerfectHash(proven, [1] * len(proven))

    def first_ids(self, raw: bytes) -> list[int]:
        return [self.ids[self.letters[b]] for b in raw[:-1]] + [self.ids[self.letters[raw[-1]] + self.suffix]]

    def merged(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        return self.merged_long(self.first_ids(raw))

    def merged_many(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token: those of up to 32 bytes merge in step, one pair each, as rows of a matrix."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        out = np.zeros(len(pieces), np.int64)
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 18), (18, 32)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                out[rows] = self._in_step([pieces[i] for i in rows.tolist()], sizes[rows], high)
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = self.merged(pieces[i])
        return out

    def _in_step(self, pieces: list[bytes], left: np.ndarray, width: int) -> np.ndarray:
        big = np.iinfo(np.int32).max
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = self.of_byte[raw]
        last = (np.arange(len(pieces)), left - 1)
        ids[last] = self.of_last[raw[last]]
        ids = np.where(np.arange(width + 1) < left[:, None], np.pad(ids, ((0, 0), (0, 1))), -1)
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        left, of = left.copy(), np.arange(len(pieces))
        out = left.copy()
        columns = np.arange(width)
        while len(of):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(of))
            best = ranks[rows, at]
            done = best == big
            if done.any():
                out[of[done]] = left[done]
                keep = ~done
                ids, ranks, left, of, at, best = ids[keep], ranks[keep], left[keep], of[keep], at[keep], best[keep]
                rows = np.arange(len(of))
                if not len(of):
                    break
            ids[rows, at] = self.result[best]
            moved = columns[None, :] + (columns[None, :] > at[:, None])
            ids = np.pad(np.take_along_axis(ids, moved, 1), ((0, 0), (0, 1)), constant_values=-1)
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=big), moved, 1)
            left = left - 1
            ranks[rows, at] = self.pair_rank(ids[rows, at], ids[rows, at + 1])
            prior = np.flatnonzero(at > 0)
            ranks[prior, at[prior] - 1] = self.pair_rank(ids[prior, at[prior] - 1], ids[prior, at[prior]])
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], np.iinfo(np.int32).max).astype(np.int32)

    def merged_long(self, ids: list[int]) -> int:
        """The same for long pre-tokens, with a heap over a linked list."""
        from heapq import heapify, heappop, heappush

        rank, n = self.rank, len(ids)
        heap = [(rank[k][0], i) for i in range(n - 1) if (k := ids[i] << 20 | ids[i + 1]) in rank]
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            order, i = heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n:
                continue
            got = rank.get(ids[i] << 20 | ids[j])
            if got is None or got[0] != order:
                continue
            ids[i], ids[j] = got[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, (x[0], i))
            h = before[i]
            if h >= 0 and (x := rank.get(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, (x[0], h))
        return left

    def count(self, s: Slice, memo: Memo) -> np.ndarray:
        start, end = plain_spans(s)
        blocks = packed(s.codes)
        keys = span_hashes(blocks, start, end)
        sizes = self.whole.find(keys, blocks, start, end)
        missed = np.flatnonzero(sizes < 0)
        first, at = classes_of(keys[missed], blocks, start[missed], end[missed])
        pieces = [s.text[a:b] for a, b in zip(start[missed[first]].tolist(), end[missed[first]].tolist(), strict=True)]
        counts = [memo.get(p) for p in pieces]
        fresh = [i for i, n in enumerate(counts) if not n]
        for i, n in zip(fresh, self.merged_many([pieces[i].encode("utf-8", "surrogatepass") for i in fresh]).tolist(), strict=True):
            counts[i] = n
            memo.put(pieces[i], n)
        sizes[missed] = np.array(counts, np.int64)[at]
        return np.bincount(s.doc_of(start), weights=sizes, minlength=len(s.texts)).astype(np.int64)


@lru_cache(1)
def _long_marks() -> re.Pattern:
    """Runs of combining characters that are long enough to matter."""
    marks = [c for c in range(0x300, 0x1E95F) if unicodedata.combining(chr(c))]
    spans, start = [], marks[0]
    for a, b in zip(marks, [*marks[1:], None], strict=True):
        if b != a + 1:
            spans.append(f"{chr(start)}-{chr(a)}")
            start = b
    return re.compile(f"[{''.join(spans)}]{{32,}}")


def _in_order(run: re.Match) -> str:
    """The marks of a run decomposed and, as canonical order has them, by class; those of one class stay in place."""
    return "".join(sorted("".join(unicodedata.normalize("NFD", c) for c in run[0]), key=unicodedata.combining))


def _normal(text: str) -> str:
    """Composed and in lower case; long runs of marks are put in order first, which the library call does in squared time."""
    # the quick test of the library ends at the first mark out of order, so it takes no squared time either
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", _long_marks().sub(_in_order, text))
    return text.replace("Σ", "σ").lower()  # a final sigma stays as any other, as in a mapping by characters


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row."""
    tables = docs.sparkSession.sparkContext.broadcast(Counter(path))

    def run(batches):
        counter, memo = tables.value, Memo(MEMO_BYTES)
        special = re.compile("|".join(map(re.escape, counter.specials)) or "(?!)")
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            for at, texts in text_chunks(batch.column(1)):
                pieces, owner = [], []
                for i, t in enumerate(texts, at):
                    parts = special.split(t) if "<|" in t else [t]
                    total[i] = len(parts) - 1
                    pieces += [_normal(p) for p in parts]
                    owner += [i] * len(parts)
                for first, s in slices(pieces, 4 * SLICE_CHARS):
                    np.add.at(total, owner[first : first + len(s.texts)], counter.count(s, memo))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total)], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("__bytes"))
    out = rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
