"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash resolves every pre-token that is itself in the vocabulary, for a whole slice of
texts at once. Tier two: each other distinct pre-token is merged with a heap over linked bytes.

Defined cases: null text counts as empty; empty text gives no ids; texts of any length are taken whole; equal texts
give equal ids; rows are kept one for one (repeats too); an empty table gives an empty table; other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import released
from tidemark.llm.textscan import Memo, PerfectHash, Slice, classes_of, packed, ragged, slices_of, span_hashes, spans

#: Bytes of text and ids that a worker remembers of pre-tokens it has merged.
MEMO_BYTES = 24 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tables of a rank file; of fixed size, built once on the driver and broadcast."""

    def __init__(self, ranks: dict[bytes, int]):
        byte_ids = [ranks[bytes([b])] for b in range(256)]  # a permutation of 0..255
        self.of_byte = bytes(byte_ids)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.first = [pairs.get(a << 20 | b, -1) for a in byte_ids for b in byte_ids]
        whole, ids = [], []
        for piece, rank in ranks.items():
            try:
                whole.append(piece.decode())
                ids.append(rank)
            except UnicodeDecodeError:
                continue
        self.whole = PerfectHash(whole, ids)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank merges first, the leftmost of equals."""
        pairs, first, n = self.pairs.get, self.first, len(piece)
        ranks = [first[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return list(piece.translate(self.of_byte))
        heapify(heap)
        ids = list(piece.translate(self.of_byte))
        ranks.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if ranks[i] != rank:  # one side has merged since
                continue
            j = after[i]
            ids[i], ids[j], ranks[j] = rank, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks[i] = pairs(rank << 20 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                r = ranks[h] = pairs(ids[h] << 20 | rank, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, s: Slice, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice, and how many each of its texts has."""
        start, end = spans(s)
        blocks = packed(s.codes)
        keys = span_hashes(blocks, start, end)
        found = self.whole.find(keys, blocks, start, end)
        sizes = np.ones(len(start), np.int64)
        missed = np.flatnonzero(found < 0)
        first, at = classes_of(keys[missed], blocks, start[missed], end[missed])
        pieces = []
        for a, b in zip(start[missed[first]].tolist(), end[missed[first]].tolist(), strict=True):
            got = memo.get(piece := s.text[a:b])
            if got is None:
                memo.put(piece, got := array("i", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes())
            pieces.append(got)
        counts = np.array([len(x) // 4 for x in pieces], np.int64)
        sizes[missed] = counts[at]
        place = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        hit = found >= 0
        out[place[hit]] = found[hit]
        if len(missed):
            flat_start = np.cumsum(counts) - counts
            out[ragged(place[missed], counts[at])] = np.frombuffer(b"".join(pieces), np.int32)[ragged(flat_start[at], counts[at])]
        per_text = np.bincount(s.doc_of(start), weights=sizes, minlength=len(s.texts)).astype(np.int64)
        return out, per_text


class Decoder:
    """The bytes of every id, end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for piece, rank in ranks.items():
            by_id[rank] = piece
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each id has."""
        lengths = self.lengths[ids]
        return self.bytes[ragged(self.starts[ids], lengths)], lengths


def _encoded(batches, vocabulary: Vocabulary, id_col: str):
    """(id, ids) batches of (id, text) batches."""
    memo = Memo(MEMO_BYTES)
    for batch in batches:
        for first, s in slices_of(batch.column(1)):
            ids, counts = vocabulary.encode(s, memo)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(s.texts)), pa.ListArray.from_arrays(offsets, pa.array(ids))], [id_col, "ids"])


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _decoded(batches, decoder: Decoder, id_col: str):
    """(id, n_tokens, packed, decoded) batches of (id, ids) batches."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, lengths = decoder.decode(ids)
            total = np.concatenate([[0], np.cumsum(lengths)])
            edge = np.concatenate([[0], np.cumsum(counts)])
            packed = np.frombuffer(ids.astype("<u4").tobytes(), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), _binary(packed, counts * 4), _binary(data, np.diff(total[edge]))], [id_col, "n_tokens", "packed", "decoded"])


DECODED = "n_tokens long, packed binary, decoded binary"


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row by the ranks in ``path``; no special tokens."""
    voc = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(path)))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda batches: _encoded(batches, voc.value, id_col), f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, packed, decoded): ids as little-endian unsigned 32-bit integers, and the bytes they stand for."""
    tables = encoded.sparkSession.sparkContext.broadcast(Decoder(load_ranks(path)))
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(lambda batches: _decoded(batches, tables.value, id_col), f"`{id_col}` {kind}, {DECODED}")


def digest(column: str | Column) -> Column:
    return F.sha2(column, 256)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, through both directions in one worker."""
    ranks = load_ranks(path)
    both = docs.sparkSession.sparkContext.broadcast((Vocabulary(ranks), Decoder(ranks)))

    def run(batches):
        vocabulary, decoder = both.value
        yield from _decoded(_encoded(batches, vocabulary, id_col), decoder, id_col)

    kind = docs.schema[id_col].dataType.simpleString()
    decoded = docs.select(id_col, text_col).mapInArrow(released(run), f"`{id_col}` {kind}, {DECODED}")
    return decoded.select(id_col, "n_tokens", digest("packed").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))
