"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME`` bytes, cut between code points, followed by a
skippable frame with the cumulative bytes, code points and units before each frame; any zstandard reader gives the
text back from it. A cut at a unit decompresses the one frame that holds the cut; outputs and digests are streamed
frame by frame, so no more than a frame of a text is decompressed at once. The output is stored in the same way, and
the text is rebuilt from that output and its form alone.

Defined cases: null and empty texts count as empty, have no units and stay plain; a null id draws as the empty id;
texts of any length go by frames, also a single unit longer than a frame; equal ids draw equal cuts, so repeated rows
give repeated results; texts that hold a marker stay plain; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a frame at most.
FRAME = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: A skippable frame, as the format defines it: any reader passes over it.
SKIPPABLE, TAIL = 0x184D2A5E, b"TMFR"
#: Order in which a form puts the sections, and the marker before each.
LAYOUT = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}


def _unit_starts(raw: np.ndarray, after_letter: bool) -> np.ndarray:
    """Where units begin among the bytes: the first letter of a run of A-Z and a-z, and each other code point."""
    letter = ((raw | 0x20) >= 97) & ((raw | 0x20) <= 122)
    before = np.empty_like(letter)
    before[0], before[1:] = after_letter, letter[:-1]
    return np.where(letter, ~before, (raw & 0xC0) != 0x80)


def _is_letter(byte: int) -> bool:
    return 97 <= byte | 0x20 <= 122


class Writer:
    """Builds a container from pieces of text."""

    def __init__(self):
        self.held, self.out, self.table = bytearray(), [], []
        self.size = self.chars = self.units = 0
        self.after_letter = False
        self.zip = zstandard.ZstdCompressor(level=LEVEL)

    def write(self, piece: bytes | memoryview) -> None:
        self.held += piece
        while len(self.held) > FRAME:
            end = FRAME
            while self.held[end] & 0xC0 == 0x80:
                end -= 1
            self._frame(bytes(self.held[:end]))
            del self.held[:end]

    def _frame(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        packed = self.zip.compress(data)
        self.table.append((len(packed), self.size, self.chars, self.units, self.after_letter))
        self.out.append(packed)
        self.size += len(data)
        self.chars += int(np.count_nonzero((raw & 0xC0) != 0x80))
        self.units += int(np.count_nonzero(_unit_starts(raw, self.after_letter)))
        self.after_letter = _is_letter(data[-1])

    def close(self) -> bytes:
        if self.held:
            self._frame(bytes(self.held))
        index = b"".join(struct.pack("<QQQQB", *row) for row in self.table)
        index += struct.pack("<QQQI4s", self.size, self.chars, self.units, len(self.table), TAIL)
        return b"".join([*self.out, struct.pack("<II", SKIPPABLE, len(index)), index])


class Frames:
    """Reads a container; decompresses no more frames than asked for."""

    ROW, END = struct.calcsize("<QQQQB"), struct.calcsize("<QQQI4s")

    def __init__(self, blob: bytes):
        self.size, self.chars, self.units, n, tail = struct.unpack("<QQQI4s", blob[-self.END :])
        if tail != TAIL:
            raise ValueError("not a container of frames")
        at = len(blob) - self.END - n * self.ROW
        rows = list(struct.iter_unpack("<QQQQB", blob[at : len(blob) - self.END]))
        self.blob, self.place, place = memoryview(blob), [], 0
        for row in rows:
            self.place.append((place, place + row[0]))
            place += row[0]
        self.before_bytes = np.array([r[1] for r in rows], np.int64)
        self.before_chars = np.array([r[2] for r in rows], np.int64)
        self.before_units = np.array([r[3] for r in rows], np.int64)
        self.after_letter = [bool(r[4]) for r in rows]
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        a, z = self.place[i]
        return self.unzip.decompress(self.blob[a:z])

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the unit of that number; one frame is read."""
        if units >= self.units:
            return self.size, self.chars
        i = int(np.searchsorted(self.before_units, units, side="right")) - 1
        raw = np.frombuffer(self.frame(i), np.uint8)
        at = int(np.flatnonzero(_unit_starts(raw, self.after_letter[i]))[units - self.before_units[i]])
        chars = int(np.count_nonzero((raw[:at] & 0xC0) != 0x80))
        return int(self.before_bytes[i]) + at, int(self.before_chars[i]) + chars

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[memoryview]:
        """The bytes from start to end, a frame at a time."""
        end = self.size if end is None else end
        if start >= end:
            return
        for i in range(int(np.searchsorted(self.before_bytes, start, side="right")) - 1, len(self.place)):
            own = int(self.before_bytes[i])
            if own >= end:
                break
            data = memoryview(self.frame(i))
            yield data[max(0, start - own) : min(len(data), end - own)]

    def find(self, marker: bytes, start: int) -> int:
        """Where the marker comes first at or after start, also across two frames; -1 if nowhere."""
        held, at = b"", start
        for piece in self.stream(start):
            both = held + piece.tobytes()
            got = both.find(marker)
            if got >= 0:
                return at - len(held) + got
            at += len(piece)
            held = both[-(len(marker) - 1) :]
        return -1


def seal_text(text: bytes) -> bytes:
    w, view = Writer(), memoryview(text)
    for i in range(0, len(view), FRAME):
        w.write(view[i : i + FRAME])
    return w.close()


def arranged(source: Frames, form: str, a: int, z: int) -> Iterator[bytes | memoryview]:
    """The output of a form whose middle lies from byte a to byte z."""
    if form == "plain":
        yield from source.stream()
        return
    sections = ((0, a), (a, z), (z, source.size))
    for marker, k in LAYOUT[form]:
        yield marker
        yield from source.stream(*sections[k])


def restored(output: Frames, form: str) -> Iterator[memoryview]:
    """The text, from an output and its form: markers are found in order, then the sections come in the text's order."""
    if form == "plain":
        yield from output.stream()
        return
    at, starts = 0, []
    for marker, _ in LAYOUT[form]:
        got = output.find(marker, at)
        if got < 0 or not starts and got:
            raise ValueError(f"no {marker.decode()} where form {form} has it")
        starts.append(got)
        at = got + len(marker)
    ends = [*starts[1:], output.size]
    spans = {k: (s + len(marker), e) for (marker, k), s, e in zip(LAYOUT[form], starts, ends, strict=True)}
    for k in range(3):
        yield from output.stream(*spans[k])


def _digest(pieces: Iterable[bytes | memoryview]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
    return h.hexdigest()


SEALED = "struct<n:long,n_chars:long,marked:boolean,frames:binary>"
_SEALED = pa.struct([("n", pa.int64()), ("n_chars", pa.int64()), ("marked", pa.bool_()), ("frames", pa.binary())])


def seal(text: Column) -> Column:
    """Units, code points, whether a marker occurs, and the container of each text."""

    @F.arrow_udf(SEALED)
    def sealed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.cast(pa.binary()):
            raw = t.as_py() or b""
            blob = seal_text(raw)
            size, chars, units, _, _ = struct.unpack("<QQQI4s", blob[-Frames.END :])
            out.append({"n": units, "n_chars": chars, "marked": any(m in raw for m in MARKERS), "frames": blob})
        return pa.array(out, _SEALED)

    return sealed(text)


MADE = "struct<prefix_chars:long,middle_chars:long,output_sha256:string,frames:binary>"
_MADE = pa.struct([("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("frames", pa.binary())])


def rearrange(frames: Column, form: Column, low: Column, high: Column) -> Column:
    """The output of each container under its form, with the middle from unit ``low`` to unit ``high``."""

    @F.arrow_udf(MADE)
    def made(blobs: pa.Array, forms: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        out = []
        for blob, form, lo, hi in zip(blobs, forms.to_pylist(), lows.to_pylist(), highs.to_pylist(), strict=True):
            source = Frames(blob.as_py())
            (a, a_chars), (z, z_chars) = source.cut(lo), source.cut(hi)
            w, h = Writer(), hashlib.sha256()
            for piece in arranged(source, form, a, z):
                h.update(piece)
                w.write(piece)
            plain = form == "plain"
            out.append({"prefix_chars": None if plain else a_chars, "middle_chars": None if plain else z_chars - a_chars, "output_sha256": h.hexdigest(), "frames": w.close()})
        return pa.array(out, _MADE)

    return made(frames, form, low, high)


def restored_sha256(frames: Column, form: Column) -> Column:
    """Digest of the text that each output gives back."""

    @F.arrow_udf("string")
    def told(blobs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([_digest(restored(Frames(b.as_py()), f)) for b, f in zip(blobs, forms.to_pylist(), strict=True)], pa.string())

    return told(frames, form)


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, frames): every text, rearranged and stored as frames.

    The draws are columns: four numbers from the digest of ``seed:id`` choose both cuts, whether a text is left
    plain (``plain_from`` of 100) and which of the two orders it takes (``spm_below`` of 100).
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("__id"), digest.alias("__digest"), seal(F.col(text_col)).alias("__sealed"))
    h1, h2, h3, h4 = (_draw(F.col("__digest"), k) for k in (1, 2, 3, 4))
    n = F.col("__sealed.n")
    plain = (n == 0) | F.col("__sealed.marked") | (h3 % 100 >= plain_from)
    form = F.when(plain, "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("__id", "__sealed", form.alias("__form"), F.least(h1 % (n + 1), h2 % (n + 1)).alias("__low"), F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("__high"))
    rows = rows.select("__id", n.alias("n"), "__form", rearrange(F.col("__sealed.frames"), F.col("__form"), F.col("__low"), F.col("__high")).alias("__made"))
    return rows.select(F.col("__id").alias(id_col), "n", F.col("__form").alias("form"), "__made.*")


def fim_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each text became, with the digests of the output and of the text rebuilt from it."""
    made = transform(docs, id_col=id_col, text_col=text_col)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored_sha256(F.col("frames"), F.col("form")).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
g AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM h),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:lo], ''), '') AS p, coalesce(array_to_string(units[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(units[hi + 1:], ''), '') AS s FROM cuts),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts),
back AS (
  SELECT *, CASE form WHEN 'plain' THEN output
      WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3) || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
      ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3) || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) END AS restored FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM back
"""
