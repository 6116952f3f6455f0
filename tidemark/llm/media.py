"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; a validator for each format then checks
structure and lengths, so that a stray ``BM`` in a text is not an image. The object at offset 0 corrects the declared
type; others, inside it or after it, are carved.

Defined cases: null bytes count as empty (no type, nothing carved); a blob of unknown type keeps its declared type and
is marked unconfirmed; blobs of any length are scanned whole; equal blobs give equal results; repeated rows are kept;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 8000


class Blob:
    """Bytes, and what is known of them: where a trailer comes next (magics are met in order, so that each is sought once over
    the whole), and where the chains that pass a place end, so that no link of a chain is followed twice."""

    def __init__(self, data: bytes):
        self.data, self.next = data, {}
        self.ends: dict[str, dict[int, int]] = {}

    def end(self, kind: str, at: int, step) -> int:
        """Where the chain of links from ``at`` ends: ``step(place)`` is the next place, or the end as ``~end``."""
        known, passed, place = self.ends.setdefault(kind, {}), [], at
        while place not in known:
            passed.append(place)
            place = step(place)
            if place < 0:
                break
        end = ~place if place < 0 else known[place]
        for p in passed:
            known[p] = end
        return end

    def find(self, trailer: bytes, at: int) -> int:
        known = self.next.get(trailer)
        if known is None or 0 <= known < at:
            known = self.next[trailer] = self.data.find(trailer, at)
        return known


def _wav(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP"):
        return None
    kind = "wav" if b[at + 8 : at + 12] == b"WAVE" else "webp"
    size = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if at + size > len(b) or size < 12:
        return None
    if kind == "wav" and b[at + 12 : at + 16] != b"fmt ":
        return None
    place, names = at + 12, []
    while place + 8 <= at + size:
        names.append(b[place : place + 4])
        place += 8 + int.from_bytes(b[place + 4 : place + 8], "little")
        place += (place - at) % 2 if place < at + size else 0
    good = place == at + size and (kind == "webp" or names[:1] == [b"fmt "] and b"data" in names)
    return (kind, size) if good else None


def _png(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data
    place, first = at + 8, True
    while place + 12 <= len(b):
        size, name = int.from_bytes(b[place : place + 4], "big"), b[place + 4 : place + 8]
        end = place + 12 + size
        if end > len(b) or first and (name != b"IHDR" or size != 13):
            return None
        if zlib.crc32(b[place + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if name == b"IEND":
            return "png", end - at
        place, first = end, False
    return None


def _jpeg(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF and b[place + 1] != 0xDA:
        if b[place + 1] in (0xD8, 0xD9) or b[place + 1] < 0xC0:
            return None
        size = int.from_bytes(b[place + 2 : place + 4], "big")
        if size < 2:
            return None
        place += 2 + size
    if place + 4 > len(b) or b[place] != 0xFF:
        return None
    end = blob.find(b"\xff\xd9", place)
    return ("jpeg", end + 2 - at) if end >= 0 else None


def _gif(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    place = at + 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0)

    def block(p: int) -> int:
        return p + 1 + b[p] if p < len(b) and b[p] else ~(p + 1)

    def part(p: int) -> int:
        """The place after an extension or an image; the end after a trailer; 0 ends a chain that is no GIF."""
        if p >= len(b):
            return ~0
        if b[p] == 0x3B:
            return ~(p + 1)
        if b[p] == 0x21 and p + 2 < len(b):
            return blob.end("block", p + 2, block)
        if b[p] == 0x2C and p + 10 < len(b):
            return blob.end("block", p + 11 + (3 * (2 << (b[p + 9] & 7)) if b[p + 9] & 0x80 else 0), block)
        return ~0

    end = blob.end("gif", place, part)
    return ("gif", end - at) if end else None


def _bmp(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data
    if at + 26 > len(b):
        return None
    size, offset, header = struct.unpack_from("<I4xII", b, at + 2)
    good = header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= size and at + size <= len(b)
    return ("bmp", size) if good else None


def _gzip(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    engine, place = zlib.decompressobj(31), at
    try:
        while place < len(b) and not engine.eof:
            engine.decompress(b[place : place + 65536])
            place += 65536
    except zlib.error:
        return None
    return ("gzip", min(place, len(b)) - len(engine.unused_data) - at) if engine.eof else None


def _pdf(blob: Blob, at: int) -> tuple[str, int] | None:
    end = blob.find(b"%%EOF", at)
    return ("pdf", end + 5 - at) if end >= 0 else None


def _flac(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data
    good = at + 42 <= len(b) and b[at + 4] & 0x7F == 0 and int.from_bytes(b[at + 5 : at + 8], "big") == 34
    return ("flac", len(b) - at) if good else None


def _ogg(blob: Blob, at: int) -> tuple[str, int] | None:
    b = blob.data

    def page(p: int) -> int:
        """The place after a page; the end where no page begins; 0 ends a chain whose last page is cut short."""
        if not (p + 27 <= len(b) and b[p : p + 5] == b"OggS\0"):
            return ~p
        n = b[p + 26]
        then = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        return then if p + 27 + n <= len(b) and then <= len(b) else ~0

    end = blob.end("ogg", at, page)
    return ("ogg", end - at) if end > at else None


#: Magic bytes of each format, fixed by the formats, and the validator that confirms it.
SIGNATURES = [
    (b"RIFF", _wav),
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"\xff\xd8\xff", _jpeg),
    (b"GIF87a", _gif),
    (b"GIF89a", _gif),
    (b"BM", _bmp),
    (b"\x1f\x8b\x08", _gzip),
    (b"%PDF-", _pdf),
    (b"fLaC", _flac),
    (b"OggS\0", _ogg),
]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, check in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (len(magic), check))
    out.make_automaton()
    return out


def sniff(blob: bytes, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed object; what lies inside a found stream but after it began counts too."""
    whole, out, free = Blob(blob), [], 0
    for end, (size, check) in machine.iter(blob.decode("latin-1")):
        at = end - size + 1
        if at < free and at:
            continue
        got = check(whole, at)
        if got:
            out.append((at, got[1], got[0]))
            free = at + (got[1] if at else 0)
    return out


def wave_payload(blob: bytes) -> tuple[int, int]:
    """Offset and length of the samples of a confirmed wave file."""
    place = 12
    while place + 8 <= len(blob):
        size = int.from_bytes(blob[place + 4 : place + 8], "little")
        if blob[place : place + 4] == b"data":
            return place + 8, size
        place += 8 + size + size % 2
    return len(blob), 0


FOUND = "struct<media_type:string,confirmed:boolean,payload_offset:int,payload_length:int,carved:array<struct<offset:int,length:int,type:string>>,feature:string>"
_TYPE = pa.struct(
    [("media_type", pa.string()), ("confirmed", pa.bool_()), ("payload_offset", pa.int32()), ("payload_length", pa.int32()),
     ("carved", pa.list_(pa.struct([("offset", pa.int32()), ("length", pa.int32()), ("type", pa.string())]))), ("feature", pa.string())]
)


def inspect(media: Column, declared: Column) -> Column:
    """What a blob is: its confirmed or declared type, where its samples lie, what can be carved, and features."""

    @F.arrow_udf(FOUND)
    def found(blobs: pa.Array, kinds: pa.Array) -> pa.Array:
        machine, out = automaton(), []
        for i in range(len(blobs)):
            blob, kind = blobs[i].as_py() or b"", kinds[i].as_py()
            objects = sniff(blob, machine)
            own = objects[0][2] if objects and objects[0][0] == 0 else None
            offset, size = wave_payload(blob) if own == "wav" else (0, len(blob))
            samples = np.frombuffer(blob, np.uint8, size, offset)
            crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
            feature = f"{own or kind or 'unknown'}:n={size}:sum={int(samples.sum(dtype=np.int64))}:max={int(samples.max(initial=0))}:crossings={crossings}"
            carved = [{"offset": a, "length": n, "type": t} for a, n, t in objects if a]
            out.append({"media_type": own or kind, "confirmed": own is not None, "payload_offset": offset, "payload_length": size, "carved": carved, "feature": feature})
        return pa.array(out, _TYPE)

    return found(media, declared)


def _little(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def as_wave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as 8-bit mono samples."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    padded = F.greatest(F.ceil(n / 64) * 64, F.lit(64))
    zeros = F.unhex(F.repeat(F.lit("00"), (padded - n).cast("int")))
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    head = F.concat(F.lit(b"RIFF"), _little(padded + 36), F.lit(b"WAVE" + fmt + b"data"), _little(padded))
    return docs.select(id_col, n.alias("n_bytes"), F.concat(head, raw, zeros).alias("media"))


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a wave file of unknown declared type, sniffed, read back and measured."""
    stored = as_wave(docs, id_col, text_col)
    seen = stored.withColumn("found", inspect(F.col("media"), F.lit("application/octet-stream")))
    samples = F.substring(F.col("media"), F.col("found.payload_offset") + 1, F.col("found.payload_length"))
    tail = F.substring(F.col("media"), F.col("found.payload_offset") + F.col("found.payload_length") - 63, F.lit(64))
    return seen.select(
        id_col,
        "n_bytes",
        F.col("found.payload_length").cast("long").alias("payload_bytes"),
        F.sha2(samples, 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("found.feature").alias("feature"),
        F.col("found.media_type").alias("media_type"),
        F.size("found.carved").cast("long").alias("n_carved"),
    )
