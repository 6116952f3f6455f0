"""Personal data, also in disguise, with spans in the source text.

Plain identifiers are found by their patterns. For disguised ones, transducers rewrite the text, one after the other, and
keep, for every character, where it came from: look-alike letters and wide digits become ASCII and invisible characters
go; then at/dot disguises become ``@`` and ``.``, spelled digits digits. The plain patterns run on the normalised text, and
what they find there is mapped back through the offsets.

Defined cases: null text counts as empty (no spans); texts of any length are scanned whole; spans are in code points,
end exclusive; an added span overlaps a plain one only if it holds all of it and more; repeated rows are kept; an empty table gives an empty table;
other columns are not read by ``find_pii`` and go through ``mask_documents`` untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import released
from tidemark.llm.textscan import row_chunks, text_chunks


KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the mail pattern, found from each ``@`` outwards, so that no start is tried twice."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = floor = m.end()
            out.append((start, end))
        at = text.find("@", end)
    return out


def _ip_ok(m: re.Match) -> bool:
    return all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in m.groups())


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _ip_ok(m)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


#: Letters of other scripts that look like Latin ones. Fixed values.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "һ": "h",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "﹫": "@",
}
INVISIBLE = "­​‌‍‎‏⁠﻿"


def _ascii_table() -> dict[int, str]:
    table = {ord(a): b for a, b in LOOKALIKES.items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for zero in (0x660, 0x6F0, 0x966, *range(0x1D7CE, 0x1D800, 10)):
        table |= {zero + i: str(i) for i in range(10)}
    return table


ASCII = _ascii_table()
UNSEEN = re.compile(f"[{INVISIBLE}]+")
STRANGE = re.compile("[" + "".join(map(re.escape, map(chr, ASCII))) + INVISIBLE + "]")

DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
#: White space before a sign is taken from its first character on, so that no run of it is tried twice.
AT = re.compile(rf"(?<!\s)\s*+{_OPEN}\s*+(?:at|@)\s*+{_SHUT}\s*+|(?<!\s)\s++at\s++|(?<!\s)\s++@\s*+|@\s++", re.I)
_DOT = rf"(?:\s*+{_OPEN}\s*+(?:dot|punkt|\.)\s*+{_SHUT}\s*+|\s++dot\s++|\.)"
SOME_DOT = re.compile(_DOT, re.I)
RIGHT = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
#: LEFT is read backwards from the at sign, over the reversed text, so that it ends where the name begins.
_TOD = rf"(?:\s*+{_SHUT}\s*+(?:tod|tknup|\.)\s*+{_OPEN}\s*+|\s++tod\s++|\.)"
LEFT = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_TOD}[A-Za-z0-9_%+-]+)*", re.I)

#: A digit word or a number in digits, which may be glued to the word for a dot; and what may stand between two of them.
NUMBER = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})\b|(?:\b|(?<=dot)|(?<=point)|(?<=punkt))[0-9]++(?:\b|(?=dot|point|punkt))", re.I)
DOT = re.compile(rf"\.|\s*+{_OPEN}\s*+\.\s*+{_SHUT}\s*+|[\s,.-]*+(?:{_OPEN}\s*+)?(?:dot|point|punkt)(?:\s*+{_SHUT})?[\s,.-]*+", re.I)
GAP = re.compile(r"[\s,.()-]++")
PLUS = re.compile(r"(?:\+\s*+\(?|\bplus[\s,-]++)$", re.I)
DISGUISED = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})\b|[0-9]\W*(?:dot|point|punkt)|[0-9]\s*{_OPEN}\s*\.", re.I)


class Mapped:
    """A rewritten text that knows, for each of its characters, the source span it stands for.

    ``edits`` are (start, end, new text) in order, on ``before``, which may itself be rewritten.
    """

    def __init__(self, before: str | Mapped, edits: list[tuple[int, int, str]] = ()):
        old = before.text if isinstance(before, Mapped) else before
        self.before = before if isinstance(before, Mapped) else None
        parts, self.pieces, at, size = [], [], 0, 0  # (place here, place before, end before, kept as it was)
        for a, b, new in edits:
            if a > at:
                self.pieces.append((size, at, a, True))
                parts.append(old[at:a])
                size += a - at
            if new:
                self.pieces.append((size, a, b, False))
                parts.append(new)
                size += len(new)
            at = b
        if at < len(old) or not self.pieces:
            self.pieces.append((size, at, len(old), True))
            parts.append(old[at:])
        self.text = "".join(parts)

    @classmethod
    def letters(cls, text: str) -> Mapped:
        """Look-alikes to ASCII, invisible characters away."""
        out = cls(text, [(m.start(), m.end(), "") for m in UNSEEN.finditer(text)])
        out.text = out.text.translate(ASCII)
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        def piece(at: int) -> tuple[int, int, int, bool]:
            return self.pieces[bisect_right(self.pieces, (at, float("inf"))) - 1]

        here, there, _, same = piece(start)
        a = there + start - here if same else there
        here, there, stop, same = piece(end - 1)
        b = there + end - here if same else stop
        return self.before.source(a, b) if self.before else (a, b)


def _mail_edits(text: str):
    """At and dot disguises to ``@`` and ``.``, where a name and a domain stand around them."""
    back, n = text[::-1], len(text)
    for m in AT.finditer(text):
        spelled = not any(c in m.group() for c in "@[({<")
        right = RIGHT.match(text, m.end())
        if not right:
            continue
        open_dot = re.search(r"\bdot\b|[\[({<]", right.group(), re.I)
        left = LEFT.match(back, n - m.start())
        if not left:
            continue
        if spelled and not open_dot and not re.search(r"[0-9._%+]", left.group()):
            continue
        if spelled and not open_dot and not re.fullmatch(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", right.group()):
            continue
        for a, b in ((n - left.end(), m.start()), right.span()):
            yield from ((d.start(), d.end(), ".") for d in SOME_DOT.finditer(text, a, b) if d.end() - d.start() > 1)
        yield m.start(), m.end(), "@"


class Number(NamedTuple):
    """A number token, and what stands between it and the one before: a dot (maybe in disguise), white space or a hyphen, or more."""

    start: int
    end: int
    digits: str
    word: bool
    dot: bool
    hidden: bool
    near: bool


def _chains(text: str):
    """Runs of number tokens with nothing but separators and dots between them."""
    chain: list[Number] = []
    for m in NUMBER.finditer(text):
        a, b = m.span()
        digits = DIGIT_WORDS.get(m.group().lower(), m.group())
        dot = hidden = near = False
        if chain:
            last = chain[-1].end
            dot = DOT.fullmatch(text, last, a) is not None
            hidden = dot and a - last > 1
            near = dot or text[last:a].strip() in ("", "-")
            if not dot and not GAP.fullmatch(text, last, a):
                yield chain
                chain = []
        chain.append(Number(a, b, digits, not m.group()[0].isdigit(), dot and bool(chain), hidden, near))
    if chain:
        yield chain


def _octet(tokens: list[Number]) -> bool:
    number = "".join(t.digits for t in tokens)
    return int(number[-4:]) <= 255 and not number[:-3].strip("0")


def _end_octet(tokens: list[Number]) -> int:
    """How many of the tokens, from the first on, are one octet: one number, or as many single digits as fit, if written one by one."""
    k = 1
    while k < len(tokens) and k < 3 and tokens[k].near and all(len(t.digits) == 1 for t in tokens[: k + 1]) and _octet(tokens[: k + 1]):
        k += 1
    return k


def _spelled_ips(chain: list[Number]) -> list[tuple[int, int]]:
    """(first token, token after the last) of four octets with dots between them, of which something is in disguise."""
    edges = [0, *(i for i, t in enumerate(chain) if t.dot), len(chain)]
    out, g, floor = [], 0, 0
    while g + 4 < len(edges):
        first = chain[max(floor, edges[g]) : edges[g + 1]]
        last = chain[edges[g + 3] : edges[g + 4]]
        g += 1
        if not first:
            continue
        k = 1
        while k < len(first) and k < 3 and first[-k].near and all(len(t.digits) == 1 for t in first[-k - 1 :]) and _octet(first[-k - 1 :]):
            k += 1
        start, end = edges[g] - k, edges[g + 2] + _end_octet(last)
        octets = [chain[start : edges[g]], chain[edges[g] : edges[g + 1]], chain[edges[g + 1] : edges[g + 2]], chain[edges[g + 2] : end]]
        if all(map(_octet, octets)) and (any(t.word for t in chain[start:end]) or any(t.hidden for t in chain[start + 1 : end])):
            out.append((start, end))
            floor = end
            g += 2
    return out


def _number_kind(run: list[Number], plus: bool) -> int | None:
    """Card or phone; a phone without a plus has three digit words or seven tokens at least."""
    words = sum(t.word for t in run)
    if not words and not any(t.hidden for t in run[1:]):
        return None
    size = sum(len(t.digits) for t in run)
    if 14 <= size <= 19 and luhn("".join(t.digits for t in run)):
        return 2
    return 3 if 10 <= size <= 15 and (plus or words >= 3 or len(run) >= 7 and words) else None


def _digits_of(run: list[Number], dots: bool):
    """A run of tokens as digits, with a dot for each dot between them if wanted, and nothing else."""
    for k, t in enumerate(run):
        if k:
            yield run[k - 1].end, t.start, "." if dots and t.dot else ""
        if t.word:
            yield t.start, t.end, t.digits


def _number_edits(text: str):
    """Spelled digits to digits, where a run of number tokens makes an address, a card or a phone number."""
    for chain in _chains(text):
        if len(chain) < 2:
            continue
        ips = _spelled_ips(chain)
        for a, b in ips:
            yield from _digits_of(chain[a:b], True)
        at = 0
        for a, b in [*ips, (len(chain), len(chain))]:
            run, at = chain[at:a], b
            if not run:
                continue
            sign = PLUS.search(text, max(0, _before(text, run[0].start)), run[0].start)
            # the whole run, or else its parts between stops, commas and brackets
            parts = [run]
            if _number_kind(run, bool(sign)) is None:
                cuts = [0, *(i for i in range(1, len(run)) if not run[i].near), len(run)]
                parts = [run[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            for k, part in enumerate(parts):
                kind = _number_kind(part, bool(sign) and k == 0)
                if kind == 3:
                    yield sign.start() if sign and k == 0 else part[0].start, part[0].start, "+"
                if kind is not None:
                    yield from _digits_of(part, False)


def _before(text: str, at: int) -> int:
    """Where a plus sign or word before a number may begin: the separators before it and four letters."""
    while at and (text[at - 1].isspace() or text[at - 1] in ",-("):
        at -= 1
    return at - 4 - (at > 4)


def normalised(text: str) -> Mapped | None:
    """The text after all transducers; None where none of them finds anything to rewrite."""
    out = Mapped.letters(text) if not text.isascii() and STRANGE.search(text) else None
    plain = out.text if out else text
    low, edits = plain.lower(), []
    if "dot" in low or "@" in low or re.search(r"[\[({<]\s*+at\s*+[\])}>]|(?<!\s)\s++at\s++[a-z0-9-]++\.[a-z0-9]", low):
        edits += _mail_edits(plain)
    if DISGUISED.search(low):
        edits += _number_edits(plain)
    if not edits:
        return out
    disjoint, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            disjoint.append((a, b, new))
            at = b
    return Mapped(out or plain, disjoint)


def hidden_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans found on the normalised text only. None overlaps another, nor a plain one unless it holds it whole and is longer."""
    mapped = normalised(text)
    if mapped is None:
        return []
    plain, taken, out = [(a, b) for a, _, b in base], [], []
    found = [(*mapped.source(a, b), k) for a, k, b in base_spans(mapped.text)]
    for a, b, k in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if taken and taken[-1][1] > a:
            continue
        at = bisect_right(plain, (a, -1))
        at -= at > 0 and plain[at - 1][1] > a
        touched = []
        while at < len(plain) and plain[at][0] < b:
            touched.append(plain[at])
            at += 1
        if all(a <= c and d <= b and (c, d) != (a, b) for c, d in touched):
            taken.append((a, b))
            out.append((a, k, b))
    return out


SPAN = "array<struct<start:int,kind:int,end:int,added:boolean>>"


def _spans_of(text: str) -> list[dict]:
    base = base_spans(text)
    rows = [(a, k, b, False) for a, k, b in base] + [(a, k, b, True) for a, k, b in hidden_spans(text, base)]
    return [dict(zip(("start", "kind", "end", "added"), r, strict=True)) for r in sorted(rows)]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, kind, end, added>>) of each row, by start and kind."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def run(batches):
        for batch in batches:
            spans = [_spans_of(t) if t else [] for _, texts in text_chunks(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(released(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans {SPAN}")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of plain spans, base_sha256, spans) of each row."""
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find_pii(docs, id_col, text_col)
    base = F.filter("spans", lambda s: ~s["added"])

    def plain(kind: int):
        return lambda s: ~s["added"] & (s["kind"] == kind)

    counts = [F.size(F.filter("spans", plain(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added")
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


def masked(text: str) -> str:
    """The text with each span replaced; of spans that overlap, all that they cover, by the name of the longest."""
    parts, at, spans = [], 0, _spans_of(text)
    for i, s in enumerate(spans):
        if s["start"] < at:
            continue
        stop, longest = s["end"], s
        for other in spans[i + 1 :]:
            if other["start"] >= stop:
                break
            stop = max(stop, other["end"])
            longest = max(longest, other, key=lambda x: x["end"] - x["start"])
        parts += [text[at : s["start"]], f"<{KINDS[longest['kind']].upper()}>"]
        at = stop
    return "".join([*parts, text[at:]])


def mask_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by ``<KIND>``; null texts stay null, other columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for first, stop in row_chunks(whole.column(at)):
                batch = whole.slice(first, stop - first)
                texts = pa.array([masked(t) if t else t for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), texts)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(released(run), docs.schema)


def mask_and_count(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``mask_documents``, with the column of text lengths, where there is one, made to fit."""
    masked = mask_documents(docs, text_col)
    if size_col not in docs.columns:
        return masked
    return masked.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
