"""Long texts of what each operator looks for take time in proportion; toxicity against a plain scan."""

import math
import time

import pytest

from tidemark.llm import licenses, media, toxicity

SF = "/root/testdata/sf0.001"


def plain_raw(text, weights, exceptions):
    """Every term sought at every place of the folded text."""
    folded = toxicity.fold(text)

    def places(term):
        return [i for i in range(len(folded)) if folded.startswith(term, i)]

    spared = []
    for phrase in exceptions:
        term = " " + " ".join(toxicity.fold(phrase).split()) + " "
        spared += [(i, i + len(term) - 1) for i in places(term)]
    hits = {}
    for term, w in weights.items():
        for i in places(term):
            if not any(a <= i < b for a, b in spared):
                hits[i] = max(w, hits.get(i, 0.0))
    return sum(hits.values()) / math.sqrt(folded.count(" ") + toxicity.ROOM) if hits else 0.0


def test_toxicity_matches_a_plain_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    weights, scale = toxicity.fit(big, labels)
    few = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:40]) | {" trash": 2.0, " ciown": 1.0}
    lexicon = toxicity.Lexicon(few)
    texts = [t[:3000] for (t,) in docs.select("text").collect() if t][:150] + ["the trash can, a trash bin and trash! tr4sh c1own fish clown", "class clown class clown"]
    for t in texts:
        assert lexicon.raw(t) == pytest.approx(plain_raw(t, few, toxicity.EXCEPTIONS))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(big, labels).limit(300).collect()}
    whole = toxicity.Lexicon(weights)
    said = {r["doc_id"]: r["text"] for r in big.where(big.doc_id.isin([*got])).collect()}
    for i, s in got.items():
        raw = whole.raw(said[i] or "")
        assert s == pytest.approx(raw / (raw + scale))


def test_toxicity_odd_rows_have_their_values(spark, odd):
    """Too few labels for a lexicon: every score is 0; held out is what the id's crc32 says."""
    import zlib

    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    got = sorted(((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in toxicity.score_toxicity(odd, labels).collect()), key=repr)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1, 8)} | {None: False}
    assert got == sorted(((i, held[i], 0.0, 0) for i in (1, 1, 2, 3, None, 4, 5, 6, 7)), key=repr)


def test_many_exceptions_take_time_in_proportion():
    lexicon = toxicity.Lexicon({" trash ": 2.0})
    start = time.perf_counter()
    assert lexicon.raw("trash can, " * 100_000) == 0.0 and lexicon.raw("trash can trash ! " * 50_000) > 0
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("magic", [b"%PDF-", b"\xff\xd8\xff\xda\x00\x00", b"GIF87a", b"RIFF\0\0\0\0WAVE", b"OggS\0", b"fLaC"])
def test_many_magics_take_time_in_proportion(magic):
    start = time.perf_counter()
    media.sniff(magic * (3_000_000 // len(magic)), media.automaton())
    assert time.perf_counter() - start < 15


@pytest.mark.parametrize("text", [b"GIF89aAAAAABB!xCC", b"GIF89aAAAAAAB!x\x01C,", b"OggS\0" + b"A" * 21 + b"\x01\x01", b"OggS\0" + b"A" * 21 + b"\x00", b"RIFF\x00\x10\0\0WAVEdata\x01\0\0\0", b"RIFF\xff\xff\0\0WAVEfmt \0\0\0\0"])
def test_chains_behind_magics_take_time_in_proportion(text):
    start = time.perf_counter()
    media.sniff(text * (1_000_000 // len(text)), media.automaton())
    assert time.perf_counter() - start < 5


def plain_gif(b, at):
    """Walks every block from each magic anew."""
    if at + 13 > len(b):
        return None
    place = at + 13 + (3 * (2 << (b[at + 10] & 7)) if b[at + 10] & 0x80 else 0)
    while place < len(b):
        if b[place] == 0x3B:
            return "gif", place + 1 - at
        if b[place] == 0x21 and place + 2 < len(b):
            place += 2
        elif b[place] == 0x2C and place + 10 < len(b):
            place += 11 + (3 * (2 << (b[place + 9] & 7)) if b[place + 9] & 0x80 else 0)
        else:
            return None
        while place < len(b) and b[place]:
            place += 1 + b[place]
        place += 1
    return None


def test_remembered_chains_end_where_walked_ones_do():
    import random

    r = random.Random(2)
    for _ in range(3_000):
        b = b"".join(r.choice((b"GIF89a", b"GIF87a", b"\x00", b"\x01", b"!", b",", b";", b"!\xff\x03abc\x00", b"\x02", b"\x80")) for _ in range(r.randint(1, 40)))
        blob = media.Blob(b)
        assert [media._gif(blob, i) for i in range(len(b)) if b.startswith(b"GIF8", i)] == [plain_gif(b, i) for i in range(len(b)) if b.startswith(b"GIF8", i)]
    one = b"OggS\0" + b"\x01" * 21 + b"\x02\x03\x01abcd"
    assert media._ogg(media.Blob(one * 3 + b"x"), 0) == ("ogg", 3 * len(one)) and media._ogg(media.Blob(one * 3 + one[:-1]), 0) is None


def test_marks_in_long_runs_are_normalised_alike_and_fast():
    import random
    import unicodedata

    from tidemark.llm.tokencount import _normal

    plain = lambda t: unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()
    r = random.Random(6)
    marks = [c for c in map(chr, range(0x300, 0x1E95F)) if unicodedata.combining(c)]
    for _ in range(300):
        t = "".join(r.choice("aeÉ ΣA\u1100\u1161") + "".join(r.choices(marks if r.random() < 0.5 else marks[:70], k=r.choice((0, 1, 3, 40, 90)))) for _ in range(6))
        assert _normal(t) == plain(t)
    start = time.perf_counter()
    _normal("a" + "\u0316\u0301" * 500_000)
    assert time.perf_counter() - start < 5


def test_pdf_and_jpeg_end_at_their_own_trailer():
    machine = media.automaton()
    assert media.sniff(b"%PDF-1 %%EOF..%PDF-2 %%EOF", machine) == [(0, 12, "pdf"), (14, 12, "pdf")]
    assert media.sniff(b"x%PDF-1 %%EOF..%PDF-2", machine) == [(1, 12, "pdf")]


def test_licenses_of_a_text_of_many(spark):
    text = "under the mit license, apache license version 2.0; " * 4_000
    start = time.perf_counter()
    (got,) = licenses.license_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (got["n_base"], got["first_word"], got["labels"]) == (8_000, 0, "apache-2,mit")
    assert got["score"] == pytest.approx(1.0) and time.perf_counter() - start < 60
