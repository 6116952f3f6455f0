import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, licenses, media, mixing, pii, queries, tokencount
from tidemark.llm.textscan import Memo, Slice, classes_of, packed, slices, span_hashes

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.load_ranks(RANKS))


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(WORDS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


# --- mixing ---


def test_targets_reshare_excess_by_weight(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    sizes, weights = {"a": 10, "b": 100, "c": 1000, None: 5}, {"a": 1, "b": 2, "c": 3, None: 1}
    want, open_ = {}, set(sizes)
    while True:
        rest = sum(sizes.values()) - sum(want.values())
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / total > 3 * sizes[s]}
        if not over:
            want |= {s: rest * weights[s] / total for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    assert got == pytest.approx(want)


def test_mix_matches_sql_and_targets(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE_SQL).fetchall(), key=repr)
    assert rows(queries.op1_source_mix(spark, SF)) == want


def test_mix_documents_emits_the_plan(spark, odd):
    plan = Counter()
    for r in mixing.mix_plan(odd).collect():
        plan[r["doc_id"]] += r["copies"]
        assert r["copies"] <= 3
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +plan
    assert mixing.mix_plan(odd.limit(0)).count() == 0 and mixing.mix_documents(odd.limit(0)).count() == 0


# --- byte BPE ---

ODD = ["", "'s", " 's", "a's't", "it's  don't\n'll x", "\n\n 'real 'd!", "!'s a'!", "  x   ", "\t\n a\n", "日本語 テスト１２", "x'", "''s", "a\n's", "½ ²x", " ’s  b"]


def ids_of(vocabulary, texts):
    out, memo = [], Memo(1 << 20)
    for _, s in slices(texts, 50):
        ids, counts = vocabulary.encode(s, memo)
        at = 0
        for n in counts.tolist():
            out.append(ids[at : at + n].tolist())
            at += n
    return out


def test_bpe_matches_library(vocabulary, tiktoken_encoding, documents):
    texts = ODD + [t or "" for t in documents.values()]
    assert ids_of(vocabulary, texts) == [tiktoken_encoding.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z'stdrevml1½.!\n\t  éß日\U0001f600"), max_size=30), max_size=4))
def test_bpe_matches_library_on_any_text(vocabulary, tiktoken_encoding, texts):
    assert ids_of(vocabulary, texts) == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_bpe_round_trip_rows(spark, odd, odd_rows, tiktoken_encoding):
    got = rows(bpe.round_trip(odd, RANKS))
    want = []
    for i, t, *_ in odd_rows:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(odd.limit(0), RANKS).count() == 0


def test_perfect_hash_is_minimal(vocabulary):
    table = vocabulary.whole
    start, end = table.start.astype("int64"), table.end.astype("int64")
    # every slot is taken by a key of its own, and found by it
    assert len(table.keys) == table.n == len(set(zip(start.tolist(), end.tolist(), strict=True)))
    assert table.find(table.keys, table.blocks, start, end).tolist() == table.values.tolist()
    # a hash that is not there, and one that is there under other letters, find nothing
    assert (table.find(table.keys + 1, table.blocks, start, end) == -1).all()
    assert (table.find(table.keys, table.blocks, np.roll(start, 1), np.roll(end, 1)) == -1).all()


# --- token counts ---


def counts_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["n_tokens"] for r in sorted(tokencount.count_tokens(df, WORDS).collect(), key=lambda r: r["doc_id"])]


def test_counts_match_library(spark, library, documents):
    texts = ODD + ["<|endoftext|> Σας ΟΔΟΣ İ é<|startoftext|>x", "a" * 3000, "é"] + [t or "" for t in documents.values()]
    assert counts_of(spark, texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abIK Z'stdrevml1½.!\n  éßΣ日\U0001f600́"), max_size=40))
def test_counts_match_library_on_any_text(counter, library, text):
    got = counter.count(Slice([tokencount._normal(text)]), Memo(1 << 20))[0]
    assert got == len(library.encode(text, add_special_tokens=False).ids)


def test_heap_and_rows_in_step_agree(counter, documents):
    words = [w.encode() for w in " ".join(t or "" for t in documents.values()).lower().split()[:3000]]
    assert counter.merged_many(words).tolist() == [counter.merged(w) for w in words]


def test_counts_odd_rows(odd):
    got = {(r["doc_id"], r["n_bytes"], r["over_limit"]) for r in tokencount.count_tokens(odd, WORDS).collect()}
    assert (2, 0, False) in got and (3, 0, False) in got and (6, 100_000, True) in got
    assert tokencount.count_tokens(odd, WORDS).count() == 9 and tokencount.count_tokens(odd.limit(0), WORDS).count() == 0


# --- personal data ---

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), k == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.@-+ ()0123456789%é\n"), max_size=60))
def test_plain_spans_match_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_documents(spark, documents):
    found = queries.op5_pii(spark, SF).collect()
    for r in found:
        base = plain_spans(documents[r["doc_id"]] or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r["n_added"] or r["spans"] == said


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("write to john.doe [at] example [dot] com today", 0, "john.doe [at] example [dot] com"),
        ("write to john dot doe at example dot com", 0, "john dot doe at example dot com"),
        ("mail jоhn@exаmple.com now", 0, "jоhn@exаmple.com"),
        ("call +１２ ３４５ ６７８ ９０１２ now", 3, "+１２ ３４５ ６７８ ９０１２"),
        ("call plus one five five five one two three four five six seven please", 3, "plus one five five five one two three four five six seven"),
        ("host one nine two dot one six eight dot one dot seven five up", 1, "one nine two dot one six eight dot one dot seven five"),
        ("a​b@exam​ple.com", 0, "a​b@exam​ple.com"),
    ],
)
def test_disguises_map_back(text, kind, piece):
    base = pii.base_spans(text)
    spans = base + pii.hidden_spans(text, base)
    assert any(k == kind and text[a:b].strip() == piece for a, k, b in spans), [(k, text[a:b]) for a, k, b in spans]


def test_clean_text_is_left_alone():
    for text in ("he is at home. dot the i at noon", "one two three", "look at example.com", "at that and one of two in 2020"):
        assert not pii.base_spans(text) and not pii.hidden_spans(text, [])


def test_masking(odd, docs_of):
    masked = pii.mask_and_count(docs_of([(1, "a b@c.de x", "en", "s", 10), (2, None, None, None, None)])).collect()
    assert masked[0]["text"] == "a <EMAIL> x" and masked[0]["n_chars"] == 11 and masked[1]["text"] is None
    assert pii.mask_and_count(odd).columns == odd.columns and pii.pii_digest(odd).count() == 9


# --- licenses ---


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_documents(spark, docs_of):
    texts = ["Under the MIT-License! under the mit license", "Apache License, Version 2.0", "CC BY-NC 4.0 and cc by nc cc by nc", "GNU General Public License version 3 or later", "mit dem hund", None, "", "é under\nthe MIT\tLicense é"]
    df = docs_of([(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in licenses.license_digest(df).collect()}
    for i, t in enumerate(texts):
        w = license_words(t)
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) or not labels
        assert 0 <= r["score"] <= 1
    assert got[3]["labels"] == "gpl-3" and got[4]["labels"] == "" and "apache-2" in got[1]["labels"]


def test_license_rules_and_odd_rows(odd):
    assert 150 < len(licenses.rules()) < 400
    for _, _, pattern in licenses.rules():
        re.compile(pattern)
    assert licenses.license_digest(odd).count() == 9 and licenses.license_digest(odd.limit(0)).count() == 0


def test_license_query_runs_no_python(spark):
    plan = queries.op7_license_scan(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- media ---


def test_media_documents(odd, odd_rows):
    got = {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_type"]) for r in media.media_digest(odd).collect()}
    want = set()
    for i, t, *_ in odd_rows:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.add((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), "wav"))
    assert got == want and media.media_digest(odd.limit(0)).count() == 0


def test_wave_file_reads_with_a_library(spark):
    import io
    import wave

    blob = bytes(media.as_wave(spark.createDataFrame([(1, "héllo")], "doc_id long, text string")).first()["media"])
    with wave.open(io.BytesIO(blob)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, 64)
        assert w.readframes(64).rstrip(b"\0").decode() == "héllo"


def test_sniffing_and_carving(spark):
    import gzip
    import struct

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    packed = gzip.compress(b"hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x4c\x01\0" + b"\x3b"
    blobs = [(1, png, "image/gif"), (2, b"BM not a bitmap", "text/plain"), (3, b"junk" + packed + b"more" + png + b"x", "text/plain"), (4, None, None), (5, gif, None), (6, png[:-3], "png")]
    df = spark.createDataFrame(blobs, "id long, blob binary, kind string")
    from pyspark.sql import functions as F

    got = {r["id"]: r["f"] for r in df.select("id", media.inspect(F.col("blob"), F.col("kind")).alias("f")).collect()}
    assert got[1]["media_type"] == "png" and got[1]["confirmed"] and not got[2]["confirmed"] and got[2]["media_type"] == "text/plain"
    assert [(c["offset"], c["length"], c["type"]) for c in got[3]["carved"]] == [(4, len(packed), "gzip"), (8 + len(packed), len(png), "png")]
    assert got[4]["media_type"] is None and got[5]["media_type"] == "gif" and not got[6]["confirmed"]


# --- span hashes ---


def thue_morse(n, letters="ab"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits)


def test_words_that_are_complements_have_their_own_tokens(vocabulary, tiktoken_encoding, counter, library):
    texts = [thue_morse(n, letters) for n in (512, 1024, 2048, 4096) for letters in ("ab", "ba")]
    assert ids_of(vocabulary, texts) == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    s = Slice(texts)
    assert counter.count(s, Memo(1 << 20)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_equal_hashes_of_unequal_texts_are_kept_apart():
    import numpy as np

    s = Slice(["abcd", "abce", "abcd", "", "x" * 1000, "x" * 999 + "y", "x" * 1000])
    blocks, start, end = packed(s.codes), s.edges[:-1], s.edges[1:]
    hashes = span_hashes(blocks, start, end)
    assert len(set(hashes.tolist())) == 5
    first, at = classes_of(np.zeros(7, np.uint64), blocks, start, end)
    texts = [s.texts[i] for i in first]
    assert [texts[k] for k in at] == s.texts
