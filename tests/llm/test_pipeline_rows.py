"""The pipeline against a plain version of it, and on odd tables."""

import base64
import hashlib
import struct
from collections import Counter

import public_tokenizers
from test_corpus_operators import brute_components

import corpus_pipeline
from tidemark.llm import mixing, pii

SF = "/root/testdata/sf0.001"


def plain(spark, rows, kept):
    """Rows (doc_id, text, source) of identified documents through near-duplicate removal, masking, mixing and BPE."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, heads = brute_components([(i, t) for i, t, _ in kept])
    one = [(i, pii.masked(t), s) for i, t, s in kept if heads[i] == i]
    df = spark.createDataFrame(one, "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(df).collect()}
    out = Counter()
    for i, t, _ in one:
        ids = encoding.encode_ordinary(t)
        row = (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        out[row] += copies[i]
    return +out


def test_pipeline_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert kept == {i for i, t, _ in rows if any(c.isalpha() for c in t or "")}
    want = plain(spark, rows, [r for r in rows if r[0] in kept])
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd):
    docs = odd
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == odd.columns
        docs = spark.createDataFrame(out.collect(), odd.schema)
    ids = Counter(r["doc_id"] for r in docs.collect())
    assert set(ids) <= {1, None, 4, 6, 7} and ids[1] >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    empty = odd.limit(0)
    for _, step in corpus_pipeline.STAGES[:-1]:
        empty = spark.createDataFrame(step(spark, empty, SF).collect(), odd.schema)
        assert empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
