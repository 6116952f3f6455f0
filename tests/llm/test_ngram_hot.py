"""Passages and copies that very many documents share, and words that used to hash alike."""

import numpy as np
from test_corpus_operators import check_components

from tidemark.llm import ngram_join


def thue_morse(n, letters="ab"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits)


def test_one_passage_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    monkeypatch.setattr(ngram_join, "LOOK", 4)
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for i in range(900):
        own = [f"w{x}" for x in rng.integers(0, 10**9, int(rng.integers(3, 40)))]
        rows.append((i, " ".join(own + passage if i % 3 else own)))
    for i in range(0, 300, 7):  # near copies of documents with the passage, and many exact ones of one
        rows.append((len(rows), rows[i][1] + " tail"))
    rows += [(len(rows) + k, rows[1][1]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    check_components(rows, ngram_join.jaccard_components(df).collect())


def test_hot_signatures_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOOK", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    signs = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 5), (2, 6), (3, 7)], "sig long, set_id long")
    got = ngram_join._meetings(signs).collect()
    assert {(r["sig"], r["set_id"]) for r in got} == {(1, i) for i in range(200)} | {(2, 5), (2, 6)}
    assert all((r["parts"] > 4) == (r["sig"] == 1) for r in got)


def test_words_that_are_complements_stay_two(spark):
    rows = [(2 * k, thue_morse(n)) for k, n in enumerate((1024, 2048, 4096))] + [(2 * k + 1, thue_morse(n, "ba")) for k, n in enumerate((1024, 2048, 4096))]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 1 for r in got) and len(got) == 6


def test_counts_over_16_bits():
    u = np.arange(70_000, dtype=np.uint64) * np.uint64(64)
    column = __import__("pyarrow").array([ngram_join.point(u), ngram_join.point(u[:100])])
    assert ngram_join._points(column)[:, 0].tolist() == [70_000, 100]
