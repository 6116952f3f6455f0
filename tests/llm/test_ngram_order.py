"""The order of prefixes: what very many texts quote comes last and does not let them meet."""

from collections import Counter

import numpy as np
from test_corpus_operators import check_components

from tidemark.llm import ngram_join


def quoting(n, passage, own):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join([f"w{x}" for x in rng.integers(0, 10**9, own)] + [f"p{k}" for k in range(passage)])) for i in range(n)]
    return rows + [(n + k, rows[k][1] + " tail") for k in range(0, 60, 3)]


def test_a_passage_makes_no_large_meetings(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOOK", 2)
    rows = quoting(500, 30, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = ngram_join.frequent_shingles(df)
    assert frequent.shape[1] == 27  # 26 of the passage, one of its end and the tail
    assert (frequent[0][1:] > frequent[0][:-1]).all() and sorted(frequent[1].tolist()) == list(range(27))
    marks = ngram_join.fingerprints(df).collect()
    met = Counter(s for r in marks for s in set(r["signatures"]))
    assert max(met.values()) < 20
    check_components(rows, ngram_join.jaccard_components(df).collect())


def test_texts_of_frequent_shingles_alone_link(spark, monkeypatch):
    """Prefixes that rare shingles do not fill go on with the frequent ones, in one order for all sets."""
    monkeypatch.setattr(ngram_join, "LOOK", 1)
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(80)]
    rows = [(i, " ".join(passage[int(a) : int(b)])) for i, (a, b) in enumerate(zip(rng.integers(0, 30, 120), rng.integers(40, 81, 120), strict=True))]
    check_components(rows, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_prefix_is_one_order():
    u = np.arange(10, 30, dtype=np.uint64)
    frequent = np.array([[11, 12, 14, 40], [2, 0, 1, 3]], np.uint64)
    assert ngram_join._prefix(u, 3, frequent).tolist() == [10, 13, 15]
    assert ngram_join._prefix(u, 20, frequent).tolist()[-3:] == [12, 14, 11]
    assert ngram_join._prefix(u, 3, ngram_join.NONE).tolist() == [10, 11, 12]
