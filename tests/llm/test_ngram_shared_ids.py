from pyspark.sql import functions as F

from tidemark.llm import ngram_join


def text(name, drop=0, size=120):
    return " ".join(f"{name}{i}" for i in range(drop, size))


def test_equal_ids_with_different_texts_and_null_ids(docs_of):
    # id 7 stands on texts of four families, each of which has a near copy of its own
    rows = [(7, text(x)) for x in "abcd"] + [(10 + i, text(x, 3)) for i, x in enumerate("abcd")]
    # a set that only rows without an id have, between two that are linked through it only
    rows += [(20, text("n", 0, 130)), (None, text("n", 14, 130)), (21, text("n", 28, 130))]
    rows += [(30, text("z"))]
    docs = docs_of([(i, t, "en", "s", len(t)) for i, t in rows])
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    want = [(7, 7)] * 4 + [(10 + i, 7) for i in range(4)] + [(20, 20), (None, 20), (21, 20), (30, 30)]
    assert got == sorted(want, key=str)


def test_one_of_each_component_stays_where_ids_are_shared(docs_of):
    # id 5: one text linked to document 1, and one that stands alone
    rows = [(1, text("a")), (5, text("a", 3)), (5, text("b")), (6, text("b", 2)), (8, text("c"))]
    docs = docs_of([(i, t, "en", "s", len(t)) for i, t in rows]).withColumn("twin", F.lit("clash")).withColumn("text_hash", F.lit("clash"))
    kept = ngram_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, text("a")), (5, text("b")), (8, text("c"))]
