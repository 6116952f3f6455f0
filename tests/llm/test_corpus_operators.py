from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, neardup, ngram_join, queries, toxicity
from tidemark.llm.tables import components

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def smallest(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_and_long_graphs(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 200)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = smallest({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language ---


def test_language_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_language_id(spark, SF).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    table = np.array([[0.3], [0.2], [0.1], [0.05], [0.02], [1e-7]])
    probability = dict(zip(pieces, table[:, 0], strict=False))

    def brute(w):
        return 1.0 if not w else sum(probability[p] * brute(w[len(p) :]) for p in pieces if w.startswith(p))

    words = ["aba", "ab", "b", "ababa", "bbaab"]
    from tidemark.llm.textscan import Slice

    s = Slice(words)
    alpha = langid.forward(langid.Pieces(pieces).lattice(s.codes, s.edges), s.edges, table)
    got = alpha[s.edges[1:] + np.arange(len(words)), 0]
    assert got == pytest.approx([brute(w) for w in words])
    lattice = langid.Pieces(pieces).lattice(s.codes, s.edges)
    for i, w in enumerate(words):
        assert langid.log_forward(lattice, int(s.edges[i]), int(s.edges[i + 1]), table) == pytest.approx([np.log(brute(w))])


def test_every_letter_piece_takes_part_and_long_words_are_whole():
    pieces = langid.vocabulary_pieces(PIECES)
    assert max(map(len, pieces)) > 8
    model = langid.Model(["x", "y"], pieces, np.random.default_rng(1).random((len(pieces) + 1, 2)) / len(pieces))
    long_ = "internationalisierung" * 200
    logs = model.logs([long_, "international", "\u4e00" * 50_000])
    assert np.isfinite(logs).all() and logs[0].max() < logs[1].min()
    assert logs[2] == pytest.approx(50_000 * np.log(model.table[pieces.index("\u4e00") if "\u4e00" in pieces else -1]), rel=1e-6)


def test_language_odd_rows(spark, odd):
    got = {r["doc_id"]: r for r in langid.predict_languages(odd, PIECES).collect()}
    assert len(got) == 8 and got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["score"] == 0.0
    assert got[6]["lang_pred"] != "und" or got[1]["lang_pred"] == "und"
    assert langid.predict_languages(odd.limit(0), PIECES).count() == 0
    assert langid.keep_identified(odd, PIECES).columns == odd.columns


# --- embeddings ---


def brute_links(rows, threshold=0.93):
    links = defaultdict(set)
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            ok = a is not None and a == b and all(x and None not in x and np.isfinite(x).all() and any(x) for x in (v, w)) and len(v) == len(w)
            if ok and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def check_links(rows, got, least):
    links = brute_links(rows)
    total = sum(map(len, links.values()))
    want = {}
    found = 0
    by_id = {r["vec_id"]: r for r in got}
    for i, (k, _, _) in enumerate(rows):
        want[k] = len(links[i])
        assert by_id[k]["n_links"] <= want[k]
        found += by_id[k]["n_links"]
    assert found >= least * total
    return by_id, links


def test_embedding_links_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(map(float, r["embedding"] or [])), r["label"]) for r in table.collect()]
    check_links(rows, queries.op3_embedding_neardup(spark, SF).collect(), 0.9)


def test_embedding_links_near_the_threshold_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.standard_normal(32)
        base /= np.linalg.norm(base)
        for cosine in (1.0, 0.99, 0.95, 0.94, 0.92, 0.9):
            side = rng.standard_normal(32)
            side -= side @ base * base
            side /= np.linalg.norm(side)
            rows.append((len(rows), (cosine * base + np.sqrt(1 - cosine**2) * side).tolist(), k % 2))
    n = len(rows)
    rows += [(n + i, rows[0][1], 0) for i in range(300)]  # copies
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 32, 0), (n + 3, [float("nan")] * 32, 0), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:31] + [None], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit(1)).withColumn("copies", F.lit(1))
    got = neardup.link_vectors(df).collect()
    assert len(got) == len(rows)
    by_id, links = check_links(rows, got, 0.9)
    for i in range(n, n + 6):
        assert (by_id[i]["n_links"], by_id[i]["component_id"], by_id[i]["kept"]) == (0, i, True)
    assert by_id[n + 7]["component_id"] == n + 6 and not by_id[n + 7]["kept"]
    assert by_id[n - 1]["component_id"] == 0 and by_id[n - 1]["n_links"] >= 300
    assert neardup.link_vectors(df.limit(0)).count() == 0


def test_embedding_ids_that_repeat_on_other_vectors(spark):
    """Equal ids are vectors of their own: links do not mix, components are the smallest ids reached."""
    a, b, c = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0], [0.0, 0.1, 1.0, 0.0]
    rows = [(5, a, 0), (5, b, 0), (6, [1.0, 0.0, 0.0, 0.11], 0), (3, [0.0, 1.0, 0.11, 0.0], 0), (4, c, 0), (5, c, 1)]
    got = sorted(tuple(r) for r in neardup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([(5, 1, 5, True), (5, 1, 3, False), (6, 1, 5, False), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True)])


def test_blocks_and_buckets_agree(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check_links(rows, queries.op3_embedding_neardup(spark, "/root/testdata/sf0.001").collect(), 0.9)


# --- toxicity ---


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc > 0.95
    assert np.mean([p == y for _, y, p in held]) > 0.95
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_odd_rows_and_folding(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(odd, labels).count() == 9
    assert toxicity.score_toxicity(odd, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0
    lexicon = toxicity.Lexicon({" idiot ".replace("l", "i"): 3.0, " trash ": 2.0})
    for text in ("you idiot", "you 1d10t!", "ІDІOT", "(idiot)"):
        assert lexicon.raw(text) > 0
    for text in ("idiotic", "the trash can", "", "idio t"):
        assert lexicon.raw(text) == 0


# --- n-gram join ---


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(rows):
    sets = sets_of(rows)
    by_first = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_first[x].append(i)
    shared = Counter()
    for ids in by_first.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] += 1
    edges = [(a, b) for (a, b), o in shared.items() if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o)]
    return sets, smallest(sets, edges)


def check_components(rows, got):
    sets, want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_components(rows, queries.op10_ngram_join(spark, SF).collect())


@pytest.mark.parametrize("block", [8, 1024])
def test_ngram_join_of_drifting_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    rng = np.random.default_rng(9)
    rows = []
    passage = [f"p{k}" for k in range(60)]
    for size in (6, 20, 50, 66, 70, 90, 128, 130, 180, 300, 700):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 10**9, size)]
            if size > 100:
                base[10:70] = passage
            for _ in range(14):
                w = list(base)
                for _ in range(rng.integers(0, max(2, size // 18))):
                    at = rng.integers(0, len(w))
                    if rng.random() < 0.5:
                        w[at] = f"x{rng.integers(10**9)}"
                    else:
                        del w[at:]
                        w = w if len(w) > size * 0.7 else list(base)
                rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one two"), (len(rows) + 3, "ONE  two\n"), (len(rows) + 4, " ")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_components(rows, got)


def test_ngram_join_odd_rows(odd):
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == 9
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["component_id"] == 1 and by_id[2]["n_shingles"] == 0 and by_id[2]["component_id"] == 2
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0
    kept = ngram_join.keep_one_each(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect())[1] == 1 and kept.count() == 8


# --- pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tidemark.llm import bpe, pii

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "pii", "source_mix", "byte_bpe"]
    seen = [docs]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, seen[-1], sf)
        assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    first, second, third, fourth = seen[1:]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in first.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    _, want = brute_components([(r["doc_id"], r["text"]) for r in first.collect()])
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(set(want.values()))
    assert not any(pii.base_spans(r["text"]) for r in third.collect())
    encoding = bpe.Vocabulary(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    last = corpus_pipeline.STAGES[-1][1](spark, fourth, sf).collect()
    assert len(last) == fourth.count() and encoding is not None
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))
