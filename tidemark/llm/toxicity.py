"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps look-alike letters and digit substitutions to one letter each and everything that is neither letter nor
digit to a space. Terms are whole words or word beginnings, weighted by their log odds in toxic against other
labelled documents of a bounded, hash-chosen sample (``fit_rows`` documents at most, about; of the terms that are frequent
and one-sided enough the ``terms`` weightiest; both are parameters). A hit inside an exception phrase does not count. The sum of the
weights, over the root of the number of words, goes through a scale fitted on the same sample.

Defined cases: null and empty texts score 0; texts of any length are scanned whole; documents without a label, or
with a null one, teach nothing; rows with several labels count as toxic if any is; repeated rows are kept; an empty
table gives an empty table, and no labels give an empty lexicon (score 0); other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pii import ASCII
from tidemark.llm.tables import cut
from tidemark.llm.textscan import LETTER, NUMBER, Slice, classes, lower_codes, text_chunks

#: Labelled documents the lexicon is fitted on, at most about this many, chosen by a hash of the id.
FIT_ROWS = 12_000
#: Terms of the lexicon at most, and the least documents and log odds of each.
TERMS, LEAST_DOCS, LEAST_ODDS = 600, 6, 2.5
STEMS = (4, 5, 6)
ROOM = 100
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "trash collection")
#: Letters that digits and signs stand for; l and i fold together, since 1 stands for both.
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b"}


@lru_cache(1)
def fold_codes() -> np.ndarray:
    kinds = classes()
    table = np.where((kinds == LETTER) | (kinds == NUMBER), lower_codes(), np.uint32(32)).astype(np.uint32)
    for c, to in ASCII.items():
        table[c] = table[ord(to)]
    for c, to in SUBSTITUTES.items():
        table[ord(c)] = ord(to)
    table[ord("L")] = ord("i")
    return table


def fold(text: str) -> str:
    codes = fold_codes()[Slice([text]).codes]
    return " " + codes.astype("<u4").tobytes().decode("utf-32-le", "replace") + " "


def features(text: str) -> set[str]:
    """`` word `` for each word and `` stem`` for each longer word's beginnings."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if len(w) > n)
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for term, w in weights.items():
            self.automaton.add_word(term, (len(term), w))
        for phrase in exceptions:
            term = " " + " ".join(fold(phrase).split()) + " "
            self.automaton.add_word(term, (len(term), 0.0))
        self.automaton.make_automaton()

    def raw(self, text: str) -> float:
        folded = fold(text)
        hits: dict[int, float] = {}
        spared = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight:
                hits[start] = max(weight, hits.get(start, 0.0))
            else:
                spared.append((start, end))
        if not hits:
            return 0.0
        if spared:
            spared.sort()
            starts, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            hits = {at: w for at, w in hits.items() if (k := bisect_right(starts, at)) == 0 or ends[k - 1] <= at}
        total = sum(hits.values())
        return total / math.sqrt(folded.count(" ") + ROOM)


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of at most about ``fit_rows`` documents whose crc32 of the id, mod 5, is not 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = known.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(F.col(id_col), F.col(text_col).alias("t")).join(chosen, id_col).select("t", F.col("y").cast("int").alias("y"))


def fit_lexicon(sample: DataFrame, terms: int = TERMS) -> dict[str, float]:
    def count(batches):
        for batch in batches:
            toxic, other = Counter(), Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else other).update(features(t or ""))
                (toxic if y else other)[""] += 1
            seen = [*{**toxic, **other}]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([toxic[w] for w in seen], pa.int64()), pa.array([other[w] for w in seen], pa.int64())], ["term", "toxic", "other"])

    counts = cut(sample.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(f"toxic >= {LEAST_DOCS} or term = ''"))
    whole = counts.where("term = ''").first()
    if whole is None or not whole["toxic"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1.0)) - F.log((F.col("other") + 0.5) / (whole["other"] + 1.0))
    best = counts.where("term <> ''").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    rows = best.orderBy(F.desc(F.col("odds") * F.col("toxic")), "term").limit(terms).collect()
    return {r["term"]: r["odds"] for r in rows}


def fit_scale(sample: DataFrame, weights: dict[str, float], exceptions: tuple[str, ...]) -> float:
    """The raw score that best splits the sample, by the mean of the two classes' rates."""

    def score(batches):
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(lexicon.raw(t or "") * 100) for t in batch.column(0).to_pylist()], pa.int64()), batch.column(1)], ["b", "y"])

    # a row for each hundredth that some document of the bounded sample scores
    cells = sample.mapInArrow(score, "b long, y int").groupBy("b").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    positives, total = sum(r["p"] for r in cells), sum(r["n"] for r in cells)
    best, at, p, n = -1.0, 0.5, positives, total - positives
    fp, tp = n, positives
    for r in sorted(cells, key=lambda r: r["b"]):
        tp, fp = tp - r["p"], fp - (r["n"] - r["p"])
        value = tp / max(p, 1) - fp / max(n, 1)
        if value > best:
            best, at = value, (r["b"] + 1) / 100
    return max(at, 0.05)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, terms: int = TERMS, exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], float]:
    """(weights of the lexicon, scale) learned from labelled documents that are not held out."""
    sample = cut(labelled_sample(docs, labels, fit_rows, id_col, text_col, label_col))
    weights = fit_lexicon(sample, terms)
    return weights, fit_scale(sample, weights, exceptions) if weights else 1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, terms: int = TERMS, exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    weights, scale = fit(docs, labels, fit_rows, terms, exceptions, id_col, text_col, label_col)

    def run(batches):
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            raw = np.array([lexicon.raw(t) if t else 0.0 for _, texts in text_chunks(batch.column(1)) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw / (raw + scale))], [id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
