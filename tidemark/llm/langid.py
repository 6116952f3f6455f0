"""Language identification by segmentation-marginalised unigrams.

For each language, probabilities over the pieces of a fixed public vocabulary are learned by expectation-maximisation.
A word's probability is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. Words are maximal runs of letters in lower case, whole whatever their length; since words hold
letters only, of the vocabulary the pieces of letters take part, all of them. A trie over them finds every piece that
each place of a word ends. Words longer than ``LONG_WORD`` teach nothing; when scored, their sums are rescaled on the way.

Defined cases: null text, empty text and text without letters get ``und`` and score 0; texts of any length are scored
whole; rows with a null lang teach nothing; a null id counts as not held out and teaches nothing; equal scores go to
the language first in order; repeated rows are kept; an empty table gives an empty table, and without any labelled row
every text is ``und``; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import released
from tidemark.llm.textscan import LETTER, Slice, classes, classes_of, lower_codes, packed, runs, slices_of, span_hashes

#: Labelled documents a language is learned from, at most, and the letters taken from all of its documents together.
FIT_DOCS, FIT_LETTERS = 1_500, 1_000_000
ROUNDS = 4
LONG_WORD = 32
#: Letters of words that are learned from in one step.
STEP_LETTERS = 100_000
FLOOR = 1e-7
#: Words that a worker remembers the probabilities of.
MEMO_WORDS = 60_000
#: A text's log odds count in full up to this many letters; beyond, they are scaled down, so that scores compare.
FULL_LETTERS = 60


def vocabulary_pieces(path: str) -> list[str]:
    """Letter-only pieces of a sentencepiece model, in lower case, without their word mark; in order, once each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    seen = {}
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).lstrip("▁").lower()
        if piece.isalpha():
            seen.setdefault(piece)
    return list(seen)


class Pieces:
    """A trie over the vocabulary; finds, letters exact, the pieces that end at each place of a word."""

    def __init__(self, pieces: list[str]):
        nodes, edges, ends = {"": 0}, {}, {}
        for i, piece in enumerate(pieces):
            for k in range(1, len(piece) + 1):
                node = nodes.setdefault(piece[:k], len(nodes))
                edges[nodes[piece[: k - 1]] << 21 | ord(piece[k - 1])] = node
            ends[nodes[piece]] = i
        keys = np.array(sorted(edges), np.int64)
        self.keys, self.child = keys, np.array([edges[k] for k in keys.tolist()], np.int32)
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[*ends]] = [*ends.values()]

    def lattice(self, codes: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
        """For each length from 1 on, the piece that ends at each place, or -1; the place's word is not left."""
        stop = np.repeat(edges[1:], np.diff(edges))
        wide = codes.astype(np.int64)
        begin, node, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        while len(begin) and len(self.keys):
            end = begin + len(out)
            inside = end < stop[begin]
            begin, end, node = begin[inside], end[inside], node[inside]
            key = node << 21 | wide[end]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            begin, end, node = begin[good], end[good], self.child[at[good]].astype(np.int64)
            found = np.full(len(codes), -1, np.int32)
            found[end] = self.piece[node]
            out.append(found)
        return out or [np.full(len(codes), -1, np.int32)]


def forward(lattice: list[np.ndarray], edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[place + word index + 1, language]: probability of a word's letters up to there. table: pieces x languages, last row the floor."""
    lengths = np.diff(edges)
    langs = table.shape[1]
    base = edges[:-1] + np.arange(len(lengths))
    alpha = np.zeros((int(edges[-1]) + len(lengths), langs))
    alpha[base] = 1.0
    by_size = np.argsort(-lengths, kind="stable")
    ordered = lengths[by_size]
    for place in range(int(lengths.max(initial=0))):
        live = by_size[: np.searchsorted(-ordered, -place, side="left")]
        at = edges[live] + place
        total = np.zeros((len(live), langs))
        for size in range(1, min(len(lattice), place + 1) + 1):
            piece = lattice[size - 1][at]
            if size == 1:
                total += alpha[base[live] + place] * table[piece]  # piece -1 is the last row, the floor
            else:
                good = np.flatnonzero(piece >= 0)
                if len(good):
                    total[good] += alpha[base[live[good]] + place + 1 - size] * table[piece[good]]
        alpha[base[live] + place + 1] = total
    return alpha


def log_forward(lattice: list[np.ndarray], start: int, end: int, table: np.ndarray) -> list[float]:
    """The logs of one word's probabilities, by the same sums, rescaled as they get small; for words of any length."""
    own = np.stack([piece[start:end] for piece in lattice], axis=1)
    place, size = np.nonzero(own >= 0)
    first = np.searchsorted(place, np.arange(end - start + 1)).tolist()
    piece, size = own[place, size], size.tolist()
    out = []
    for lang in range(table.shape[1]):
        p, floor = table[piece, lang].tolist(), float(table[-1, lang])
        recent, scale = [1.0], 0.0  # of the places before, as many as the longest piece has letters
        for i in range(end - start):
            total = sum(p[k] * recent[-1 - size[k]] for k in range(first[i], first[i + 1]))
            if own[i, 0] < 0:
                total += floor * recent[-1]
            recent = [*recent[1 - len(lattice) :], total] if len(lattice) > 1 else [total]
            if total < 1e-100:
                recent = [x / total for x in recent]
                scale += math.log(total)
        out.append(scale + math.log(recent[-1]))
    return out


def _counts_of(step: tuple[np.ndarray, np.ndarray, list[np.ndarray]], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How often each piece is expected in some words."""
    edges, back_codes, lattice = step
    lengths = np.diff(edges)
    base, of = edges[:-1] + np.arange(len(lengths)), np.repeat(np.arange(len(lengths)), lengths)
    inner = np.arange(len(of)) - edges[:-1][of]
    alpha = forward(lattice, edges, table)[:, 0]
    # beta by the forward pass over reversed words
    turned = [np.full(len(of), -1, np.int32) for _ in lattice]
    for k, piece in enumerate(lattice):
        ends = np.flatnonzero(piece >= 0)
        turned[k][back_codes[ends - k]] = piece[ends]
    beta = forward(turned, edges, table)[:, 0]
    whole = alpha[base + lengths]
    expected = np.zeros(len(table))
    for k, piece in enumerate(lattice):
        ends = np.flatnonzero(piece >= 0)
        w = of[ends]
        before = alpha[base[w] + inner[ends] - k]
        after = beta[base[w] + lengths[w] - 1 - inner[ends]]
        mass = before * table[piece[ends], 0] * after / whole[w] * counts[w]
        expected += np.bincount(piece[ends], weights=mass, minlength=len(table))
    return expected


def learn(words: list[str], counts: np.ndarray, pieces: Pieces, n_pieces: int) -> np.ndarray:
    """Piece probabilities of one language by EM over its counted words; the last row is the floor for unknown letters."""
    steps, at = [], 0
    while at < len(words):
        stop, letters = at, 0
        while stop < len(words) and letters < STEP_LETTERS:
            letters += len(words[stop])
            stop += 1
        s = Slice(words[at:stop])
        lengths = np.diff(s.edges)
        of = np.repeat(np.arange(len(lengths)), lengths)
        inner = np.arange(len(s.codes)) - s.edges[:-1][of]
        steps.append((slice(at, stop), (s.edges, s.edges[:-1][of] + lengths[of] - 1 - inner, pieces.lattice(s.codes, s.edges))))
        at = stop
    table = np.full((n_pieces + 1, 1), 1.0 / (n_pieces + 1))
    table[-1] = FLOOR
    for _ in range(ROUNDS):
        expected = sum((_counts_of(step, counts[part], table) for part, step in steps), np.zeros(n_pieces + 1))
        expected[-1] = 0.0
        probability = (expected + 0.01) / (expected.sum() + 0.01 * (n_pieces + 1))
        table = np.maximum(probability, 1e-9)[:, None]
        table[-1] = FLOOR
    return table[:, 0]


def _letters_of(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case codes, starts, ends) of a slice's words."""
    codes = lower_codes()[s.codes]
    return codes, *runs(s, classes()[codes] == LETTER)


class Model:
    def __init__(self, langs: list[str], pieces: list[str], tables: np.ndarray):
        self.langs, self.pieces, self.table = langs, Pieces(pieces), tables

    def predict(self, s: Slice, memo: Remembered) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, best language, score) of each text of a slice."""
        codes, start, end = _letters_of(s)
        n, langs = len(s.texts), len(self.langs)
        letters = np.zeros(n)
        if not len(start) or not langs:
            return letters, np.zeros(n, np.int64), np.zeros(n)
        blocks = packed(codes)
        first, at = classes_of(span_hashes(blocks, start, end), blocks, start, end)
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        words = [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        logs = memo.rows(words, self.logs)[at]
        doc = s.doc_of(start)
        letters = np.bincount(doc, weights=end - start, minlength=n)
        total = np.stack([np.bincount(doc, weights=logs[:, k], minlength=n) for k in range(langs)], axis=1)
        best = total.argmax(axis=1)
        scaled = (total - total.max(axis=1, keepdims=True)) * (np.minimum(letters, FULL_LETTERS) / np.maximum(letters, 1))[:, None]
        score = 1.0 / np.exp(scaled).sum(axis=1)
        return letters, best, np.where(letters > 0, score, 0.0)

    def logs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        sizes = np.array([len(w) for w in words])
        short = np.flatnonzero(sizes <= LONG_WORD)
        s = Slice([words[i] for i in short.tolist()])
        alpha = forward(self.pieces.lattice(s.codes, s.edges), s.edges, self.table)
        out[short] = np.log(alpha[s.edges[1:] + np.arange(len(short))])
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            codes = np.array([*map(ord, words[i])])
            out[i] = log_forward(self.pieces.lattice(codes, np.array([0, len(codes)])), 0, len(codes), self.table)
        return out


class Remembered:
    """Rows computed for words before; emptied when it holds too many."""

    def __init__(self, width: int):
        self.at: dict[str, int] = {}
        self.table = np.zeros((MEMO_WORDS, width))

    def rows(self, words: list[str], make) -> np.ndarray:
        fresh = [w for w in words if w not in self.at]
        if len(self.at) + len(fresh) > MEMO_WORDS:
            self.at.clear()
            if len(words) > MEMO_WORDS:
                return make(words)
            fresh = words
        if fresh:
            self.table[len(self.at) : len(self.at) + len(fresh)] = make(fresh)
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
        return self.table[[self.at[w] for w in words]]


def _part(col: F.Column) -> F.Column:
    return F.crc32(col.cast("string")) % 3


def fit(docs: DataFrame, path: str, fit_docs: int = FIT_DOCS, fit_letters: int = FIT_LETTERS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from at most about ``fit_docs`` hash-chosen documents of each language, and ``fit_letters`` letters of their words."""
    known = docs.where(F.col(lang_col).isNotNull() & (_part(F.col(id_col)) != 1)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = known.groupBy("l").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), fit_docs / F.col("n")) * (1 << 30)
    small = sizes.count() <= 100_000  # one row for each language
    chosen = known.join(F.broadcast(sizes) if small else sizes, "l").where(F.pmod(F.xxhash64(F.lit(2), "i"), F.lit(1 << 30)) < share)

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, s in slices_of(batch.column(0)):
                codes, start, end = _letters_of(s)
                if not len(start):
                    continue
                low = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                doc = s.doc_of(start).tolist()
                seen: dict[tuple[str, str], int] = {}
                for a, b, d in zip(start.tolist(), end.tolist(), doc, strict=True):
                    key = (langs[at + d], low[a:b])
                    seen[key] = seen.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array([*seen.values()])], ["lang", "word", "n"])

    words = chosen.select("t", "l").mapInArrow(released(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the most frequent words first, until the bound on letters
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    words = words.where(F.length("word") <= LONG_WORD).withColumn("letters", F.sum(F.length("word")).over(order)).where(F.col("letters") <= fit_letters)
    vocabulary = vocabulary_pieces(path)

    def em(key, group):
        table = learn(group.column("word").to_pylist(), group.column("n").to_numpy().astype(float), Pieces(vocabulary), len(vocabulary))
        return pa.table({"lang": pa.array([key[0].as_py()]), "p": pa.array([table.tolist()], pa.list_(pa.float64()))})

    learned = sorted((r["lang"], r["p"]) for r in words.groupBy("lang").applyInArrow(em, "lang string, p array<double>").collect())
    tables = np.array([p for _, p in learned]).T if learned else np.zeros((len(vocabulary) + 1, 0))
    return Model([x for x, _ in learned], vocabulary, np.ascontiguousarray(tables))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, letters) of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        memo = Remembered(len(m.langs))
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for first, s in slices_of(batch.column(1)):
                letters, best, score = m.predict(s, memo)
                pred = names[np.where((letters > 0) & bool(m.langs), best, len(m.langs))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(s.texts)), pa.array(pred, pa.string()), pa.array(score), pa.array(letters.astype(np.int64))], [id_col, "lang_pred", "score", "letters"])

    return docs.select(id_col, text_col).mapInArrow(released(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, letters long")


def predict_languages(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of each row, learned from the rows that are not held out."""
    model = fit(docs, path, id_col=id_col, text_col=text_col, lang_col=lang_col)
    held = F.coalesce(_part(F.col(id_col)) == 1, F.lit(False))
    return identify(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose text has letters and a language that is likelier than all others together."""
    model = fit(docs, path, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        memo = Remembered(len(m.langs))
        for batch in batches:
            for first, s in slices_of(batch.column(at)):
                keep = m.predict(s, memo)[2] >= least
                yield batch.slice(first, len(s.texts)).filter(pa.array(keep))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(released(run), docs.schema)
