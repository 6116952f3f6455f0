"""Main text of pages by a tree-structured graphical model over the DOM.

Every block of a page, and every run of text between blocks, is a node with a state: around the main text, main text,
or holding both. Potentials join each node with its parent, and each node with what is seen of it: its element, the
words of its class, id and role, and for text its length, share of links and punctuation. Potentials are relative
frequencies, counted by Spark over labelled pages. Messages run upward from the leaves and downward from the root,
sums of products in logarithms, which gives each node's exact marginal; text whose marginal of being main text is at
least a half comes out. Many pages go through the levels of their trees together.

Defined cases: a null or empty page has the empty text; pages of any length are read whole; text outside any element
belongs to the page; markup cut short by the end of a page is dropped, as browsers do; equal pages have equal texts,
repeated rows are kept; an empty table gives an empty table; other columns are not read. White space is what Unicode
says it is, with ``<br>`` among it. No seen word or element has probability 0, so that no page is without a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.htmltree import Tree, parse

AROUND, MAIN, BOTH = 0, 1, 2
STATES = 3
#: Words of class, id and role seen on fewer labelled nodes than this say nothing.
LEAST_SEEN = 3
#: Added to every count.
PRIOR = 0.1
#: What a word of a class can say at most, so that one word alone cannot outweigh the rest of a page.
MOST_SAID = 8.0
_ENDS = tuple(".!?…:;»”\"")


def leaf_features(text: str, linked: int) -> tuple[str, str]:
    """Length with share of links, and punctuation, each as a name."""
    words = text.count(" ") + 1
    share = linked / len(text)
    size = min(words.bit_length(), 7)
    return f"size:{size}:{0 if share < 0.1 else 1 if share < 0.6 else 2}", f"stop:{int(text.endswith(_ENDS))}:{int(size > 2)}"


def observed(tree: Tree, i: int) -> list[str]:
    """Names of what is seen of a node."""
    if tree.text[i] is not None:
        return list(leaf_features(tree.text[i], tree.linked[i]))
    return [f"tag:{tree.tag[i]}", *(f"word:{t}" for t in tree.tokens[i])]


def labels(tree: Tree) -> list[int]:
    """States of a labelled page's nodes: the mark of the nearest marked ancestor or of the node; unmarked ones hold both, unmarked text is around."""
    out: list[int] = []
    for i, up in enumerate(tree.parent):
        mark = tree.mark[i]
        above = out[up] if up >= 0 else BOTH
        out.append(int(mark) if mark in ("0", "1") else AROUND if above == BOTH and tree.text[i] is not None else above)
    return out


def count_labelled(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(what, above, state, n): how often each thing was seen in each state, and each state below each."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what, above, state = [], [], []
            for page in batch.column(0).to_pylist():
                tree = parse(page or "")
                told = labels(tree)
                for i, up in enumerate(tree.parent):
                    leaf = tree.text[i] is not None
                    names = observed(tree, i)
                    what += [*names, "under:leaf" if leaf else "under:block"]
                    above += [-1] * len(names) + [told[up] if up >= 0 else STATES]
                    state += [told[i]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(above, pa.int32()), pa.array(state, pa.int32())], ["what", "above", "state"])

    seen = pages.select(F.col(html_col).alias("html")).mapInArrow(see, "what string, above int, state int")
    return seen.groupBy("what", "above", "state").agg(F.count("*").alias("n"))


class Model:
    """Log potentials: ``below[kind][state above, state]`` (the last row is for the root) and ``says[name][state]``."""

    def __init__(self, counts: list[tuple[str, int, int, int]]):
        self.below = {k: np.full((STATES + 1, STATES), PRIOR) for k in ("block", "leaf")}
        seen: dict[str, np.ndarray] = {}
        for what, above, state, n in counts:
            if what.startswith("under:"):
                self.below[what[6:]][above, state] += n
            else:
                seen.setdefault(what, np.zeros(STATES))[state] += n
        for kind, table in self.below.items():
            table /= table.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore"):
                self.below[kind] = np.log(table)
        self.below["leaf"][:, BOTH] = -np.inf
        blocks = sum((v for k, v in seen.items() if k.startswith("tag:")), np.zeros(STATES))
        self.says: dict[str, np.ndarray] = {}
        for family in ("tag:", "size:", "stop:"):
            own = {k: v for k, v in seen.items() if k.startswith(family)}
            total = sum(own.values(), np.zeros(STATES))
            for k, v in own.items():
                self.says[k] = np.log((v + PRIOR) / (total + PRIOR * (len(own) + 1)))
        for k, v in seen.items():
            if k.startswith("word:") and v.sum() >= LEAST_SEEN:
                said = np.log((v + PRIOR) / (blocks + 2 * PRIOR))
                self.says[k] = np.maximum(said - said.max(), -MOST_SAID)

    def unary(self, tree: Tree) -> np.ndarray:
        """Log evidence of each node, by state."""
        out, says = np.zeros((len(tree.parent), STATES)), self.says
        for i in range(len(out)):
            for name in observed(tree, i):
                got = says.get(name)
                if got is not None:
                    out[i] += got
        return out


def fit(pages: DataFrame, html_col: str = "html") -> Model:
    """A model from labelled pages; only counts of the words and states of that bounded set come to the driver."""
    return Model([tuple(r) for r in count_labelled(pages, html_col).collect()])


def _logsum(x: np.ndarray) -> np.ndarray:
    top = np.maximum(x.max(axis=-1, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return (top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True)))[..., 0]


def marginals(parent: np.ndarray, depth: np.ndarray, leaf: np.ndarray, unary: np.ndarray, below: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of each state of each node of a forest, given all that is seen of its tree."""
    n = len(parent)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    step = np.where(leaf[:, None, None], below["leaf"], below["block"])
    inner, sent = unary.copy(), np.zeros((n, STATES))
    for at in reversed(levels[1:]):  # upward: what each subtree says of the node above it
        sent[at] = _logsum(step[at, :STATES] + inner[at][:, None, :])
        np.add.at(inner, parent[at], sent[at])
    belief = inner
    for k, at in enumerate(levels):  # downward: what all the rest of the tree says of each node
        if k == 0:
            belief[at] += step[at, STATES]
        else:
            rest = belief[parent[at]] - sent[at]
            belief[at] += _logsum(np.swapaxes(step[at, :STATES], 1, 2) + rest[:, None, :])
        belief[at] -= _logsum(belief[at])[:, None]
    return np.exp(belief)


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    starts = np.cumsum([0, *(len(t.parent) for t in trees)])
    parent = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, starts, strict=False)])
    depth = np.concatenate([t.depth for t in trees]).astype(np.int64)
    leaf = np.array([x is not None for t in trees for x in t.text])
    kept = marginals(parent, depth, leaf, np.concatenate([model.unary(t) for t in trees]), model.below)[:, MAIN] >= 0.5
    return ["\n".join(x for x, k in zip(t.text, kept[s:e], strict=True) if x is not None and k) for t, s, e in zip(trees, starts[:-1], starts[1:], strict=True)]


#: Characters of pages whose trees are held at once.
SLICE = 1 << 20


def main_text(page: Column, model: Model) -> Column:
    """The main text of a page column under a fitted model."""

    @F.arrow_udf("string")
    def told(pages: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for p in pages:
            held.append(p.as_py())
            size += len(held[-1] or "")
            if size >= SLICE:
                out += main_texts(held, model)
                held, size = [], 0
        return pa.array(out + main_texts(held, model), pa.string())

    return told(page)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), main_text(F.col(html_col), model).alias("__text"))
    return rows.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
