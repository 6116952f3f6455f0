"""N-gram Jaccard join over a count-vector R-tree.

A document is its set of distinct word shingles. Shingles hash into groups; the counts per group are the document's
point, and the sum of coordinate minima bounds the overlap of two points from above, for points and for the boxes of
the tree alike.

The tree's first level does not split space but content, since boxes alone prune little in so many dimensions: at the
number of groups chosen for a band of set sizes, the content of every group is a signature, and documents meet where
a signature is equal. Two sets at the threshold differ in at most d shingles, which leave about groups * exp(-d /
groups) groups alone; groups are chosen so that at least ``EQUAL`` are expected, so the chance that a link has no
signature in common is below exp(-EQUAL). Sets under ``SMALL`` shingles use prefixes in one order of all shingles
instead, which miss nothing: shingles found frequent in a part of the texts come last, the most frequent at the end, all
others before them by hash, so that a passage that many texts quote seldom lets them meet. Under a signature, points lie sorted by set size in leaves; leaves and points whose bound is too low are
pruned. What survives is grouped, and within a group every pair that the bound allows is verified on the sets.
Signatures of very many sets, such as those of a passage that a third of all documents quote, are told by their counts in
a part of the sets chosen by hash; that only decides their way: each is cut in blocks, and every pair of blocks is a task.

A set is named by a 64-bit hash of it (two different sets among 10^8 share one with a chance below 0.1 %).

Defined cases: null and empty texts and texts without words have 0 shingles and link with nothing; a text of fewer
words than a shingle is one shingle; texts of any length are taken whole; equal sets link (class first, so copies cost
nothing); rows with the same id are rows of their own with the id as component at most; a null id keeps its shingle
count and its own null component unless its set links; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import Forest, bounds, by_sorted_key, components, cut, discard, released, stage
from tidemark.llm.textscan import Slice, mix, packed, runs, slices_of, span_hashes

SHINGLE = 5
SMALL, EQUAL, COORDINATES = 256, 20, 64
LEAF, BLOCK = 64, 1024
#: One set of so many is looked at to tell hot signatures; at least so many of them make a signature hot.
LOOK, SEEN = 64, 16
#: In how many of the texts looked at a shingle must be to come late in the order of prefixes.
OFTEN = 4
#: Rows of a broadcast table of hot signatures, classes or frequent shingles at most; what counts as hot follows from it.
HOT_ROWS = 100_000
#: Copies of a set from which its rows are joined apart.
HOT_COPIES = 256
U = np.uint64
NONE = np.zeros((2, 0), np.uint64)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(0x110000, dtype=np.uint32)
    lower[ord("A") : ord("Z") + 1] += 32
    word = np.ones(0x110000, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return lower, word


def shingle_hashes(s: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of a slice, and the text it is from; a shorter text has one of all its words."""
    lower, word = _tables()
    start, end = runs(s, word[s.codes])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = span_hashes(packed(lower[s.codes]), start, end)
    doc = s.doc_of(start)
    n = len(words)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    last = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))  # end of each word's text
    index = np.arange(n)
    whole = index + size <= last
    short = np.zeros(n, bool)
    short[first] = np.append(first[1:], n) - first < size
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * U(0x2127599BF4325C37) + np.where(index + k < last, words[np.minimum(index + k, n - 1)], U(0))
    keep = whole | short
    return mix(out[keep]), doc[keep]


def levels(n: int, share: tuple[int, int]) -> list[tuple[int, int]]:
    """(level, groups) of the bands a set of this size takes part in: its own, and the one below if a partner may be there."""
    top = int(math.log2(n / SMALL))
    own = [top] + ([top - 1] if top and n * share[0] < share[1] * (SMALL << top) else [])
    return [(k, _groups(k, share)) for k in own]


@lru_cache(64)
def _groups(level: int, share: tuple[int, int]) -> int:
    """Fewest groups of which EQUAL are expected to be left alone by the differences of two linked sets of the band."""
    a, b = share
    d = (b - a) / (b + a) * (1 + b / a) * (2 * (SMALL << level) - 1)  # a partner may have b / a times the shingles
    g = EQUAL
    while g * math.exp(-d / g) < EQUAL:
        g += max(1, g // 50)
    return g


def _prefix(u: np.ndarray, size: int, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of prefixes; frequent: hashes in order, and the places of these."""
    if not frequent.shape[1]:
        return u[:size]
    at = np.minimum(np.searchsorted(frequent[0], u), frequent.shape[1] - 1)
    late = frequent[0, at] == u
    rare = u[~late]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, u[late][np.argsort(frequent[1, at[late]])]])[:size]


def signatures(u: np.ndarray, share: tuple[int, int], frequent: np.ndarray = NONE) -> np.ndarray:
    """Signatures of a set, given as sorted distinct hashes."""
    n, out = len(u), []
    a, b = share
    if n < SMALL or n * a < b * SMALL:
        out.append(mix(_prefix(u, n - -(-a * n // b) + 1, frequent) ^ U(0x5BD1E995)))
    if n >= SMALL:
        for level, groups in levels(n, share):
            g = ((u >> U(32)) * U(groups)) >> U(32)  # grows with u
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            out.append(mix(np.add.reduceat(mix(u ^ U(0xA5A5 + level)), at) + g[at]))
    return np.concatenate(out)


def point(u: np.ndarray) -> bytes:
    """Counts per coordinate: 16 bits each, or 32 in sets that could need more."""
    counts = np.bincount((u & U(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES)
    return counts.astype("<u2" if len(u) < 1 << 16 else "<u4").tobytes()


def _points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    listed = column.to_pylist()
    if any(len(x) > 2 * COORDINATES for x in listed):
        listed = [x if len(x) > 2 * COORDINATES else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in listed]
        return np.frombuffer(b"".join(listed), "<u4").reshape(-1, COORDINATES)
    return np.frombuffer(b"".join(listed), "<u2").reshape(-1, COORDINATES)


def frequent_shingles(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Hashes of shingles that very many texts have, in order, and their places from the rarest to the most frequent.

    They are told by their counts in a 64th of the texts. That only decides the order of prefixes, which may be any.
    """

    def run(batches):
        for batch in batches:
            for _, s in slices_of(batch.column(0)):
                hashes, doc = shingle_hashes(s)
                edge = np.searchsorted(doc, np.arange(len(s.texts) + 1))
                sets = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    looked = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where(F.pmod("h", F.lit(LOOK)) == 0).dropDuplicates(["h"])
    counts = looked.select("text").mapInArrow(released(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("seen")).where(F.col("seen") >= OFTEN)
    most = counts.orderBy(F.desc("seen"), "shingle").limit(HOT_ROWS).toArrow().column("shingle").to_numpy().view(np.uint64)
    by_hash = np.argsort(most)
    return np.stack([most[by_hash], (len(most) - 1 - by_hash).astype(np.uint64)])


def fingerprints(docs: DataFrame, share: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, set_id, point, signatures) of each row."""
    frequent = frequent_shingles(docs, text_col)

    def run(batches):
        for batch in batches:
            for first, s in slices_of(batch.column(1)):
                hashes, doc = shingle_hashes(s)
                edge = np.searchsorted(doc, np.arange(len(s.texts) + 1))
                n, ids, points, signs = [], [], [], []
                for i in range(len(s.texts)):
                    u = np.unique(hashes[edge[i] : edge[i + 1]])
                    n.append(len(u))
                    ids.append(int(mix(np.array([mix(u).sum(dtype=np.uint64)]))[0] >> U(1)) if len(u) else None)
                    points.append(point(u) if len(u) else None)
                    signs.append(signatures(u, share, frequent).view(np.int64) if len(u) else np.zeros(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in signs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, len(s.texts)) for c in (0, 2)), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(points, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(signs)))],
                    [id_col, "text_hash", "n_shingles", "set_id", "point", "signatures"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(released(run), f"`{id_col}` {kind}, text_hash long, n_shingles long, set_id long, point binary, signatures array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(set_id, n, point, hashes) of rows (set_id, text)."""

    def run(batches):
        for batch in batches:
            for first, s in slices_of(batch.column(1)):
                hashes, doc = shingle_hashes(s)
                edge = np.searchsorted(doc, np.arange(len(s.texts) + 1))
                sets = [np.unique(hashes[edge[i] : edge[i + 1]]) for i in range(len(s.texts))]
                sizes = [len(x) for x in sets]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(s.texts)), pa.array(sizes, pa.int64()), pa.array([point(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))],
                    ["set_id", "n", "point", "hashes"],
                )

    return docs.mapInArrow(released(run), "set_id long, n long, point binary, hashes array<long>")


class Tree:
    """A count-vector R-tree over points that are sorted by set size: leaves of LEAF points under boxes of their maxima."""

    def __init__(self, n: np.ndarray, points: np.ndarray, share: tuple[int, int]):
        self.n, self.points, self.share = n, points.astype(np.int32), share
        starts = np.arange(0, len(n), LEAF)
        self.starts = starts
        self.low = n[starts] if len(n) else n
        self.high = n[np.minimum(starts + LEAF, len(n)) - 1] if len(n) else n
        self.box = np.maximum.reduceat(self.points, starts, axis=0) if len(n) else self.points

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` whose size and bound allow a link with point i."""
        a, b = self.share
        n, p = self.n[i], self.points[i]
        among = among[(self.n[among] * b >= a * n) & (self.n[among] * a <= b * n)]
        if len(among) > LEAF:
            # overlap / (n + m - overlap) >= a / b  <=>  (a + b) overlap >= a (n + m); a box has m >= its least size
            good = (a + b) * np.minimum(self.box, p).sum(axis=1) >= a * (n + self.low)
            among = among[good[among // LEAF]]
        if not len(among):
            return among
        least = np.minimum(self.points[among], p).sum(axis=1)
        return among[(a + b) * least >= a * (n + self.n[among])]


def _allowed_edges(share: tuple[int, int]):
    """Spanning edges of the sets that the bound lets be linked, under each signature, or between two blocks of a hot one."""

    def run(group: pa.Table) -> pa.Table:
        keys, ids, sides = group.column("task").to_numpy(), group.column("set_id").to_numpy(), group.column("side").to_numpy()
        n, points = group.column("n").to_numpy(), _points(group.column("point"))
        u, v = [], []
        edge = bounds(keys)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a == 1:
                continue
            if b - a == 2 and sides[a] < 0:
                x, y = share
                if n[a] * y >= x * n[a + 1] and (x + y) * np.minimum(points[a], points[a + 1]).astype(np.int64).sum() >= x * (n[a] + n[a + 1]):
                    u.append(ids[a])
                    v.append(ids[a + 1])
                continue
            tree, side = Tree(n[a:b], points[a:b], share), sides[a:b]

            def near(i: int, among: np.ndarray, tree=tree, side=side) -> np.ndarray:
                return tree.near(i, among if side[i] < 0 else among[side[among] != side[i]])

            for i, j in _grow(b - a, near):
                u.append(ids[a + i])
                v.append(ids[a + j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _dealt(rows: DataFrame, key: str, parts: F.Column) -> DataFrame:
    """Rows with ``task`` and ``side``: a key of several parts becomes one task for each pair of its blocks, each row in those of its block."""
    cut_up = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    cut_up = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.when(F.col("parts") > 1, F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col(key))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    return cut_up.withColumn("task", task).withColumn("side", side).drop("parts", "own", "other")


def _meetings(signs: DataFrame) -> DataFrame:
    """(sig, set_id, parts) of the signatures that several sets have; hot ones in parts of about a block."""
    looked = signs.where(F.pmod(F.xxhash64("set_id", F.lit(7)), F.lit(LOOK)) == 0)
    counts = cut(looked.groupBy("sig").agg(F.count("*").alias("seen")).where(F.col("seen") >= SEEN))
    total = counts.agg(F.sum("seen")).first()[0] or 0
    hot = counts.where(F.col("seen") >= max(SEEN, total // HOT_ROWS))  # so that they are at most HOT_ROWS
    parts = F.ceil(F.col("seen") * LOOK / BLOCK).cast("int")
    warm = signs.join(F.broadcast(hot.select("sig", parts.alias("parts"))), "sig").select("sig", "set_id", "parts")

    def shared(batches):
        """Rows whose signature the row before or after has too; of what came before, one row is held back."""
        held, doubt = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.concatenate([[doubt], same]) | np.concatenate([same, [False]])
            last = batch.slice(batch.num_rows - 1)
            doubt, held = bool(len(same) and same[-1]) or (batch.num_rows == 1 and doubt), last
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if held is not None and doubt:
            yield held

    cold = signs.join(F.broadcast(hot), "sig", "left_anti").repartition("sig").sortWithinPartitions("sig", "set_id")
    cold = cold.mapInArrow(released(shared), "sig long, set_id long").withColumn("parts", F.lit(1))
    return stage(cold.unionByName(warm))


def _grow(m: int, near):
    """Edges of a spanning forest: each reached point looks among those not yet reached only."""
    left = np.ones(m, bool)
    for root in range(m):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            got = near(i, np.flatnonzero(left))
            left[got] = False
            queue += got.tolist()
            for j in got.tolist():
                yield i, j


def _verified_edges(share: tuple[int, int]):
    """Spanning edges of the true links inside each group of candidates, or between two blocks of a large one."""
    a, b = share

    def run(group: pa.Table) -> pa.Table:
        keys, ids, side = group.column("task").to_numpy(), group.column("set_id").to_numpy(), group.column("side").to_numpy()
        n, points = group.column("n").to_numpy(), _points(group.column("point"))
        lists = group.column("hashes").combine_chunks()
        flat, offset = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])
        u, v = [], []
        edge = bounds(keys)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            tree = Tree(n[lo:hi], points[lo:hi], share)
            two = side[lo:hi]

            def near(i: int, among: np.ndarray, tree=tree, lo=lo, two=two) -> np.ndarray:
                among = tree.near(i, among)
                if two[i] >= 0:
                    among = among[two[among] != two[i]]
                if not len(among):
                    return among
                own = flat[offset[lo + i] : offset[lo + i + 1]]
                sizes = n[lo + among]
                places = np.repeat(offset[lo + among] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                other = flat[places]
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                same = np.add.reduceat((own[at] == other).astype(np.int64), np.cumsum(sizes) - sizes)
                return among[(a + b) * same >= a * (n[lo + i] + sizes)]

            for i, j in _grow(hi - lo, near):
                u.append(ids[lo + i])
                v.append(ids[lo + j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def set_links(docs: DataFrame, marks: DataFrame, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(u, v) edges between different sets that span the same components as all links do. marks: staged fingerprints."""
    unique = marks.where("set_id is not null").select("set_id", "n_shingles", "signatures").dropDuplicates(["set_id"])
    signs = unique.select(F.explode("signatures").alias("sig"), "set_id")

    met = _meetings(signs)
    points = marks.where("set_id is not null").select("set_id", F.col("n_shingles").alias("n"), "point").dropDuplicates(["set_id"])
    placed = _dealt(met.join(points, "set_id").select("sig", "set_id", "n", "point", "parts"), "sig", F.col("parts"))
    allowed = by_sorted_key(placed.select("task", "set_id", "n", "point", "side"), "task", ["n", "set_id"], _allowed_edges(share), "u long, v long")
    allowed = cut(allowed)
    discard(met)
    candidates = cut(components(allowed).select(F.col("id").alias("set_id"), F.col("component_id").alias("g")))
    # one text for each candidate set, from its first row by id and text: an id may be null or stand on rows of different texts
    row = F.struct(F.col(id_col).alias("row_id"), "text_hash")
    first = marks.join(candidates, "set_id", "left_semi").groupBy("set_id").agg(F.min(row).alias("row")).select("set_id", "row.*")
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own_hash"))
    texts = rows.join(_some(cut(first)), F.col("own_id").eqNullSafe(F.col("row_id")) & (F.col("own_hash") == F.col("text_hash"))).select("set_id", "text")
    sets = _sets(texts).join(candidates, "set_id").dropDuplicates(["set_id"])
    sizes = candidates.groupBy("g").agg(F.count("*").alias("m"))
    sets = _dealt(sets.join(sizes, "g"), "g", F.ceil(F.col("m") / BLOCK).cast("int"))
    return by_sorted_key(sets.select("task", "set_id", "n", "point", "hashes", "side"), "task", ["n", "set_id"], _verified_edges(share), "u long, v long")


def _row_components(docs: DataFrame, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_shingles, component_id) of each row."""
    marks = stage(fingerprints(docs, share, id_col, text_col))
    narrow = marks.select(id_col, "text_hash", "n_shingles", "set_id")
    linked = components(set_links(docs, marks, share, id_col, text_col)).select(F.col("id").alias("set_id"), F.col("component_id").alias("c"))
    classes = narrow.where("set_id is not null").groupBy("set_id").agg(F.min(id_col).alias("least"), F.count("*").alias("copies"))
    named = cut(classes.join(linked, "set_id", "left").withColumn("c", F.coalesce("c", "set_id")))
    heads = named.groupBy("c").agg(F.min("least").alias("head"))
    reach = named.join(heads, "c").select("set_id", "head", "copies")
    # sets of very many copies are few, whatever the data: their rows meet them by a broadcast, all others by a shuffle
    rows = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(reach.where(F.col("copies") > max(HOT_COPIES, rows // HOT_ROWS)).drop("copies"))
    known, blank = narrow.where("set_id is not null"), narrow.where("set_id is null").withColumn("head", F.lit(None).cast(narrow.schema[id_col].dataType))
    cold = known.join(hot, "set_id", "left_anti").join(reach.where(F.col("copies") <= max(HOT_COPIES, rows // HOT_ROWS)).drop("copies"), "set_id", "left")
    out = known.join(hot, "set_id").unionByName(cold).unionByName(blank)
    return out.select(id_col, "text_hash", "n_shingles", F.coalesce("head", F.col(id_col)).alias("component_id"))


def jaccard_components(docs: DataFrame, share: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row; links at a Jaccard similarity of share[0] / share[1] or more."""
    return _row_components(docs, share, id_col, text_col).drop("text_hash")


#: Ids to drop are broadcast up to this many (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def _some(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keep_one_each(docs: DataFrame, share: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one row of each component, that of the smallest id; of rows with one id, one; rows without an id stay.

    Only ids are joined and dealt out; the texts stay where they are, but for those of rows that share an id. Of these, one
    whose own text is in the component named by the id stays, if there is one.
    """
    named = cut(_row_components(docs, share, id_col, text_col)).where(F.col(id_col).isNotNull())
    head = F.col(id_col) == F.col("component_id")
    losers = named.where(~head).select(id_col)
    twins = cut(named.groupBy(F.col(id_col).alias("twin")).agg(F.count("*").alias("n"), F.min(F.when(head, F.col("text_hash"))).alias("head_hash")).where("n > 1").drop("n"))
    kept = docs.join(_some(cut(losers.union(twins.select("twin")).distinct())), id_col, "left_anti")
    if twins.isEmpty():
        return kept.select(docs.columns)
    once = docs.join(twins, (docs[id_col] == twins["twin"]) & (F.xxhash64(docs[text_col]) == twins["head_hash"]), "left_semi").dropDuplicates([id_col])
    return kept.select(docs.columns).unionByName(once.select(docs.columns))
