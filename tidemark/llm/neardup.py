"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

Rotations learned on a bounded sample turn unit vectors into balanced binary codes. Codes are cut into keys, one for each
table; vectors that share a key in some table and whose whole codes lie within a Hamming radius are candidates. Only codes
and ids are dealt out to the tables. Vectors follow once, for candidates alone, to the table in which a pair first meets,
and are compared there in double precision. How long a key is follows the number of vectors per label (so that buckets stay
about as large, at every size), and how many tables there are follows from the recall asked for at exactly the threshold.
Large buckets are cut in blocks, and each pair of blocks is a task. What leaves a block is one row per vector: links
counted, and a spanning star.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing (0 links, a component of their own); vectors of other length never link; equal vectors form one class first,
so that thousands of copies cost one comparison, and their links are counted from class sizes; repeated ids count as
vectors of their own, with the smaller of equal ids as component; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import Forest, bounds, by_sorted_key, components, cut, stage

#: Vectors the rotations are learned from, at most about.
FIT_VECTORS = 20_000
RECALL, BUCKET, BLOCK = 0.97, 32, 1024
#: Deviations that the Hamming radius lies above the mean distance of codes at the threshold.
SLACK = 5
#: Rows of a broadcast table of classes with very many copies at most, and copies from which a class may be one.
HOT_ROWS, HOT_COPIES = 100_000, 256


def tables_for(n_label: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables) for labels of up to so many vectors."""
    bits = max(8, math.ceil(math.log2(max(n_label, 1) / BUCKET + 1)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def radius_for(size: int, threshold: float) -> int:
    """Hamming radius over codes of so many bits that pairs at the threshold as good as never exceed."""
    p = math.acos(threshold) / math.pi
    return math.ceil(size * p + SLACK * math.sqrt(size * p * (1 - p)))


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Projection (dimensions x bits) whose signs lose the least, from unit rows; principal directions, then ITQ."""
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :bits]
    v = x @ basis
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((basis.shape[1],) * 2))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return basis @ r


def usable(vector: Column, label: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _key_type(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def _codes(x: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """Keys (rows x tables) of unit rows; together they are the code."""
    flags = np.concatenate([x @ r >= 0 for r in rotations], axis=1)[:, : bits * tables]
    weights = 1 << np.arange(bits)
    return (flags.reshape(len(x), tables, bits) @ weights).astype(_key_type(bits))


def _unit(lists: pa.Array) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _named(vector: Column) -> list[Column]:
    """Two hashes that name a vector by its content."""
    return [F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit("second"), vector).alias("h2")]


def link_vectors(df: DataFrame, threshold: float = 0.93, fit_vectors: int = FIT_VECTORS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    good = usable(F.col("v"), F.col("label"))
    own_type = "float" if rows.schema["v"].dataType.simpleString() == "array<float>" else "double"
    clean = F.transform("v", lambda x: x.cast(own_type) + F.lit(0.0).cast(own_type))  # no negative zero
    # classes of equal vectors of a label; the smallest id stands for each
    classes = rows.where(good).groupBy("label", clean.alias("v")).agg(F.min("id").alias("c"), F.count("*").alias("copies"))
    # a class is named by a hash of label and content, since an id may stand on several vectors
    classes = stage(classes.withColumns({"dim": F.size("v"), "k": F.xxhash64(F.lit("class"), "label", "v")}))
    shape = classes.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row for each length of vector
    most, total = classes.groupBy("label", "dim").agg(F.count("*").alias("n"), F.sum("copies").alias("m")).agg(F.max("n"), F.sum("m")).first()
    narrow = rows.select("id", "label", F.when(good, F.struct(*_named(clean))).alias("h")).select("id", "label", "h.*")
    if not shape:
        return _result(narrow.withColumns({"n": F.lit(0).cast("long"), "component": F.col("id")}), id_col)
    links = None
    for dim, n in ((r["dim"], r["n"]) for r in shape):
        bits, tables = tables_for(most, threshold)
        own = classes.where(F.col("dim") == dim)
        share = min(1.0, fit_vectors / n)
        sample = own.where(F.pmod(F.xxhash64(F.lit(3), "k"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else own
        x = np.array([r[0] for r in sample.select("v").collect()], np.float64).reshape(-1, dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        width = min(dim, 64)
        rotations = [learn_rotation(x, width, seed) for seed in range(math.ceil(bits * tables / width))]
        found = cut(_linked(own, rotations, bits, tables, threshold))
        links = found if links is None else links.union(found)
    reach = components(links.where("u <> root").select("u", "root")).withColumnRenamed("id", "k")
    degree = links.groupBy(F.col("u").alias("k")).agg(F.sum("n").alias("others"))
    told = classes.select("k", "c", "label", "copies", *_named(F.col("v"))).join(degree, "k", "left").join(reach, "k", "left").withColumn("group", F.coalesce("component_id", "k"))
    told = cut(told.select("group", "c", "label", "h1", "h2", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n")))
    told = told.join(told.groupBy("group").agg(F.min("c").alias("component")), "group").drop("group", "c")
    # vectors with very many copies are few, whatever the data: their rows meet them by a broadcast, all others by a shuffle
    bar = max(HOT_COPIES, (total or 0) // HOT_ROWS)
    keys, told = ["label", "h1", "h2"], cut(told)
    hot = F.broadcast(told.where(F.col("copies") > bar).drop("copies"))
    known, blank = narrow.where("h1 is not null"), narrow.where("h1 is null")
    cold = known.join(hot, keys, "left_anti").join(told.where(F.col("copies") <= bar).drop("copies"), keys, "left")
    out = known.join(hot, keys).unionByName(cold).unionByName(blank.withColumns({"n": F.lit(0).cast("long"), "component": F.col("id")}))
    return _result(out, id_col)


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _met_before(keys: np.ndarray, t: int, some: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share a key in a table before this one."""
    out = np.zeros((len(some), len(right)), bool)
    for k in range(t):
        out |= keys[some, k][:, None] == keys[right, k][None, :]
    return out


def _keys(group: pa.Table, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("code").to_pylist()), _key_type(bits)).reshape(group.num_rows, -1)


def _pairs(group: pa.Table, bits: int, near):
    """For each task of a run of whole ones, in blocks: (rows of the left block, rows of the right one, which pairs are near)."""
    task, t, side = group.column("task").to_numpy(), group.column("t").to_numpy(), group.column("side").to_numpy()
    label = group.column("lab").to_numpy()
    keys, edge = _keys(group, bits), bounds(task)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        rows, own = np.arange(a, b), side[a:b]
        whole = own[0] < 0
        left, right = (rows, rows) if whole else (rows[own == 0], rows[own == 1])
        for at in range(0, len(left), BLOCK):
            some = left[at : at + BLOCK]
            close = near(some, right) & (label[some][:, None] == label[right][None, :])
            if whole:
                close &= some[:, None] < right[None, :]
            if close.any():
                yield some, right, close & ~_met_before(keys, int(t[a]), some, right)


def _linked(classes: DataFrame, rotations: list[np.ndarray], bits: int, tables: int, threshold: float) -> DataFrame:
    """(u, n, root) rows: vectors linked with class u in one block, and the first class of its local component."""
    radius = radius_for(bits * tables, threshold)

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                keys = _codes(_unit(batch.column("v")), rotations, bits, tables)
                code = pa.array([row.tobytes() for row in keys], pa.binary())
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tables, pa.array(keys.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("lab"), code, lists], ["k", "lab", "code", "keys"])

    coded = cut(classes.select("k", F.xxhash64("label").alias("lab"), "v").mapInArrow(index, "k long, lab long, code binary, keys array<int>"))
    bucket = F.xxhash64("lab", "t", "key").alias("bucket")
    placed = coded.select("k", "lab", "code", F.posexplode("keys").alias("t", "key")).select("k", "lab", "code", "t", bucket)
    # buckets too large for one block are cut in blocks, and every pair of blocks becomes a task of its own
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    sizes = cut(sizes.select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")))
    placed = placed.join(F.broadcast(sizes) if sizes.count() <= HOT_ROWS else sizes, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("k", "t"), F.col("parts")).cast("int")
    placed = placed.withColumn("b", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.xxhash64("bucket", F.least("b", "other"), F.greatest("b", "other"))
    side = F.when(F.col("b") == F.col("other"), -1).otherwise((F.col("b") > F.col("other")).cast("int"))
    dealt = placed.select(task.alias("task"), "k", "lab", "t", "code", side.alias("side"))

    def candidates(group: pa.Table) -> pa.Table:
        """Rows whose code has another within the radius in their task, that it did not meet in a table before."""
        keys = _keys(group, bits)

        def near(some: np.ndarray, right: np.ndarray) -> np.ndarray:
            apart = np.zeros((len(some), len(right)), np.uint16)
            for k in range(keys.shape[1]):
                apart += np.bitwise_count(keys[some, k][:, None] ^ keys[right, k][None, :])
            return apart <= radius

        keep = np.zeros(group.num_rows, bool)
        for some, right, close in _pairs(group, bits, near):
            keep[some[close.any(axis=1)]] = True
            keep[right[close.any(axis=0)]] = True
        return group.filter(pa.array(keep))

    schema = "task long, k long, lab long, t int, code binary, side int"
    survivors = cut(by_sorted_key(dealt, "task", ["k"], candidates, schema))
    fetched = survivors.join(classes.select("k", "v", "copies"), "k").select("task", "k", "lab", "t", "code", "side", "v", "copies")

    def compare(group: pa.Table) -> pa.Table:
        k, copies = group.column("k").to_numpy(), group.column("copies").to_numpy()
        x = _unit(group.column("v").combine_chunks())
        forest, n = Forest(len(k)), np.zeros(len(k), np.int64)
        for some, right, close in _pairs(group, bits, lambda some, right: x[some] @ x[right].T >= threshold):
            n[some] += close @ copies[right]
            n[right] += close.T @ copies[some]
            for row in np.flatnonzero(close.any(axis=1)).tolist():
                for col in np.flatnonzero(close[row]).tolist():
                    forest.join(int(some[row]), int(right[col]))
        hit = np.flatnonzero(n)
        least: dict[int, int] = {}
        for i in hit.tolist():
            r = forest.find(i)
            least[r] = min(least.get(r, int(k[i])), int(k[i]))
        return pa.table({"u": k[hit], "n": n[hit], "root": np.array([least[forest.find(int(i))] for i in hit], np.int64)})

    return by_sorted_key(fetched, "task", ["k"], compare, "u long, n long, root long")
