"""Shared table helpers: reading, cutting lineage, streaming over sorted groups, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in this process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spark-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write a wide intermediate table once, as Parquet in the shared folder, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def released(fn: Callable) -> Callable:
    """A function over batches that gives freed memory back to the system when its task ends, since workers live on.

    Freed pages otherwise stay with a worker, and stage after stage adds to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of whole groups from batches that come sorted by ``key``; holds back the group that may go on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut_at = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and cut_at == 0 and held[-1].column(key)[-1].as_py() == keys[0]:
            held.append(batch)
            continue
        if cut_at or held:
            first = [*held, batch.slice(0, cut_at)] if cut_at else held
            yield pa.Table.from_batches([b for b in first if b.num_rows])
        held = [batch.slice(cut_at)]
    if held:
        yield pa.Table.from_batches(held)


def by_sorted_key(df: DataFrame, key: str, then: list[str], fn: Callable, schema: str) -> DataFrame:
    """Deal rows out by ``key``, sort, and hand runs of whole groups to ``fn(pa.Table) -> pa.Table | None``."""

    def run(batches):
        for group in sorted_groups(batches, key):
            out = fn(group)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return df.repartition(key).sortWithinPartitions(key, *then).mapInArrow(released(run), schema)


def bounds(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the end of the last."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


class Forest:
    """Union-find over a bounded set of local indexes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    """Replace the edges of a chunk by the edges of a spanning star of each of its components."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(ids))
        for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            forest.join(a, b)
        root = np.array([forest.find(i) for i in range(len(ids))], np.int64) if len(ids) else np.zeros(0, np.int64)
        keep = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]])], ["u", "v"])


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest id reachable from every id that has an edge: (id long, component_id long).

    ``edges`` has two long columns. Alternating large-star and small-star rounds on DataFrames, each cut
    with a checkpoint, until a round changes nothing; a chunk-wise contraction first keeps hubs small.
    Nothing but the two check sums of a round comes to the driver. Empty edges give an empty result.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    # u > v always holds from here on
    e = e.mapInArrow(released(_contract), "u long, v long")
    e = cut(e.where("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
