"""Joins of intervals that overlap, by bins of time in levels of length.

An interval belongs to the level whose bins are about as long as itself, so it lies in two bins or three of that level.
Two intervals meet in the bins of the longer one's level, and there in the first bin that both lie in, so each pair is
found once: an equi-join on (level, bin), whether an interval lasts a millisecond or for ever. Levels grow by a factor of
8; an interval enters the levels above its own only where the other side has intervals at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: End of an interval that is still open.
OPEN = 1 << 60
STEP = 3


def _levelled(df: DataFrame, start: str, end: str) -> DataFrame:
    """Valid intervals with their level; a null end is open, a null start or an end before the start is no interval."""
    shut = F.coalesce(F.col(end), F.lit(OPEN))
    rows = df.withColumn("__from", F.col(start).cast("long")).withColumn("__to", shut.cast("long")).where(F.col("__from") <= F.col("__to"))
    length = F.col("__to") - F.col("__from") + 1
    return rows.withColumn("__own", (F.ceil(F.log2(length.cast("double")) / STEP) * STEP).cast("int"))


def _levels(df: DataFrame) -> DataFrame:
    """One row: the levels that a side has, at most 21."""
    return df.agg(F.collect_set("__own").alias("__there"))


def _binned(df: DataFrame, levels: DataFrame) -> DataFrame:
    above = F.filter("__there", lambda x: x > F.col("__own"))
    rows = df.join(F.broadcast(levels), F.lit(True)).withColumn("__level", F.explode(F.array_distinct(F.concat(F.array("__own"), above)))).drop("__there")
    rows = rows.withColumn("__first", F.expr("shiftright(__from, __level)"))
    return rows.withColumn("__bin", F.explode(F.sequence("__first", F.expr("shiftright(__to, __level)"))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal ``on`` whose closed spans [start, end] share a time; a null end is open.

    Other columns of the two sides must differ in name. Rows without a key or a start pair with nothing.
    """
    a, b = _levelled(left, *left_span), _levelled(right, *right_span)
    names = ["__from", "__to", "__own", "__first"]
    x, y = _binned(a, _levels(b)), _binned(b, _levels(a)).withColumnsRenamed({n: f"{n}2" for n in names})
    met = x.join(y, [*on, "__level", "__bin"])
    once = (F.col("__level") == F.greatest("__own", "__own2")) & (F.col("__bin") == F.greatest("__first", "__first2"))
    shared: Column = (F.col("__from") <= F.col("__to2")) & (F.col("__from2") <= F.col("__to"))
    return met.where(once & shared).select(*left.columns, *[c for c in right.columns if c not in on])


def contained_join(intervals: DataFrame, points: DataFrame, on: list[str], span: tuple[str, str], t: str) -> DataFrame:
    """Each interval with every point in [start, end] of equal ``on``."""
    return overlap_join(intervals, points, on, span, (t, t))
