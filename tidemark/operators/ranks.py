"""Ranks and running totals over one global order, without putting the order into one task.

Cut points from an approximate quantile split the values into ranges; totals of the ranges (at most ``RANGES`` rows)
are run up once and added to the running totals inside each range. A value always falls into one range whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128


def running_below(cells: DataFrame, order: str, values: list[str], descending: bool = False) -> DataFrame:
    """``<value>_below`` beside each row: the sum of a value over the rows before it. ``order`` has no ties."""
    cuts = cells.agg(F.percentile_approx(order, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10_000).alias("__cuts"))
    spot = F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    rows = cells.crossJoin(F.broadcast(cuts)).withColumn("__range", -spot if descending else spot).drop("__cuts")
    totals = rows.groupBy("__range").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    over = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__{v}").over(over), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy("__range").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    ran = rows.withColumns({f"{v}_below": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = ran.join(F.broadcast(starts), "__range")
    return joined.withColumns({f"{v}_below": F.col(f"{v}_below") + F.col(f"__{v}") for v in values}).drop("__range", *[f"__{v}" for v in values])


def average_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Rank from 1; equal values share the mean of theirs."""
    cells = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    ranked = running_below(cells, column, ["__n"]).select(column, (F.col("__n_below") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranked, column, "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; null where one side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_rank(average_rank(both, x, "__rx"), y, "__ry")
    varied = (F.stddev_pop("__rx") > 0) & (F.stddev_pop("__ry") > 0)
    return ranked.agg(F.count("*").alias("n"), F.when(varied, F.corr("__rx", "__ry")).alias("spearman"))


def score_cells(df: DataFrame) -> DataFrame:
    return df.groupBy("p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the curve with half credit for ties, from one row for each score."""
    cells = running_below(score_cells(df), "p", ["neg"])
    return cells.agg((F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Precision at each score, weighted by the positives found there."""
    cells = running_below(score_cells(df), "p", ["pos", "neg"], descending=True)
    hits: Column = F.col("pos_below") + F.col("pos")
    precision = hits / (hits + F.col("neg_below") + F.col("neg"))
    return cells.agg((F.sum(F.col("pos") * precision) / F.sum("pos")).alias("average_precision"))


def medians(rows: DataFrame, key: str, value: str, width: float = 0.005) -> DataFrame:
    """Exact median of each key (``__key``, median), for few keys with many values.

    Approximate quantiles ``width`` below and above the middle, whose ranks are right to a ten-thousandth, bound where it
    lies; only distinct values in between are put in order, all below are one count.
    """
    seen = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.col(value).alias("__x"))
    bounds = seen.groupBy("__key").agg(F.percentile_approx("__x", [0.5 - width, 0.5 + width], 10_000).alias("__q"), F.count("*").alias("__n"))
    near = bounds.select(F.col("__key").alias("__of"), F.col("__q")[0].alias("__low"), F.col("__q")[1].alias("__high"), "__n")
    # one row a key
    held = seen.join(F.broadcast(near), F.col("__key").eqNullSafe(F.col("__of"))).where("__x <= __high")
    cells = held.groupBy("__key", F.when(F.col("__x") >= F.col("__low"), F.col("__x")).alias("__x")).agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    placed = cells.withColumn("__upto", F.sum("__c").over(Window.partitionBy("__key").orderBy(F.asc_nulls_first("__x"))))
    middle = [F.min(F.when(F.col("__upto") >= rank, F.struct(F.col("__upto"), F.col("__x").alias("x"))))["x"] for rank in (F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1)]
    return placed.groupBy("__key").agg(((middle[0] + middle[1]) / 2).alias("median"))
