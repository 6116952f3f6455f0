"""Calibrated probabilities with a band: isotonic fits of binned outcomes, redrawn by whole conditions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.regimes import cut
from tidemark.operators.resampling import digest

#: Blocks whose means differ by less than this are in order; fitted values keep this far from 0 and 1.
EVEN, EDGE = 1e-12, 1e-6


def pooled(weights: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Isotonic probabilities on the grid of bin middles: adjacent violators are pooled over bins with weight, and the grid
    reads between the middles of the pools; all null where no bin has weight."""
    bins = len(weights)
    grid = (np.arange(bins) + 0.5) / bins
    pools: list[list[float]] = []
    for i in np.flatnonzero(weights > 0):
        pools.append([i, i, weights[i], positives[i]])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] > pools[-1][3] / pools[-1][2] + EVEN:
            _, end, w, p = pools.pop()
            pools[-1] = [pools[-1][0], end, pools[-1][2] + w, pools[-1][3] + p]
    if not pools:
        return np.full(bins, np.nan)
    middles = [(grid[int(a)] + grid[int(z)]) / 2 for a, z, _, _ in pools]
    return np.clip(np.interp(grid, middles, [p / w for _, _, w, p in pools]), EDGE, 1 - EDGE)


def _fit(weights: Column, positives: Column) -> Column:
    @F.arrow_udf("array<double>")
    def fitted(ws: pa.Array, ps: pa.Array) -> pa.Array:
        rows = [pooled(np.array(w.as_py()), np.array(p.as_py())) for w, p in zip(ws, ps, strict=True)]
        return pa.array([None if np.isnan(r).any() else r.tolist() for r in rows], pa.list_(pa.float64()))

    return fitted(weights, positives)


def bin_of(p: Column, bins: int) -> Column:
    """Bin of a probability, from 0; the last one is closed."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(p * bins))).cast("int")


def condition_bins(df: DataFrame, condition: str, p: str, y: str, bins: int) -> DataFrame:
    """(condition, bin, weight, positive): each condition weighs 1 in all, its rows alike; counted by bin before conditions meet.

    Rows with a null condition, probability or outcome, and NaN probabilities, take no part.
    """
    good = df.where(F.col(condition).isNotNull() & F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    cells = good.groupBy(F.col(condition).alias("condition"), bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("__n"), F.sum(F.col(y).cast("double")).alias("__y"))
    size = cells.groupBy("condition").agg(F.sum("__n").alias("__of"))
    return cells.join(size, "condition").select("condition", "bin", (F.col("__n") / F.col("__of")).alias("weight"), (F.col("__y") / F.col("__of")).alias("positive"))


def _spread_out(rows: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Weights and positives of each group as arrays over all bins, and the fit to them."""
    cells = rows.groupBy(*by, "bin").agg(F.sum("weight").alias("w"), F.sum("positive").alias("p"))
    held = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("w", "p")))).alias("__m"))  # at most one entry a bin

    def over_bins(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("__m", i)[name], F.lit(0.0))).alias(name)

    return held.select(*by, over_bins("w"), over_bins("p")).withColumn("fit", _fit(F.col("w"), F.col("p")))


def numbered(cells: DataFrame) -> DataFrame:
    """The conditions with a place each, from 0, and how many there are. Places follow hashes, counted by ranges of them, so no
    task numbers all."""
    ids = cells.select("condition").distinct().withColumn("__h", F.xxhash64("condition")).withColumn("__range", F.shiftright("__h", 54))
    counts = ids.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))  # at most 1,024 rows
    total = counts.agg(F.sum("__n").alias("conditions"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__h", "condition")) - 1
    ranked = ids.withColumn("__at", place).join(F.broadcast(starts), "__range").select("condition", (F.col("__from") + F.col("__at")).alias("place"))
    return ranked.join(F.broadcast(total), F.lit(True))


def multinomial_draws(places: DataFrame, replicates: int) -> DataFrame:
    """(rep, place, times): as many draws as there are conditions, in each replicate, with replacement.

    A draw is the digest of (replicate, draw), so draws are made where the conditions lie and counted before they move.
    """
    drawn = places.select("place", "conditions", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    return drawn.select("rep", (digest(F.col("rep"), F.col("place")) % F.col("conditions")).alias("place")).groupBy("rep", "place").agg(F.count("*").alias("times"))


def fit_envelope(df: DataFrame, condition: str, p: str, y: str, bins: int = 50, replicates: int = 500, low: float = 0.05, high: float = 0.95, order: str | None = None) -> DataFrame:
    """(bin, middle, calibrated, lower, upper, support): the isotonic fit of each bin, quantiles of the fits to redrawn
    conditions (held to either side of it), and how many conditions have rows in the bin.

    ``order`` names a whole-number column that places the conditions from 0; without it they are placed by hash.
    Replicates are rows: each is fitted by itself, from at most one number a bin.
    """
    cells = cut(condition_bins(df, condition, p, y, bins))
    if order is None:
        places = cut(numbered(cells))
    else:
        told = df.groupBy(F.col(condition).alias("condition")).agg(F.min(order).cast("long").alias("place"))
        places = told.join(F.broadcast(cells.agg(F.count_distinct("condition").alias("conditions"))), F.lit(True))
    redrawn = multinomial_draws(places, replicates).join(places.select("condition", "place"), "place").join(cells, "condition")
    sums = redrawn.select("rep", "bin", (F.col("times") * F.col("weight")).alias("weight"), (F.col("times") * F.col("positive")).alias("positive"))
    fits = _spread_out(sums, ["rep"], bins).select(F.posexplode("fit").alias("bin", "value"))
    band = fits.groupBy("bin").agg(F.percentile("value", low).alias("__low"), F.percentile("value", high).alias("__high"))
    point = _spread_out(cells.withColumn("__all", F.lit(0)), ["__all"], bins).select(F.posexplode("fit").alias("bin", "calibrated"))
    support = cells.groupBy("bin").agg(F.count("*").alias("support"))
    out = point.join(band, "bin").join(support, "bin", "left").fillna(0, ["support"])
    return out.select("bin", ((F.col("bin") + 0.5) / bins).alias("middle"), "calibrated", F.least("__low", "calibrated").alias("lower"), F.greatest("__high", "calibrated").alias("upper"), "support")


def apply_envelope(df: DataFrame, envelope: DataFrame, p: str, bins: int = 50, least: int = 30) -> DataFrame:
    """Adds calibrated, lower and upper probability by lookup, null (and ``abstains``) where a bin has too few conditions.

    The envelope has one row a bin, so it is broadcast.
    """
    table = F.broadcast(envelope.where(F.col("support") >= least).select(F.col("bin").alias("__bin"), "calibrated", "lower", "upper"))
    got = df.withColumn("__at", bin_of(F.col(p), bins)).join(table, F.col("__at") == F.col("__bin"), "left")
    return got.drop("__at", "__bin").withColumn("abstains", F.col("calibrated").isNull())
