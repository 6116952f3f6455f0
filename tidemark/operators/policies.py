"""A take, downsize or skip rule learned from closed trades: every threshold scored in one pass, then checked on later trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running_below
from tidemark.operators.regimes import cut

_SUMS = ("n", "wins", "ret", "pnl", "lost", "won")


def _one(df: DataFrame, row: DataFrame) -> DataFrame:
    """Rows beside a table of one row."""
    return df.join(F.broadcast(row), F.lit(True))


def _totals(prefix: str = "") -> list[Column]:
    values = {"n": F.lit(1), "wins": (F.col("pnl") > 0).cast("int"), "ret": F.col("ret"), "pnl": F.col("pnl"), "lost": F.greatest(-F.col("pnl"), F.lit(0.0)), "won": F.greatest(F.col("pnl"), F.lit(0.0))}
    return [F.coalesce(F.sum(v), F.lit(0)).alias(prefix + k) for k, v in values.items()]


def chronological_split(samples: DataFrame, least: int, fraction: float) -> DataFrame:
    """Samples (id, opened, closed, strength, ret, pnl) with ``part``: those opened from the start of the last ``fraction``
    on (at least ``least``) validate, those closed before it calibrate, the rest are purged.

    The start is the opening time at a place in order, found by running counts over ranges of times. Samples without a
    time, a finite strength or a result are left out.
    """
    good = samples.where("opened is not null and closed is not null and strength is not null and not isnan(strength) and abs(strength) < double('infinity') and ret is not null and pnl is not null")
    times = running_below(good.groupBy("opened").agg(F.count("*").alias("n")), "opened", ["n"])
    size = good.agg(F.count("*").alias("__all"))
    place = F.col("__all") - F.greatest(F.lit(least), F.floor(F.col("__all") * fraction))
    at = _one(times, size).where((F.col("n_below") <= place) & (place < F.col("n_below") + F.col("n"))).agg(F.first("opened").alias("validation_start"))
    part = F.when(F.col("opened") >= F.col("validation_start"), "validation").when(F.col("closed") < F.col("validation_start"), "calibration").otherwise("purged")
    return _one(good, at).withColumn("part", F.when(F.col("validation_start").isNull(), "purged").otherwise(part))


def threshold_table(calibration: DataFrame) -> DataFrame:
    """Each strength that occurs (alike to 12 places: the least of them) as a threshold, with what it keeps and skips.

    One row a strength comes out of a combined count; sums above each are totals less a running sum over value ranges.
    """
    cells = calibration.withColumn("strength", F.greatest("strength", F.lit(0.0))).groupBy(F.round("strength", 12).alias("__r")).agg(F.min("strength").alias("threshold"), *_totals())
    ran = _one(running_below(cells.drop("__r"), "threshold", list(_SUMS)), cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__{c}") for c in _SUMS]))
    kept = ran.select("threshold", *[(F.col(f"__{c}") - F.col(f"{c}_below")).alias(c) for c in _SUMS[:4]], F.col("lost_below").alias("avoided"), F.col("won_below").alias("missed"))
    return kept.withColumns({"precision": F.col("wins") / F.col("n"), "mean": F.col("ret") / F.col("n")})


def choose_threshold(table: DataFrame, least: int, precision: float) -> DataFrame:
    """One row: the threshold that keeps enough trades, right and profitable ones, and gains most over taking all."""
    good = table.where((F.col("n") >= least) & (F.col("precision") >= precision) & (F.col("mean") > 0) & (F.col("pnl") > 0))
    gain = F.round(F.col("pnl") + F.col("avoided") - F.col("missed"), 9)
    return good.agg(F.max_by(F.struct("threshold", "n", "precision", "mean", "pnl"), F.struct(gain, F.round("precision", 12), F.round("mean", 12), -F.col("n"), -F.col("threshold"))).alias("best"))


def take_skip_policy(samples: DataFrame, least: int, precision: float, fraction: float = 0.3) -> DataFrame:
    """One row: the thresholds with how they did when they were chosen and later, the status and the first reason against it.

    A policy is only ``trained`` if the later trades that it takes are enough, right often enough and profitable; it then
    halves trades from half the threshold on, if those are enough and profitable by themselves.
    """
    parts = cut(chronological_split(samples, least, fraction).select("part", "strength", "ret", "pnl", "validation_start"))
    best = choose_threshold(threshold_table(parts.where("part = 'calibration'")), least, precision)
    counts = parts.agg(F.count("*").alias("samples"), *[F.count_if(F.col("part") == p).alias(p) for p in ("calibration", "purged", "validation")], F.max(F.when(F.col("part") == "calibration", F.col("strength"))).alias("__top"), F.max("validation_start").alias("validation_start"))
    chosen = _one(counts, best).withColumn("take", F.col("best.threshold")).withColumn("floor", F.greatest(F.lit(0.0), F.col("take") * 0.5))
    later = _one(parts.where("part = 'validation'").select("strength", "ret", "pnl"), chosen.select("take", "floor"))
    group = F.when(F.col("take").isNull(), "skip").when(F.col("strength") >= F.col("take"), "take").when(F.col("strength") >= F.col("floor"), "down").otherwise("skip")
    by = later.withColumn("__g", group).groupBy("__g").agg(*_totals())
    told = by.agg(*[F.coalesce(F.max(F.when(F.col("__g") == g, F.col(c))), F.lit(0)).alias(f"{g}_{c}") for g in ("take", "down", "skip") for c in _SUMS])
    row = _one(chosen, told)

    def share(g: str, c: str) -> Column:
        return F.when(F.col(f"{g}_n") > 0, F.col(f"{g}_{c}") / F.col(f"{g}_n")).otherwise(0.0)

    few = (F.col("calibration") < least) | (F.col("validation") < least) | (F.col("samples") < 2 * least)
    reason = (
        F.when(few, "insufficient_chronological_split")
        .when(F.col("take").isNull(), "no_profitable_precision_threshold")
        .when(F.col("take_n") < least, "take_validation_samples_insufficient")
        .when(share("take", "wins") < precision, "take_validation_precision_below_target")
        .when(share("take", "ret") <= 0, "take_validation_expectancy_not_positive")
        .when(F.col("take_pnl") <= 0, "take_validation_pnl_not_positive")
    )
    row = row.withColumn("reason", reason)
    down = F.col("reason").isNull() & (F.col("down_n") >= least) & (share("down", "ret") > 0) & (F.col("down_pnl") > 0)
    row = row.withColumn("downsizes", down)
    skip = {c: F.col(f"skip_{c}") + F.when(F.col("downsizes"), 0).otherwise(F.col(f"down_{c}")) for c in ("n", "lost", "won")}
    return row.select(
        F.when(few, "insufficient").when(F.col("reason").isNull(), "trained").otherwise("observe_only").alias("status"), "reason", "samples", "calibration", "purged", "validation", "validation_start",
        F.col("take").alias("take_threshold"), F.when(F.col("downsizes"), F.col("floor")).otherwise(F.col("take")).alias("downsize_threshold"),
        F.col("best.n").alias("calibration_take"), F.col("best.precision").alias("calibration_precision"), F.col("best.mean").alias("calibration_mean"), F.col("best.pnl").alias("calibration_pnl"),
        F.col("take_n").cast("long").alias("take_count"), share("take", "wins").alias("take_precision"), share("take", "ret").alias("take_mean"), F.col("take_pnl").cast("double").alias("take_pnl"),
        F.when(F.col("downsizes"), F.col("down_n")).otherwise(0).cast("long").alias("downsize_count"), skip["n"].cast("long").alias("skip_count"),
        skip["lost"].cast("double").alias("skipped_loss_avoided"), skip["won"].cast("double").alias("skipped_profit_missed"),
    )
