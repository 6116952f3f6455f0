"""Calibration of probabilities by a few aggregate passes, and scores of distributions over states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = 1e-6


def _logit(p):
    held = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(held / (1 - held))


def temperature_grid(df: DataFrame, low: float = 0.25, high: float = 4.0, steps: int = 64) -> DataFrame:
    """Log loss of each temperature of a geometric grid, in one pass that holds one sum for each."""
    grid = np.geomspace(low, high, steps + 1).tolist()
    z = _logit(F.col("p"))
    losses = [F.avg(F.log1p(F.exp(-F.abs(z / t))) + F.greatest(z / t, F.lit(0.0)) - F.col("y") * z / t) for t in grid]
    cells = F.array(*[F.struct(F.lit(t).alias("temperature"), v.alias("loss")) for t, v in zip(grid, losses, strict=True)])
    return df.agg(F.inline(cells))


def fit_temperature(df: DataFrame) -> DataFrame:
    """The best temperature of the grid, kept only where it beats 1."""
    grid = temperature_grid(df)
    best = grid.agg(F.min(F.struct("loss", "temperature")).alias("b"), F.min(F.when(F.abs(F.col("temperature") - 1) < 1e-9, F.col("loss"))).alias("before"))
    better = F.col("before") - F.col("b.loss") > 1e-12
    return best.select(F.when(better, F.col("b.temperature")).otherwise(1.0).alias("temperature"), better.alias("fitted"), "before", F.when(better, F.col("b.loss")).otherwise(F.col("before")).alias("after"))


def fit_slope(df: DataFrame, forecast: str, target: str) -> DataFrame:
    """Slope through the origin in [0, 4], kept only where it lowers the squared error."""
    f, y = F.col(forecast), F.col(target)
    s = df.agg(F.sum(f * y).alias("fy"), F.sum(f * f).alias("ff"), F.sum(y * y).alias("yy"), F.count("*").alias("n"))
    slope = F.when(F.col("ff") > 0, F.greatest(F.lit(0.0), F.least(F.lit(4.0), F.col("fy") / F.col("ff")))).otherwise(1.0)

    def error(b):
        return (F.col("yy") - 2 * b * F.col("fy") + b * b * F.col("ff")) / F.col("n")

    better = error(F.lit(1.0)) - error(slope) > 1e-12
    return s.select(F.when(better, slope).otherwise(1.0).alias("slope"), better.alias("fitted"), error(F.lit(1.0)).alias("before"), F.when(better, error(slope)).otherwise(error(F.lit(1.0))).alias("after"))


def platt_fit(df: DataFrame, rounds: int = 25) -> tuple[float, float]:
    """Weighted logistic slope and intercept, drawn to (1, 0); each round is one aggregate of five sums."""
    z = _logit(F.col("p"))
    rows = df.select(z.alias("z"), F.col("y").cast("double").alias("y"), F.col("weight").alias("w"))
    base = rows.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum("y").alias("ones")).first()
    if base is None or min(base["ones"] or 0, base["n"] - (base["ones"] or 0)) < 2:
        raise ValueError("both outcomes are needed, twice each")
    n, unit = base["n"], base["n"] / base["w"]
    pull = np.array([1e-3 * n, 1e-5 * n])
    rate = min(max(base["wy"] / base["w"], EDGE), 1 - EDGE)
    at = np.array([1.0, np.clip(np.log(rate / (1 - rate)) - base["wz"] / base["w"], -10, 10)])
    for _ in range(rounds):
        line = at[0] * F.col("z") + float(at[1])
        fit = 1 / (1 + F.exp(-line))
        left, bend = unit * F.col("w") * (fit - F.col("y")), unit * F.col("w") * F.greatest(fit * (1 - fit), F.lit(1e-8))
        s = rows.agg(F.sum(left * F.col("z")), F.sum(left), F.sum(bend * F.col("z") ** 2), F.sum(bend * F.col("z")), F.sum(bend)).first()
        slope = np.array([s[0], s[1]]) + pull * (at - [1.0, 0.0])
        step = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + np.diag(pull), slope)
        new = np.clip(at - step, [0.05, -10.0], [10.0, 10.0])
        done, at = np.max(np.abs(new - at)) < 1e-8, new
        if done:
            break
    return float(at[0]), float(at[1])


def platt_apply(df: DataFrame, slope: float, intercept: float) -> DataFrame:
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(slope * _logit(F.col("p")) + intercept))))


def multiclass_loss(df: DataFrame, classes: int, last: int) -> DataFrame:
    """Log, Brier and hit scores of ``p`` (an array over classes) for ``state``; the last class's own Brier score."""
    seen = F.element_at("p", F.col("state") + 1)
    brier = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x * x) - 2 * seen + 1
    top = F.array_position("p", F.array_max("p")) - 1
    return df.agg(
        F.count("*").alias("n"),
        F.avg(-F.log(F.greatest(seen, F.lit(1e-12)))).alias("log_loss"),
        F.avg(brier).alias("brier"),
        F.avg((F.element_at("p", last + 1) - (F.col("state") == last).cast("double")) ** 2).alias("last_brier"),
        F.avg((top == F.col("state")).cast("double")).alias("accuracy"),
    )


def survival_scores(df: DataFrame) -> DataFrame:
    """Scores of three conditional hazards against the bucket in which an order filled (0: never), beside the base rates."""
    h = [F.col(f"hazard_{i}") for i in (1, 2, 3)]
    p = [h[0], (1 - h[0]) * h[1], (1 - h[0]) * (1 - h[1]) * h[2]]
    p.append(1 - p[0] - p[1] - p[2])
    rows = df.select("bucket", *[v.alias(f"p{i}") for i, v in enumerate(p, 1)])
    base = df.agg(*[((F.count_if(F.col("bucket") == i % 4) + 1) / (F.count("*") + 4)).alias(f"b{i}") for i in (1, 2, 3, 4)])
    both = rows.crossJoin(F.broadcast(base))

    def log_loss(k: str):
        return F.avg(-F.log(F.greatest(F.lit(1e-12), F.element_at(F.array(*[F.col(f"{k}{i}") for i in (1, 2, 3, 4)]), F.when(F.col("bucket") == 0, 4).otherwise(F.col("bucket")).cast("int")))))

    def brier(k: str):
        reach, total = F.lit(0.0), F.lit(0.0)
        for i in (1, 2, 3):
            reach = reach + F.col(f"{k}{i}")
            total = total + (reach - F.col("bucket").between(1, i).cast("double")) ** 2
        return F.avg(total / 3)

    s = both.agg(F.count("*").alias("n"), log_loss("p").alias("log_loss"), log_loss("b").alias("base_log_loss"), brier("p").alias("brier"), brier("b").alias("base_brier"))
    return s.withColumns({"log_loss_skill": 1 - F.col("log_loss") / F.col("base_log_loss"), "brier_skill": 1 - F.col("brier") / F.col("base_brier")})
