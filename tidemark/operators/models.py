"""Models over tables whose fit is one aggregate: a small matrix comes to the driver, rows never do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ridge(df: DataFrame, features: list[str], target: str, penalty: float, weight: str | None = None) -> dict[str, float]:
    """Coefficients of standardised features (deviations held to 5) and the intercept; p * p sums are all that is collected."""
    w = F.col(weight) if weight else F.lit(1.0)
    total = F.sum(w)
    moments = df.agg(*[(F.sum(w * F.col(c)) / total).alias(f"m_{c}") for c in features], *[(F.sum(w * F.col(c) ** 2) / total).alias(f"q_{c}") for c in features], (F.sum(w * F.col(target)) / total).alias("m"), total.alias("w")).first()
    if moments is None or not moments["w"]:
        return dict.fromkeys([*features, "intercept"], 0.0)
    spread = {c: max(moments[f"q_{c}"] - moments[f"m_{c}"] ** 2, 0.0) ** 0.5 or 1.0 for c in features}
    z = {c: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(c) - moments[f"m_{c}"]) / spread[c])) for c in features}
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = df.agg(*[F.sum(w * z[features[i]] * z[features[j]]) for i, j in pairs], *[F.sum(w * z[c] * (F.col(target) - moments["m"])) for c in features]).first()
    gram = np.zeros((len(features), len(features)))
    for (i, j), v in zip(pairs, sums[: len(pairs)], strict=True):
        gram[i, j] = gram[j, i] = v
    beta = np.linalg.solve(gram + penalty * np.eye(len(features)), np.array(sums[len(pairs) :], float))
    return dict(zip(features, map(float, beta), strict=True)) | {"intercept": float(moments["m"])}


def stress_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """The upper tercile of each descriptor over training rows, as one row."""
    return df.agg(*[F.percentile(c, 2 / 3).alias(f"cut_{c}") for c in columns])


def stress_state(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """How many descriptors lie above their tercile, at most 2; 2 where one is missing. ``bounds`` is one row."""
    severe = sum((F.when(F.col(c) > F.col(f"cut_{c}"), 1).otherwise(0) for c in columns), F.lit(0))
    missing = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
    return df.crossJoin(F.broadcast(bounds)).withColumn("state", F.when(missing, 2).otherwise(F.least(severe, F.lit(2)))).drop(*[f"cut_{c}" for c in columns])


def level_changes(levels: DataFrame) -> DataFrame:
    """Quantity added to and removed from each (symbol, side, price) level by each update, with its quote value."""
    w = Window.partitionBy("symbol", "side", "price").orderBy("update_id")
    delta = F.col("qty") - F.coalesce(F.lag("qty").over(w), F.lit(0.0))
    rows = levels.withColumn("__d", delta)
    added, removed = F.greatest("__d", F.lit(0.0)), F.greatest(-F.col("__d"), F.lit(0.0))
    return rows.select("symbol", "side", "price", "update_id", added.alias("added"), removed.alias("removed"), (added * F.col("price")).alias("added_quote"), (removed * F.col("price")).alias("removed_quote"))
