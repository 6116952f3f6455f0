"""Linear models fitted by rounds of aggregates: sums of products come to the driver, a p x p system is solved, rows never move.

Rows with a null in a feature, target, weight or offset take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.regimes import cut

#: Deviations at which standardised features are held, by model: fixed values.
RIDGE_REACH, LOGISTIC_REACH = 5.0, 12.0


def _held(c: Column, mean: float, spread: float, reach: float) -> Column:
    return F.greatest(F.lit(-reach), F.least(F.lit(reach), (c - mean) / spread))


def _moments(rows: DataFrame, weight: Column, features: list[str], least: float) -> tuple[dict[str, float], dict[str, float]]:
    """Weighted mean and spread of each feature; spreads below ``least`` count as 1. Deviations are taken from the mean."""
    total = F.sum(weight)
    m = rows.agg(*[(F.sum(weight * F.col(c)) / total).alias(c) for c in features]).first()
    mean = {c: float(m[c] or 0.0) for c in features}
    v = rows.agg(*[(F.sum(weight * (F.col(c) - mean[c]) ** 2) / total).alias(c) for c in features]).first()
    return mean, {c: s if (s := max(float(v[c] or 0.0), 0.0) ** 0.5) >= least else 1.0 for c in features}


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(values: list[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(_pairs(p), values, strict=True):
        out[i, j] = out[j, i] = v
    return out


# --- penalty by leaving one condition out ---


def _restandardised(gram: np.ndarray, cross: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge coefficients on (1, z), from mean products of (1, z) and with the target; the penalty acts on z standardised anew."""
    mean = gram[0, 1:]
    spread = np.sqrt(np.maximum(np.diag(gram)[1:] - mean**2, 0.0))
    spread[spread < 1e-12] = 1.0
    to = np.zeros_like(gram)  # (1, (z - mean) / spread) = to @ (1, z)
    to[0, 0] = 1.0
    to[1:, 0], to[1:, 1:] = -mean / spread, np.diag(1 / spread)
    system = to @ gram @ to.T
    system[1:, 1:] += penalty * np.eye(len(mean))
    return to.T @ np.linalg.solve(system, to @ cross)


def condition_grams(df: DataFrame, features: list[str], target: str, condition: str) -> DataFrame:
    """Mean products of (1, z) with themselves and the target in each condition; one row a condition, counted before it moves.

    z are the features standardised over all rows, each condition weighing the same, and held to ``RIDGE_REACH``.
    """
    rows = df.dropna(subset=[*features, target, condition])
    sizes = rows.groupBy(condition).agg(*[F.avg(c).alias(c) for c in features], *[F.avg(F.col(c) ** 2).alias(f"{c}__2") for c in features])
    m = sizes.agg(*[F.avg(c).alias(c) for c in sizes.columns if c != condition]).first()
    z = [F.lit(1.0)]
    for c in features:
        mean, square = float(m[c] or 0.0), float(m[f"{c}__2"] or 0.0)
        spread = max(square - mean**2, 0.0) ** 0.5
        z.append(_held(F.col(c), mean, spread if spread >= 1e-12 else 1.0, RIDGE_REACH))
    y = F.col(target).cast("double")
    gram = [F.avg(z[i] * z[j]) for i, j in _pairs(len(z))]
    return rows.groupBy(F.col(condition).cast("string").alias("condition")).agg(F.array(*gram).alias("gram"), F.array(*[F.avg(v * y) for v in z]).alias("cross"), F.avg(y * y).alias("square"))


def condition_errors(grams: DataFrame, features: int, penalties: list[float]) -> DataFrame:
    """(condition, penalty, error): mean squared error in each condition of the ridge fitted to all others.

    The others' products are the total less the condition's own, so every fit is a p x p system in a task.
    """
    p = features + 1
    size = len(_pairs(p))
    sums = grams.agg(F.count("*").alias("n"), *[F.sum(F.get("gram", F.lit(i))).alias(f"g{i}") for i in range(size)], *[F.sum(F.get("cross", F.lit(i))).alias(f"c{i}") for i in range(p)]).first()
    n = sums["n"]
    all_gram, all_cross = _square([sums[f"g{i}"] or 0.0 for i in range(size)], p), np.array([sums[f"c{i}"] or 0.0 for i in range(p)])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"condition": [], "penalty": [], "error": []}
            for r in batch.to_pylist() if n > 1 else []:
                own, cross = _square(r["gram"], p), np.array(r["cross"])
                for k in penalties:
                    beta = _restandardised((all_gram - own) / (n - 1), (all_cross - cross) / (n - 1), k)
                    out["condition"].append(r["condition"])
                    out["penalty"].append(float(k))
                    out["error"].append(float(r["square"] - 2 * beta @ cross + beta @ own @ beta))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("condition", pa.string()), ("penalty", pa.float64()), ("error", pa.float64())]))

    return grams.mapInArrow(errors, "condition string, penalty double, error double")


def penalty_scores(df: DataFrame, features: list[str], target: str, condition: str, penalties: list[float]) -> DataFrame:
    """(penalty, score, chosen): the mean over conditions of the error when each is left out; ties go to the larger penalty.

    Fewer than two conditions give no rows.
    """
    grams = cut(condition_grams(df, features, target, condition))
    scores = condition_errors(grams, len(features), penalties).groupBy("penalty").agg(F.avg("error").alias("score"))
    best = scores.agg(F.min(F.struct("score", (-F.col("penalty")).alias("less"))).alias("__b"))  # one row
    return scores.join(F.broadcast(best), F.lit(True)).select("penalty", "score", (F.col("penalty") == -F.col("__b.less")).alias("chosen"))


# --- logistic with an offset ---


@dataclass(frozen=True)
class OffsetLogistic:
    """Standardisation, coefficients (the intercept first), the penalised mean loss, the largest gradient, rounds taken."""

    features: list[str]
    mean: dict[str, float]
    spread: dict[str, float]
    coefficients: list[float]
    loss: float
    gradient: float
    rounds: int

    def linear(self) -> Column:
        z = [_held(F.col(c).cast("double"), self.mean[c], self.spread[c], LOGISTIC_REACH) for c in self.features]
        return sum((b * v for b, v in zip(self.coefficients[1:], z, strict=True)), F.lit(self.coefficients[0]))

    def predict(self, df: DataFrame, offset: str | None = None, correction: float = 1.0, name: str = "fitted") -> DataFrame:
        """Adds the probability whose logit is the offset and ``correction`` times what the features say."""
        base = F.col(offset) if offset else F.lit(0.0)
        return df.withColumn(name, 1 / (1 + F.exp(-(base + correction * self.linear()))))


def fit_offset_logistic(df: DataFrame, features: list[str], target: str, penalty: float, offset: str | None = None, weight: str | None = None, rounds: int = 75) -> OffsetLogistic:
    """Logistic regression on top of a known logit, features standardised, squares of their coefficients penalised.

    Every round of Newton's method is one aggregate over the kept rows (loss, gradient and curvature at the present
    coefficients); a step that does not lower the loss is halved. Ends when no gradient exceeds 1e-10 or steps vanish.
    """
    base, w = F.col(offset).cast("double") if offset else F.lit(0.0), F.col(weight).cast("double") if weight else F.lit(1.0)
    named = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("__y"), base.alias("__o"), w.alias("__w")).dropna()
    mean, spread = _moments(named, F.col("__w"), features, 1e-6)
    z = [_held(F.col(c), mean[c], spread[c], LOGISTIC_REACH).alias(f"__z{i}") for i, c in enumerate(features)]
    kept = named.select(*z, "__y", "__o", "__w").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        p = len(features) + 1
        x = [F.lit(1.0), *[F.col(f"__z{i}") for i in range(p - 1)]]
        pull = np.r_[0.0, np.full(p - 1, penalty)]
        total = kept.agg(F.sum("__w")).first()[0]
        if not total:
            raise ValueError("no rows with weight")

        def look(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            line = sum((float(b) * v for b, v in zip(beta, x, strict=True)), F.col("__o"))
            rows = kept.withColumn("__l", line).withColumn("__p", 1 / (1 + F.exp(-F.col("__l"))))
            share = F.col("__w") / total
            loss = F.sum(share * (F.log1p(F.exp(-F.abs("__l"))) + F.greatest(F.col("__l"), F.lit(0.0)) - F.col("__y") * F.col("__l")))
            bend = share * F.greatest(F.col("__p") * (1 - F.col("__p")), F.lit(1e-7))
            sums = rows.agg(loss, *[F.sum(share * (F.col("__y") - F.col("__p")) * v) for v in x], *[F.sum(bend * x[i] * x[j]) for i, j in _pairs(p)]).first()
            return sums[0] + float(pull @ beta**2) / 2, np.array(sums[1 : p + 1]) - pull * beta, _square(list(sums[p + 1 :]), p) + np.diag(pull + 1e-10)

        beta = np.zeros(p)
        loss, slope, bend = look(beta)
        done = 1
        while done < rounds and np.abs(slope).max() > 1e-10:
            step = np.linalg.solve(bend, slope)
            while True:
                got = look(beta + step)
                done += 1
                if got[0] <= loss + 1e-14 or np.abs(step).max() < 1e-12 or done >= rounds:
                    break
                step = step / 2
            if got[0] > loss + 1e-14:
                break
            beta, (loss, slope, bend) = beta + step, got
        return OffsetLogistic(features, mean, spread, beta.tolist(), float(loss), float(np.abs(slope).max()), done)
    finally:
        kept.unpersist()


# --- quantile and mean heads ---


def quantile_head(df: DataFrame, features: list[str], target: str, quantile: float, weight: str | None = None, rounds: int = 120) -> dict[str, float]:
    """Coefficients of the linear function with the least pinball loss.

    The corner of the loss is rounded off over a width e (|r| becomes sqrt(r^2 + e^2)) and the smooth loss is brought down
    by Newton's method, one aggregate of loss, gradient and curvature a round; where a full step does not lower it, one more
    aggregate tells the losses of twelve shorter steps at once. The width falls from a third of the target's spread to a few
    hundred-thousandths of it. Features are standardised inside; coefficients are told in their own units.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("__y"), w.alias("__w")).dropna()
    mean, spread = _moments(rows, F.col("__w"), [*features, "__y"], 1e-12)
    z = [((F.col(c) - mean[c]) / spread[c]).alias(f"__z{i}") for i, c in enumerate(features)]
    kept = rows.select(*z, ((F.col("__y") - mean["__y"]) / spread["__y"]).alias("__y"), "__w").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        p = len(features) + 1
        x = [F.lit(1.0), *[F.col(f"__z{i}") for i in range(p - 1)]]
        total = kept.agg(F.sum("__w")).first()[0]
        if not total:
            raise ValueError("no rows with weight")

        def residual(beta: np.ndarray) -> Column:
            return F.col("__y") - sum((float(b) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))

        def loss(r: Column, eps: float) -> Column:
            return F.sum(F.col("__w") / total * ((quantile - 0.5) * r + 0.5 * F.sqrt(r * r + eps * eps)))

        def look(beta: np.ndarray, eps: float) -> tuple[float, np.ndarray, np.ndarray]:
            held = kept.withColumn("__r", residual(beta)).withColumn("__s", F.sqrt(F.col("__r") ** 2 + eps * eps))
            pull = F.col("__w") / total * ((quantile - 0.5) + 0.5 * F.col("__r") / F.col("__s"))
            bend = F.col("__w") / total * (0.5 * eps * eps) / F.col("__s") ** 3
            s = held.agg(loss(F.col("__r"), eps), *[F.sum(pull * v) for v in x], *[F.sum(bend * x[i] * x[j]) for i, j in _pairs(p)]).first()
            return s[0], np.array(s[1 : p + 1]), _square(list(s[p + 1 :]), p) + 1e-12 * np.eye(p)

        beta, eps = np.zeros(p), 0.3
        now = look(beta, eps)
        for _ in range(rounds):
            step = np.linalg.solve(now[2], now[1])
            then = look(beta + step, eps)
            if then[0] > now[0] - 1e-4 * step @ now[1]:
                shorter = [0.5**k for k in range(1, 13)]
                losses = kept.agg(*[loss(residual(beta + t * step), eps) for t in shorter]).first()
                best = int(np.argmin(losses))
                step = step * shorter[best] if losses[best] < now[0] else step * 0
                then = look(beta + step, eps)
            beta, now = beta + step, then
            if np.abs(step).max() < eps / 10:
                if eps < 3e-5:
                    break
                eps *= 0.15
                now = look(beta, eps)
        own = {c: float(b) * spread["__y"] / spread[c] for c, b in zip(features, beta[1:], strict=True)}
        return own | {"intercept": float(beta[0]) * spread["__y"] + mean["__y"] - sum(own[c] * mean[c] for c in features)}
    finally:
        kept.unpersist()


def linear(df: DataFrame, coefficients: dict[str, float], name: str) -> DataFrame:
    """Adds the value of a linear function."""
    return df.withColumn(name, sum((v * F.col(c) for c, v in coefficients.items() if c != "intercept"), F.lit(coefficients["intercept"])))


def quantile_scores(df: DataFrame, target: str, forecast: str, quantile: float) -> DataFrame:
    """Rows, share of targets at or below the forecast, and mean pinball loss, as one row."""
    r = F.col(target) - F.col(forecast)
    return df.agg(F.count(r).alias("n"), F.avg((r <= 1e-9).cast("double")).alias("coverage"), F.avg(F.greatest(quantile * r, (quantile - 1) * r)).alias("pinball"))
