"""Fits, policies, envelopes and turnover against exact solutions and loops."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import envelope, fits, policies, turnover


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(7)
    n = 400
    x, z = r.normal(size=n), r.exponential(size=n)
    c = r.choice(["a", "b", "c", "d", "e"], n, p=[0.5, 0.2, 0.15, 0.1, 0.05])
    y = 1 + 2 * x - z + r.normal(size=n) + (c == "c")
    hit = (r.random(n) < 1 / (1 + np.exp(-(0.5 * x - 0.3 * z)))).astype(float)
    o = r.normal(size=n) / 2
    w = r.integers(1, 4, n).astype(float)
    rows = list(zip(x.tolist(), z.tolist(), c.tolist(), y.tolist(), hit.tolist(), o.tolist(), w.tolist(), strict=True))
    schema = "x double, z double, c string, y double, hit double, o double, w double"
    return (x, z, c, y, hit, o, w), spark.createDataFrame([*rows, (None, 1.0, "a", 1.0, 1.0, 0.0, 1.0), (1.0, 1.0, None, 1.0, None, 0.0, 1.0)], schema)


def test_left_out_conditions_equal_refits(points):
    (x, z, c, y, *_), df = points
    X = np.c_[x, z]
    own = {k: X[c == k] for k in set(c)}
    mean = np.mean([v.mean(axis=0) for v in own.values()], axis=0)
    spread = np.sqrt(np.mean([(v**2).mean(axis=0) for v in own.values()], axis=0) - mean**2)
    Z = np.clip((X - mean) / spread, -5, 5)

    def refit(keep, penalty):
        w = np.array([1 / (len(set(c[keep])) * (c[keep] == k).sum()) for k in c[keep]])
        A, t = Z[keep], y[keep]
        m = w @ A
        s = np.sqrt(w @ (A - m) ** 2)
        D = np.c_[np.ones(len(A)), (A - m) / s]
        b = np.linalg.solve((D * w[:, None]).T @ D + penalty * np.diag([0, 1, 1]), (D * w[:, None]).T @ t)
        return lambda B: np.c_[np.ones(len(B)), (B - m) / s] @ b

    want = {k: np.mean([np.mean((y[c == h] - refit(c != h, k)(Z[c == h])) ** 2) for h in set(c)]) for k in (0.01, 1.0, 5.0)}
    got = {r["penalty"]: (r["score"], r["chosen"]) for r in fits.penalty_scores(df, ["x", "z"], "y", "c", [0.01, 1.0, 5.0]).collect()}
    assert all(math.isclose(got[k][0], v, rel_tol=1e-9) for k, v in want.items())
    assert [k for k, v in got.items() if v[1]] == [min(want, key=lambda k: (want[k], -k))]
    assert fits.penalty_scores(df.where("c = 'a'"), ["x", "z"], "y", "c", [1.0]).count() == 0


def test_offset_logistic_reaches_the_minimum(points):
    (x, z, _, _, hit, o, w), df = points

    def newton(offset, weight, penalty):
        w = weight / weight.sum()
        X = np.c_[x, z]
        m = w @ X
        s = np.sqrt(w @ (X - m) ** 2)
        D = np.c_[np.ones(len(X)), np.clip((X - m) / s, -12, 12)]
        b, pull = np.zeros(3), np.array([0, penalty, penalty])
        for _ in range(60):
            p = 1 / (1 + np.exp(-(offset + D @ b)))
            b = b + np.linalg.solve((D * (w * p * (1 - p))[:, None]).T @ D + np.diag(pull), D.T @ (w * (hit - p)) - pull * b)
        return b, 1 / (1 + np.exp(-(offset + D @ b)))

    model = fits.fit_offset_logistic(df, ["x", "z"], "hit", 0.05, offset="o", weight="w")
    want, p = newton(o, w, 0.05)
    assert model.gradient < 1e-8 and model.rounds < 20 and np.allclose(model.coefficients, want, atol=1e-8)
    got = [r["fitted"] for r in model.predict(df.where("x is not null and hit is not null").orderBy("x"), "o").collect()]
    assert np.allclose(got, p[np.argsort(x)], atol=1e-8)
    from pyspark.sql import functions as F

    plain = fits.fit_offset_logistic(df, ["x", "z"], "hit", 0.05)
    zero = fits.fit_offset_logistic(df.withColumn("o", F.lit(0.0)), ["x", "z"], "hit", 0.05, offset="o")
    assert np.allclose(plain.coefficients, newton(0 * o, np.ones_like(w), 0.05)[0], atol=1e-8) and np.allclose(plain.coefficients, zero.coefficients)
    # both outcomes apart: the penalty keeps the coefficients finite, steps are halved where they overshoot
    apart = df.withColumn("hit", (F.col("x") > 0).cast("double"))
    assert fits.fit_offset_logistic(apart, ["x"], "hit", 1e-4).gradient < 1e-8


@pytest.mark.parametrize("quantile", [0.2, 0.9])
def test_quantile_head_is_the_linear_programme(spark, quantile):
    """The best line goes through two of the points, so all of those are tried."""
    r = np.random.default_rng(3)
    x = r.normal(size=45)
    y = 3 * x + r.standard_t(3, size=45) * 10 + 100
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)) + [(None, 1.0)], "x double, y double")
    loss = lambda a, b: float(np.mean(np.maximum(quantile * (y - a - b * x), (quantile - 1) * (y - a - b * x))))
    best = min(loss(y[i] - x[i] * (b := (y[j] - y[i]) / (x[j] - x[i])), b) for i, j in itertools.combinations(range(45), 2))
    k = fits.quantile_head(df, ["x"], "y", quantile)
    assert loss(k["intercept"], k["x"]) <= best * (1 + 1e-4)
    told = fits.quantile_scores(fits.linear(df, k, "low"), "y", "low", quantile).first()
    assert abs(told["coverage"] - quantile) <= 2 / 45 + 1e-9 and math.isclose(told["pinball"], loss(k["intercept"], k["x"]), rel_tol=1e-9)


@pytest.mark.parametrize("seed,precision", [(1, 0.5), (2, 0.55), (3, 0.99)])
def test_policy_is_the_best_threshold(spark, seed, precision):
    r = random.Random(seed)
    rows = [(i, i * 10 // 3, i * 10 // 3 + r.choice((1, 50, 200)), s := round(r.random(), 2), p := round(r.gauss(s - 0.4, 1), 3), p) for i in range(300)]
    rows += [(900, None, 5, 0.5, 1.0, 1.0), (901, 5, 9, math.nan, 1.0, 1.0), (902, 5, 9, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, opened long, closed long, strength double, ret double, pnl double")
    got = policies.take_skip_policy(df, 15, precision).first()
    good = sorted((x for x in rows[:300]), key=lambda x: x[1])
    start = good[300 - max(15, 90)][1]
    cal, val = [x for x in good if x[2] < start and x[1] < start], [x for x in good if x[1] >= start]
    best = None
    for t in sorted({x[3] for x in cal}):
        keep, skip = [x for x in cal if x[3] >= t], [x for x in cal if x[3] < t]
        net, right = sum(x[5] for x in keep), sum(x[5] > 0 for x in keep) / len(keep)
        if len(keep) >= 15 and right >= precision and net > 0:
            rank = (round(net - sum(x[5] for x in skip), 9), right, net / len(keep), -len(keep))
            best = max(best or (rank, t), (rank, t), key=lambda z: z[0])
    assert (got["calibration"], got["validation"], got["purged"], got["samples"]) == (len(cal), len(val), 300 - len(cal) - len(val), 300)
    if best is None:
        assert got["take_threshold"] is None and got["reason"] == "no_profitable_precision_threshold" and got["skip_count"] == len(val)
        return
    assert got["take_threshold"] == best[1]
    take = [x for x in val if x[3] >= best[1]]
    assert got["take_count"] == len(take) and math.isclose(got["take_pnl"], sum(x[5] for x in take), abs_tol=1e-9)
    ok = len(take) >= 15 and sum(x[5] > 0 for x in take) / len(take) >= precision and sum(x[5] for x in take) > 0
    assert (got["status"] == "trained") == ok


def test_policy_of_few_or_no_samples(spark):
    schema = "id int, opened long, closed long, strength double, ret double, pnl double"
    for rows in ([], [(1, 1, 2, 0.5, 1.0, 1.0)]):
        got = policies.take_skip_policy(spark.createDataFrame(rows, schema), 5, 0.5).first()
        assert got["status"] == "insufficient" and got["take_threshold"] is None


def played(rows, oldest, multiple):
    """The rule, step by step: (position, age, units, reason, held, net)."""
    pos = age = 0
    out = []
    for f, y, c, only in rows:
        want = int(f > 0) if only else (f > 0) - (f < 0)
        new, reason = pos, 0
        if pos and age >= oldest:
            new, reason = 0, 4
        elif want != pos and abs(f) > multiple * c * abs(want - pos):
            new, reason = want, 1 if pos == 0 else 2 if want == 0 else 3
        held = age if reason > 1 else None
        units = abs(new - pos)
        age = 0 if new == 0 else age + 1 if new == pos else 1
        pos = new
        out.append([pos, age, float(units), reason, held, pos * y - c * units])
    if pos:
        out[-1][2] += abs(pos)
        out[-1][5] -= rows[-1][2] * abs(pos)
        out[-1][4] = out[-1][4] if out[-1][4] is not None else age
    return out


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_turnover_equals_a_loop(spark, stretch):
    r = random.Random(stretch)
    rows = [(k, i, r.choice((r.gauss(0, 3), 0.0)), r.gauss(0, 1), 0.5 + 0.5 * (k == "b"), k == "c") for k in "abc" for i in range(120) if r.random() < 0.9]
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0, 1.0, True), ("a", None, 1.0, 1.0, 1.0, True)], "k string, t long, f double, y double, c double, only boolean").repartition(5)
    got = turnover.stateful_turnover(df, ["k"], "t", "f", "y", "c", "only", oldest=4, stretch=stretch)
    for k in "abc":
        mine = [x for x in rows if x[0] == k]
        want = played([x[2:] for x in mine], 4, 2.0)
        told = [[x["position"], x["age"], x["units"], x["reason"], x["held"], x["net"]] for x in sorted(got.where(f"k = '{k}'").collect(), key=lambda x: x["t"])]
        assert len(told) == len(want) and all(a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-9) for a, b in zip(told, want, strict=True))


def test_turnover_of_one_long_history_is_many_tasks(spark):
    df = spark.range(20_000).selectExpr("'s' AS k", "id AS t", "sin(id * id) * 5 AS f", "0.1D AS y", "1.0D AS c", "id % 2 = 0 AS only", "CASE WHEN id % 50 = 0 THEN NULL ELSE 1 END AS gap")
    out = turnover.stateful_turnover(df, ["k"], "t", "f", "y", "c", "only", oldest=24, stretch=256)
    told = turnover.turnover_metrics(out, ["k"]).first()
    rows = [(math.sin(i * i) * 5, 0.1, 1.0, i % 2 == 0) for i in range(20_000)]
    want = played(rows, 24, 2.0)
    assert told["rows"] == 20_000 and math.isclose(told["net"], sum(x[5] for x in want), rel_tol=1e-9) and told["reversals"] == sum(x[3] == 3 for x in want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.5, 1.0, 2.0]), st.sampled_from([0.0, 0.25, 0.5, 1.0])), min_size=1, max_size=9))
def test_pools_are_the_isotonic_fit(cells):
    """Against the largest mean before, smallest mean after formula, read between the middles of the finest pools."""
    w = np.array([a for a, _ in cells])
    p = np.array([a * b for a, b in cells])
    got = envelope.pooled(w, p)
    at = np.flatnonzero(w > 0)
    if not len(at):
        assert np.isnan(got).all()
        return
    mean = lambda i, j: p[at[i : j + 1]].sum() / w[at[i : j + 1]].sum()
    n = len(at)
    fit = [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    cuts = [i for i in range(n) if i == n - 1 or max(mean(j, i) for j in range(i + 1)) <= min(mean(i + 1, k) for k in range(i + 1, n)) + 1e-12]
    grid = (np.arange(len(w)) + 0.5) / len(w)
    firsts = [0, *[c + 1 for c in cuts[:-1]]]
    middles = [(grid[at[a]] + grid[at[z]]) / 2 for a, z in zip(firsts, cuts, strict=True)]
    assert np.allclose(got, np.clip(np.interp(grid, middles, [fit[z] for z in cuts]), 1e-6, 1 - 1e-6), atol=1e-9)


def test_envelope_draws_and_odd_rows(spark):
    r = random.Random(8)
    rows = [(f"c{i % 40}", r.random(), None) for i in range(2_000)]
    rows = [(c, p, int(r.random() < p)) for c, p, _ in rows] + [(None, 0.5, 1), ("c1", None, 1), ("c1", math.nan, 1), ("c1", 0.5, None), ("c2", 1.0, 1), ("c2", -0.5, 0)]
    df = spark.createDataFrame(rows, "c string, p double, y int")
    cells = envelope.condition_bins(df, "c", "p", "y", 10)
    weights = {x["condition"]: x["w"] for x in cells.groupBy("condition").agg({"weight": "sum"}).toDF("condition", "w").collect()}
    assert len(weights) == 40 and all(math.isclose(v, 1) for v in weights.values())
    places = envelope.numbered(cells)
    assert sorted(x["place"] for x in places.collect()) == list(range(40))
    draws = envelope.multinomial_draws(places, 30).groupBy("rep").agg({"times": "sum"}).toDF("rep", "n").collect()
    assert len(draws) == 30 and {x["n"] for x in draws} == {40}
    env = sorted(envelope.fit_envelope(df, "c", "p", "y", 10, 100).collect(), key=lambda x: x["bin"])
    assert len(env) == 10 and all(x["lower"] <= x["calibrated"] <= x["upper"] for x in env)
    assert all(a["calibrated"] <= b["calibrated"] + 1e-12 for a, b in zip(env, env[1:], strict=False))
    assert all(abs(x["calibrated"] - x["middle"]) < 0.15 for x in env)
    got = envelope.apply_envelope(df, spark.createDataFrame(env), "p", 10, 30).where("p = 1.0").first()
    assert got["calibrated"] == env[-1]["calibrated"] and not got["abstains"]
    none = envelope.apply_envelope(df, spark.createDataFrame(env), "p", 10, 41)
    assert none.where("abstains").count() == df.count()
