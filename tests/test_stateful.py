"""Stateful streams against the same work in batch, and greedy, fitted and iterative operators against plain loops."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import calibration, orderbook, panels, regimes, replay, resampling
from tidemark.sources import views
from tidemark.streaming import stateful

SF = "/root/testdata/sf0.001"


def through(spark, parts, make, name, tmp_path):
    """The rows a stream puts out when the parts come one batch after the other."""
    where = str(tmp_path / name)
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(where)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / (name + "_at"))).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def halves(df, t):
    df = df.cache()
    cut = df.approxQuantile(t, [0.5], 0.0)[0]
    return [df.where(f"{t} <= {cut}"), df.where(f"{t} > {cut}")]


def test_decay_state_matches_batch(spark, tmp_path):
    trades = views.trades(spark, SF).select("symbol", "id", "t", "price", "qty", "buyer_is_maker")
    got = through(spark, halves(trades, "t"), lambda s: stateful.decay_state(s, 3_600_000, 7_200_000), "decay_out", tmp_path).collect()
    want = {r["id"]: r for r in orderbook.event_decay_state(trades, 3_600_000, 7_200_000).collect()}
    assert len(got) == len(want)
    assert all(math.isclose(r[c], want[r["id"]][c], rel_tol=1e-9, abs_tol=1e-6) for r in got for c in ("n", "notional", "signed"))


def test_book_matches_batch(spark, tmp_path):
    feed = orderbook.book_feed(views.books(spark, SF), 20, 17)
    got = {r["update_id"]: r for r in through(spark, halves(feed, "event_ms"), stateful.stream_book, "book_out", tmp_path).collect()}
    want = {r["update_id"]: r for r in orderbook.rebuild_book(feed).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(math.isclose(got[k][c], want[k][c]) for k in want for c in ("best_bid", "best_ask", "bid_depth", "ask_depth"))


def test_late_rows(spark, tmp_path):
    rows = [("a", 1, 1000, 1), ("a", 2, 2600, 2), ("a", 3, 1500, 3), ("a", 4, 2400, 4), ("b", 5, 10, 5)]
    later = [("a", 6, 1999, 6), ("a", 7, 9000, 7), ("b", 8, 5, 8)]
    schema = "symbol string, id long, t long, arrival long"
    got = through(spark, [spark.createDataFrame(rows, schema), spark.createDataFrame(later, schema)], lambda s: stateful.late_rows(s, 1000, 250), "late_out", tmp_path)
    assert {r["id"]: r["late"] for r in got.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}


def test_redundant_union_and_gaps(spark, tmp_path):
    schema = "message string, lane string, received long"
    one = spark.createDataFrame([("x", "a", 1000), ("y", "a", 1100), ("x", "b", 1500), ("z", "a", 1200)], schema)
    two = spark.createDataFrame([("y", "b", 1900), ("w", "a", 60_000)], schema)
    three = spark.createDataFrame([("w", "b", 60_500)], schema)
    got = through(spark, [one, two, three], lambda s: stateful.redundant_union(s, 2000), "union_out", tmp_path).collect()
    assert {(r["message"], r["received"], r["paired"], r["lane_gap"]) for r in got} == {("x", 1000, True, 500), ("y", 1100, True, 800), ("z", 1200, False, None), ("w", 60_000, True, 500)}
    schema = "symbol string, t long"
    parts = [spark.createDataFrame([("a", 1000), ("a", 1500), ("b", 1000)], schema), spark.createDataFrame([("a", 9000), ("b", 1800)], schema)]
    got = {tuple(r) for r in through(spark, parts, lambda s: stateful.feed_gaps(s, 2000), "gaps_out", tmp_path).collect()}
    assert ("a", 1500, 9000) in got and ("b", 1800, None) in got


def chain(rows, end):
    out, free = [], -1
    for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
        if r["t"] >= free:
            out.append(r["id"])
            free = r[end]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_and_spacing(spark, seed):
    draw = random.Random(seed)
    data = [(i, "ab"[i % 2], draw.randrange(0, 3 * replay.DAY_MS), 0) for i in range(400)]
    data = [(i, s, t, t + draw.randrange(1, 5_000_000)) for i, s, t, _ in data]
    df = spark.createDataFrame(data, "id long, symbol string, t long, end long")
    rows = df.collect()
    want = [i for s in "ab" for d in range(3) for i in chain([r for r in rows if r["symbol"] == s and r["t"] // replay.DAY_MS == d], "end")]
    assert sorted(r["id"] for r in replay.greedy(df, "end").collect()) == sorted(want)
    spaced = df.withColumn("end", df.t + 1_500_000)
    want = [i for s in "ab" for i in chain([r for r in spaced.collect() if r["symbol"] == s], "end")]
    assert sorted(r["id"] for r in panels.spaced_events(df, 1_500_000).collect()) == sorted(want)
    assert replay.greedy(df.limit(0), "end").count() == 0


def test_platt_reaches_the_minimum(spark):
    draw = np.random.default_rng(3)
    p = draw.uniform(0.02, 0.98, 800)
    y = (draw.uniform(size=800) < 1 / (1 + np.exp(-(0.6 * np.log(p / (1 - p)) - 0.4)))).astype(int)
    w = draw.integers(1, 4, 800).astype(float)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(p, y, w, strict=True)], "p double, y int, weight double")
    slope, intercept = calibration.platt_fit(df)
    z, u = np.log(p / (1 - p)), w * len(w) / w.sum()

    def loss(a, b):
        line = a * z + b
        return np.sum(u * (np.logaddexp(0, line) - y * line)) + 0.5 * 0.8 * (a - 1) ** 2 + 0.5 * 0.008 * b**2

    best = loss(slope, intercept)
    assert all(best <= loss(slope + da, intercept + db) + 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
    with pytest.raises(ValueError):
        calibration.platt_fit(df.where("y = 1"))


@pytest.mark.parametrize("cap", [0.1, 0.3, 0.45, 1.0])
def test_capped_weights(spark, cap):
    raw = {"a": 8.0, "b": 4.0, "c": 2.0, "d": 1.0, "e": 1.0}
    left, budget, want = dict(raw), min(1.0, cap * len(raw)), {}
    while left:
        share = {k: budget * v / sum(left.values()) for k, v in left.items()}
        over = [k for k, v in share.items() if v > cap + 1e-12]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = cap
            budget -= cap
            del left[k]
    got = {r["symbol"]: r["weight"] for r in panels.capped_weights(spark.createDataFrame(list(raw.items()), "symbol string, inverse double"), cap).collect()}
    assert all(math.isclose(got[k], want.get(k, 0.0), abs_tol=1e-9) for k in raw)


def test_clusters_and_binomial(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.1)], "symbol string, other string, corr double")
    symbols = spark.createDataFrame([(s,) for s in "abcde"], "symbol string")
    assert dict(map(tuple, regimes.correlation_clusters(pairs, symbols, 0.7).collect())) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    rows = resampling.binomial(spark.createDataFrame([("x", 12)], "g string, n long"), "g", "n", 0.3).collect()
    assert all(math.isclose(r["chance"], math.comb(12, r["k"]) * 0.3 ** r["k"] * 0.7 ** (12 - r["k"]), rel_tol=1e-9) for r in rows)
    big = resampling.binomial(spark.createDataFrame([("x", 1_000_000)], "g string, n long"), "g", "n", 0.5)
    assert math.isclose(big.where("k >= 500000").agg({"chance": "sum"}).first()[0], 0.5, abs_tol=1e-3)
