"""Outcomes against loops: blocks change nothing, overlapping labels, falls across parts, one position at a time, odd and empty rows."""

import math
import random

from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
PATH = "symbol string, t long, min_bid double, max_bid double, close_bid double, min_ask double, max_ask double, close_ask double"
ACTIONS = "id long, symbol string, t long, side int, entry double, stop double, take double, entry_cost double, exit_cost double"


def walks(n, seed):
    rng, at, rows = random.Random(seed), 100.0, []
    for i in range(n):
        at += rng.gauss(0, 0.04)
        if rng.random() < 0.97:
            rows.append(("a", i * 100, at - 0.1, at + 0.1, at + rng.uniform(-0.1, 0.1), at + 0.02, at + 0.22, at + 0.12))
    return rows


def test_path_payoff_in_blocks_equals_a_loop(spark):
    from tidemark.operators.outcomes import path_payoff

    path, rng = walks(1500, 3), random.Random(4)
    acts = [(i, "a", rng.randrange(0, 130_000), rng.choice((1, -1)), 100.0 + rng.gauss(0, 0.5), float(rng.randrange(18, 80)), 0.0, 1.0, 4.0) for i in range(150)]
    acts = [(*a[:6], a[5] * 1.5, *a[7:]) for a in acts] + [(900, None, 5, 1, 100.0, 20.0, 30.0, 1.0, 4.0), (901, "a", DAY - 1000, 1, 100.0, 20.0, 30.0, 1.0, 4.0), (902, "b", 5, 1, 100.0, 20.0, 30.0, 1.0, 4.0)]
    step, life, guard, age = 100, 20_000, 700, 400

    def want(a, check, adverse):
        _, symbol, t, side, entry, stop, take, c_in, c_out = a
        seen = lambda at: next((p for p in reversed(path) if symbol == "a" and p[1] + step <= at), None)
        known = all((p := seen(t + o)) and t + o - p[1] - step <= age for o in (guard, life, 5000))
        if not known or t + life > (t // DAY + 1) * DAY:
            return None
        low, high = entry * (1 - side * stop / 10_000), entry * (1 + side * take / 10_000)
        out, price, end = "horizon", seen(t + life)[4 if side == 1 else 7], t + life
        for _, at, lb, hb, cb, la, ha, ca in path:
            start = -(-t // step) * step if check else t + guard
            if not start <= at <= t + life - step:
                continue
            bad = lb <= low if side == 1 else ha >= low
            good = at >= t + guard and (hb >= high if side == 1 else la <= high)
            if bad or good:
                worst, last = (lb, cb) if side == 1 else (ha, ca)
                if at < t + guard:
                    out, price = "gap_stop", worst
                else:
                    out = "ambiguous_stop" if bad and good else "stop" if bad else "take"
                    price = (min if side == 1 else max)(low if bad else high, worst if adverse else last)
                end = at + step
                break
        return out, end, side * (price / entry - 1) * 10_000 - c_in - c_out * price / entry

    p, a = spark.createDataFrame(path, PATH), spark.createDataFrame(acts, ACTIONS)
    kinds = set()
    for check, adverse, block in ((True, True, 1000), (False, False, 300), (True, False, 1_000_000)):
        got = {r["id"]: r for r in path_payoff(a, p, step, life, guard, age, {"five": 5000}, check, adverse, block).collect()}
        assert set(got) == {x[0] for x in acts} - {900}
        for act in acts:
            w, r = want(act, check, adverse), got.get(act[0])
            if act[0] == 900:
                continue
            assert r["valid"] == (w is not None) and (w is None) == (r["outcome"] is None), act
            if w:
                kinds.add(w[0])
                assert (r["outcome"], r["exit_t"]) == w[:2] and math.isclose(r["net"], w[2], abs_tol=1e-6), (act, w, r)
    assert {"horizon", "gap_stop", "stop", "take"} <= kinds
    assert path_payoff(a.limit(0), p, step, life, guard, age, {"five": 5000}, True, True).count() == 0


def test_uniqueness_of_overlapping_labels(spark):
    from tidemark.operators.outcomes import average_uniqueness

    rng = random.Random(5)
    times = sorted(rng.sample(range(0, 3 * DAY, 60_000), 300))
    picked = sorted(rng.sample(times[:-1], 120))
    ends = {t: t + rng.choice((1000, HOUR, 9 * HOUR)) for t in picked}
    last = {t: max(u for u in times if u <= e) for t, e in ends.items()}
    openly = {u: sum(t <= u <= last[t] for t in picked) for u in times}
    raw = {t: sum(1 / openly[u] for u in times if t <= u <= last[t]) / sum(t <= u <= last[t] for u in times) for t in picked}
    mean = sum(raw.values()) / len(raw)
    d = spark.createDataFrame([("a", t) for t in times] + [("b", 5)], "symbol string, t long")
    got = average_uniqueness(d, spark.createDataFrame([("a", t, e) for t, e in ends.items()], "symbol string, t long, e long"), "e").collect()
    assert len(got) == len(picked) and all(math.isclose(r["uniqueness"], raw[r["t"]] / mean, rel_tol=1e-9) for r in got)


def test_stress_examples_stay_in_their_segment(spark):
    from tidemark.operators.outcomes import depth_stress_examples

    base = 1_704_067_200_000  # the first of a month
    rows = [("a", base - 600_000 + i * 30_000, float(i)) for i in range(60) if not 30 <= i < 34] + [("a", base, -9.0), (None, base, 1.0), ("a", None, 1.0), ("b", base, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, t long, v double")
    got = {r["anchor"]: r for r in depth_stress_examples(df, ["v"], 60_000, {"l60": 60_000}, 45_000, 90_000).collect()}
    best = {t: max(v for s, u, v in rows if s == "a" and u == t) for s, t, _ in rows if s == "a" and t is not None}
    cut = [base, base - 600_000 + 34 * 30_000]  # a month begins, a pause of 150 seconds ends

    def part(t):
        return sum(t >= c for c in cut)

    def want():
        for anchor in range(base - 600_000, base + 1_300_000, 60_000):
            at = lambda x: max((t for t in best if t <= x), default=None)
            pre, lag, post = at(anchor), at(anchor - 60_000), min((t for t in best if t >= anchor + 60_000), default=None)
            before = at(pre - 1) if pre is not None else None
            if None in (pre, lag, post, before):
                continue
            ends = max(t for t in best if part(t) == part(pre))
            ages = (anchor - pre, anchor - 60_000 - lag, post - anchor - 60_000)
            if max(ages) <= 45_000 and len({part(t) for t in (pre, lag, post, before)}) == 1 and anchor + 60_000 <= ends:
                yield anchor, (best[pre], best[pre] - best[before], best[pre] - best[lag], best[post])

    told = dict(want())
    assert told and {k: (r["v"], r["v_change"], r["v_l60"], r["post_v"]) for k, r in got.items()} == told
    assert depth_stress_examples(df.limit(0), ["v"], 60_000, {"l60": 60_000}, 45_000, 90_000).count() == 0


def test_falls_across_parts(spark):
    from tidemark.operators.signalgrid import peak_loss

    rng = random.Random(6)
    rows = [(k, t // 50, t, rng.gauss(-0.01 if k == "x" else 0.05, 1.0)) for k in ("x", "y") for t in rng.sample(range(2000), 400)] + [("up", 0, 1, 1.0), ("up", 1, 60, 2.0), ("down", 0, 1, -3.0)]
    got = {r["k"]: r["drawdown"] for r in peak_loss(spark.createDataFrame(rows, "k string, part long, t long, v double"), ["k"], "part", "v").collect()}
    for key in ("x", "y", "up", "down"):
        total = peak = fall = 0.0
        for _, _, _, v in sorted(r for r in rows if r[0] == key):
            total += v
            peak = max(peak, total)
            fall = max(fall, peak - total)
        assert math.isclose(got[key], fall, abs_tol=1e-9), key


def test_grid_keeps_one_position(spark):
    from tidemark.operators.signalgrid import grid_trades, signal_grid_replay

    rng = random.Random(7)
    rows = [("a", m, m * 1000 + t, rng.uniform(-5, 5), 100, "momentum", 10, 20, m * 1000 + t + rng.randrange(5, 90) if rng.random() < 0.6 else None, 1.0, 0.1) for m in range(5) for t in rng.sample(range(900), 60)]
    schema = "symbol string, market long, t long, score double, lookback long, mode string, delay long, hold long, until long, gross double, fees double"
    got = sorted((r["threshold"], r["t"]) for r in grid_trades(spark.createDataFrame(rows, schema), [1.0, 3.0]).collect())
    want = []
    for bar in (1.0, 3.0):
        busy = -1
        for r in sorted(rows, key=lambda r: r[2]):
            if abs(r[3]) >= bar and r[2] >= busy:
                want.append((bar, r[2]))
                busy = busy if r[8] is None else r[8]
    assert got == sorted(want)
    points = spark.createDataFrame([("a", 1, 1, 5.0), (None, 2, 2, 5.0), ("a", None, 3, 5.0)], "symbol string, t long, id long, price double")
    markets = spark.createDataFrame([("a", 0, 0, 100, "u", "d")], "symbol string, market long, start long, end long, up string, down string")
    books = spark.createDataFrame([], "token string, t long, id long, segment long, bid double, ask double, bid_qty double, ask_qty double")
    empty = signal_grid_replay(points, points, markets, books, [10], [1.0], [5], [5], 1.0, 0.02, 1, 100, 100, 1)
    assert empty.select(F.count("*")).first()[0] == 0
