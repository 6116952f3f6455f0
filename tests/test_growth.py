"""Steps that must grow no faster than their input, against plain versions."""

import hashlib
import random
import statistics

from pyspark.sql import functions as F

from tidemark.operators import asof, evaluation, orderbook, outcomes, paths, ranks, resampling


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_placebo_broadcasts_no_replicates(spark, tmp_path):
    """A small file whose rows are repeated by every replicate: none of them goes through the driver."""
    rows = [(i, i % 7, (i * 37 % 101) / 100, i % 2) for i in range(700)]
    spark.createDataFrame(rows, "id long, day long, p double, y int").write.parquet(str(tmp_path / "p"))
    out = resampling.placebo_exceedance(spark.read.parquet(str(tmp_path / "p")), "day", "p", "y", 20)
    assert "BroadcastHashJoin" not in plan(out)
    gap = sum(p for _, _, p, y in rows if y == 1) / 350 - sum(p for _, _, p, y in rows if y == 0) / 350
    assert abs(out.collect()[0]["observed"] - gap) < 1e-9


def test_placebo_shuffles_no_replicates(spark):
    """What is shuffled are the rows of days and one sum a task and replicate; nulls in the day, the signal and the outcome."""
    rng = random.Random(8)
    rows = [(i * 3, rng.choice([1, 2, 3, None]), rng.choice([None, rng.random(), rng.random()]), rng.choice([0, 1, 1, None])) for i in range(300)]
    out = resampling.placebo_exceedance(spark.createDataFrame(rows, "id long, day long, p double, y int"), "day", "p", "y", 20)
    assert "MergeJoin" not in plan(out) and "Window" not in plan(out)
    gaps = []
    for rep in range(21):
        sums = {0: [], 1: []}
        for day in (1, 2, 3):
            own = sorted(r for r in rows if r[1] == day)
            mixed = sorted(own, key=lambda r: ("" if rep == 0 else hashlib.md5(f"{rep}|{r[0]}".encode()).hexdigest(), r[0]))
            for a, b in zip(own, mixed, strict=True):
                if a[3] is not None and b[2] is not None:
                    sums[a[3]].append(b[2])
        gaps.append(statistics.fmean(sums[1]) - statistics.fmean(sums[0]))
    got = out.collect()[0]
    assert abs(got["observed"] - gaps[0]) < 1e-9 and abs(got["p"] - (sum(g >= gaps[0] - 1e-9 for g in gaps[1:]) + 1) / 21) < 1e-9


def test_tail_losses_sum_days_once(spark):
    """The quantile and the losses from there on come from the same sums, not from sums run twice."""
    rows = [(s, d, random.Random(d * 9 + i).uniform(-9e5, 9e5)) for s in "ab" for d in range(40) for i in range(5)]
    out = evaluation.var_cvar(spark.createDataFrame(rows, "symbol string, exit long, pnl double"))
    assert "Join" not in plan(out)
    for r in out.collect():
        loss = sorted(-sum(p for s, d, p in rows if s == r["symbol"] and d == day) for day in range(40))
        assert abs(r["var"] - loss[37]) < 1e-6 and abs(r["cvar"] - sum(loss[37:]) / 3) < 1e-6


def test_window_aggregates_make_no_pairs(spark):
    """Windows open and closed at their ends, with equal times, rows without key or time and windows without rows."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(0, 400), float(rng.randrange(-50, 50))) for _ in range(300)] + [(None, 5, 1.0), ("a", None, 1.0)]
    asks = [(i, rng.choice("ab"), rng.randrange(-50, 500)) for i in range(80)] + [(80, "c", 10), (81, None, 10), (82, "a", None)]
    held, asked = spark.createDataFrame(rows, "symbol string, t long, v double"), spark.createDataFrame(asks, "id long, symbol string, t long")
    for end_closed in (True, False):
        aggs = {f"{h}_{closed}": (h, F.col("v"), closed) for h in ("sum", "count", "min", "max") for closed in (True, False)}
        out = asof.window_aggregates(asked, held, "t", 50, aggs, end_closed)
        assert "Join" not in plan(out)
        got = {r["id"]: r for r in out.collect()}
        assert len(got) == len(asks)
        for i, s, t in asks:
            for closed in (True, False):
                inside = [] if s is None or t is None else [v for k, u, v in rows if k == s and u is not None and (t - 50 < u or closed and u == t - 50) and (u < t or end_closed and u == t)]
                want = [sum(inside), len(inside), min(inside), max(inside)] if inside else [None, 0, None, None]
                assert [got[i][f"{h}_{closed}"] for h in ("sum", "count", "min", "max")] == want, (i, closed, end_closed)


def test_medians_hold_few_values(spark):
    """Exact medians of many values, of few, of equal ones and of a null key; no buffer holds all values of a key."""
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 5)) for _ in range(20_001)] + [("b", rng.gauss(0, 5)) for _ in range(20_000)] + [("c", 1.0), ("c", 2.0), ("d", 4.0)] + [("e", float(i % 3)) for i in range(9_000)] + [(None, 7.0), ("a", None)]
    out = ranks.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v")
    got = {r["__key"]: r["median"] for r in out.collect()}
    assert got == {k: statistics.median(v for s, v in rows if s == k and v is not None) for k in ("a", "b", "c", "d", "e", None)}
    trades = spark.createDataFrame([("a", 1, 1.0)], "symbol string, exit long, pnl double")
    whole = plan(evaluation.replay_metrics(trades))
    assert "median(" not in whole and "percentile(" not in whole


def test_books_are_rebuilt_as_a_stream(spark):
    """Books longer than a batch against a plain replay; no segment is one group."""
    level = "array<struct<price: double, qty: double>>"
    rng, rows = random.Random(8), []
    for i in range(300):
        change = lambda: [(float(p), float(rng.choice((0, 1, 2)))) for p in rng.sample(range(9), 3)]
        rows.append(("a", i, i, i - 1, i in (3, 150), change(), change()))
    feed = spark.createDataFrame(rows, f"symbol string, event_ms long, update_id long, previous_id long, snapshot boolean, bids {level}, asks {level}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = orderbook.rebuild_book(feed)
        assert "FlatMapGroupsInArrow" not in plan(out)
        got = {r["update_id"]: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, want = ({}, {}), {}
    for _, _, i, _, snapshot, *sides in rows[3:]:
        for state, changes in zip(held, sides, strict=True):
            if snapshot:
                state.clear()
            state.update(changes)
        books = [{p: q for p, q in state.items() if q > 0} for state in held]
        want[i] = (max(books[0], default=None), min(books[1], default=None), float(sum(books[0].values())), float(sum(books[1].values())))
    assert {k: (r["best_bid"], r["best_ask"], r["bid_depth"], r["ask_depth"]) for k, r in got.items()} == want


def test_seen_paths_equal_pairs(spark):
    """Paths by a sweep against the join of markets and ticks, with late ticks, repeated times and windows that end early."""
    rng = random.Random(4)
    ticks = [(rng.choice("ab"), i, t, t + 1, t + rng.choice((0, 3, 40)), 50.0 + rng.randrange(40)) for i, t in enumerate(rng.randrange(0, 300) for _ in range(250))] + [("a", 900, None, 1, 1, 9.0), ("a", 901, 5, 1, None, 9.0), ("a", 902, 7, 8, 8, 0.0)]
    markets = [(i, rng.choice("abc"), t, t + rng.choice((1, 60, 200)), t + rng.choice((5, 40, 150))) for i, t in enumerate(rng.randrange(-20, 320) for _ in range(60))]
    m = spark.createDataFrame(markets, "market_id long, symbol string, start long, end long, observed long")
    k = spark.createDataFrame(ticks, "symbol string, id long, source long, published long, received long, price double")
    out = paths.seen_paths(m, k, 64)
    assert "overlap" not in plan(out) and "__bin" not in plan(out)
    got = {r["market_id"]: r for r in out.collect()}
    want = {r["market_id"]: r for r in paths.path_aggregate(paths.ticks_seen(m, k), "market_id", "source", "price", 64).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    for i, r in want.items():
        assert (got[i]["n"], got[i]["first"].asDict(), got[i]["last"].asDict()) == (r["n"], r["first"].asDict(), r["last"].asDict())
        assert abs(got[i]["length"] - r["length"]) < 1e-9 and abs(got[i]["variance"] - r["variance"]) < 1e-9


def test_payoffs_neither_sort_nor_group_actions(spark, monkeypatch):
    """Offsets that are no multiples of the step, both ways to join, against loops; with a short path no action is sorted or grouped."""
    rng, step, life, guard, mark, age = random.Random(6), 10, 1_000, 75, 333, 15
    path = [("a", t, m - 0.2, m + 0.2, m, m - 0.1, m + 0.3, m + 0.1) for t, m in ((t, 100 + rng.gauss(0, 0.3)) for t in range(0, 6_000, step) if rng.random() < 0.9)]
    acts = [(i, "a", rng.randrange(0, 5_000), rng.choice((1, -1)), 100.0, 60.0, 90.0, 1.0, 2.0) for i in range(200)] + [(None, "a", 50, 1, 100.0, 60.0, 90.0, 1.0, 2.0)]
    p = spark.createDataFrame(path, "symbol string, t long, min_bid double, max_bid double, close_bid double, min_ask double, max_ask double, close_ask double")
    a = spark.createDataFrame(acts, "id long, symbol string, t long, side int, entry double, stop double, take double, entry_cost double, exit_cost double")

    def known(at):
        end = max((r[1] + step for r in path if r[1] + step <= at), default=None)
        return end if end is not None and at - end <= age else None

    for few in (outcomes.FEW, 0):
        monkeypatch.setattr(outcomes, "FEW", few)
        for check_gap in (True, False):
            out = outcomes.path_payoff(a, p, step, life, guard, age, {"m": mark}, check_gap, False, 80)
            assert few == 0 or not [w for w in ("Aggregate", "SortMergeJoin", "Sort [") if w in plan(out)]
            got = {r["id"]: r for r in out.collect()}
            assert got.keys() == set(range(200)) and len({r["outcome"] for r in got.values()}) >= 3
            for i, _, t, side, *_ in acts[:-1]:
                ends = [known(t + o) for o in (guard, life, mark)]
                valid = None not in ends and ends[1] - step >= t + guard
                assert got[i]["valid"] == valid
                if valid:
                    start = -(-t // step) * step if check_gap else t + guard
                    low, high = 100 * (1 - side * 0.006), 100 * (1 + side * 0.009)
                    hits = (r[1] for r in path if start <= r[1] <= t + life - step and ((r[2] <= low if side == 1 else r[6] >= low) or (r[1] >= t + guard and (r[3] >= high if side == 1 else r[5] <= high))))
                    assert got[i]["exit_t"] == next((h + step for h in hits), t + life), (i, check_gap)
                    quote = next(r for r in path if r[1] + step == ends[2])
                    assert abs(got[i]["markout_m"] - side * (quote[4 if side == 1 else 7] / 100 - 1) * 10_000) < 1e-6


def test_level_bands_merge_both_books_at_once(spark, monkeypatch):
    """Against a loop: unsorted books, sides that are empty, null or hold a null level, null sizes, slices; no function is called for each level."""
    monkeypatch.setattr(orderbook, "SLICE", 7)
    level, rng, rows = "array<struct<price: double, qty: double>>", random.Random(12), []
    for i in range(200):
        side = lambda: [(float(p), rng.choice((1.0, 2.0, None))) for p in rng.sample(range(40), rng.choice((0, 3, 30)))]
        bids, asks = side(), side()
        rows.append(("ab"[i % 2], i, i, None if i % 23 == 5 else bids, None if i % 29 == 7 else [None, *asks] if i % 31 == 8 else asks))
    books = spark.createDataFrame(rows, f"symbol string, event_ms long, update_id long, bids {level}, asks {level}")
    out, want = orderbook.level_bands(books), {}
    assert "map_zip_with" not in plan(out) and "MapInArrow" in plan(out)
    assert "_w0" not in plan(out)  # no second copy of the sides goes through the shuffle
    for (symbol, _, _, *before), (_, _, i, *now) in zip(rows, rows[2:], strict=False):
        if any(s is None or None in s for s in (*before, *now)):
            continue
        for name, was, new in zip(("bid", "ask"), before, now, strict=True):
            a, b = ({p: q or 0.0 for p, q in s} for s in (was, new))
            for p in a.keys() | b.keys():
                rank = 1 + sum(x > p if name == "bid" else x < p for x in a)
                if a.get(p, 0.0) != b.get(p, 0.0):
                    want[i, name, p] = (symbol, b.get(p, 0.0) - a.get(p, 0.0), rank, "1-5" if rank <= 5 else "6-10" if rank <= 10 else "11-20" if rank <= 20 else "outside")
    got = out.collect()
    assert {(r["update_id"], r["side"], r["price"]): (r["symbol"], r["change"], r["rank"], r["band"]) for r in got} == want and len(got) == len(want)
    assert {v[3] for v in want.values()} == {"1-5", "6-10", "11-20", "outside"}
    assert orderbook.level_bands(books.limit(0)).count() == 0
