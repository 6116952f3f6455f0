"""Overlaps, continuity, censored fills, paths and paired quotes on small cases, against plain loops."""

import math
import random

from tidemark.operators import continuity, intervals, pairs, paths, survival

YEAR = 365 * 86_400_000


def test_overlaps_of_all_lengths(spark):
    """A gap of a year and one of a millisecond, open and empty ones, negative times, nulls; each pair once."""
    r = random.Random(3)
    left = [(i, "ab"[i % 2], a := r.randrange(-5_000, 50_000), a + r.choice((0, 1, 900, 40_000))) for i in range(60)]
    left += [(100, "a", 0, YEAR), (101, "b", None, 5), (102, None, 1, 5), (103, "a", 9, 3), (104, "a", 7, None)]
    right = [(i, "ab"[i % 2], a := r.randrange(-5_000, 50_000), a + r.choice((0, 7, 3_000, 200_000))) for i in range(60)]
    right += [(100, "a", -YEAR, YEAR), (101, "a", 20_000, 20_000), (102, "b", 30_000, None), (103, "b", None, None), (104, "a", 50, 10)]
    a = spark.createDataFrame(left, "i int, k string, s long, e long")
    b = spark.createDataFrame(right, "j int, k string, p long, q long")
    got = sorted((x["i"], x["j"]) for x in intervals.overlap_join(a, b, ["k"], ("s", "e"), ("p", "q")).collect())
    inf = math.inf
    want = sorted(
        (i, j) for i, k, s, e in left for j, m, p, q in right
        if k == m and k is not None and None not in (s, p) and s <= (inf if e is None else e) and p <= (inf if q is None else q) and s <= (inf if q is None else q) and p <= (inf if e is None else e)
    )
    assert got == want and len(got) > 500
    assert intervals.overlap_join(a, b.limit(0), ["k"], ("s", "e"), ("p", "q")).count() == 0
    points = b.selectExpr("j", "k", "p")
    inside = sorted((x["i"], x["j"]) for x in intervals.contained_join(a, points, ["k"], ("s", "e"), "p").collect())
    assert inside == sorted((i, j) for i, k, s, e in left for j, m, p, _ in right if k == m and k and None not in (s, p) and s <= p <= (inf if e is None else e))


def test_gaps_of_a_year_and_of_a_millisecond(spark):
    windows = spark.createDataFrame([(1, 1000, 2000, 1500), (2, 3000, 4000, 3500), (3, YEAR, YEAR + 10, YEAR + 5)], "window_id long, w_start long, w_end long, event_start long")
    starts = spark.createDataFrame([("s", "a", 0), ("s", "b", 2001), ("s", "c", 3500), ("q", "x", 0), ("q", "y", YEAR + 1)], "stream string, connection string, started long")
    # s: one gap from 2000 to 2001, in window 1 at its last millisecond; one from 3400 to 3500; an open one from a year on. q: a gap of a year
    gaps = spark.createDataFrame([("s", "a", 2000), ("s", "b", 3400), ("s", "c", YEAR + 10), ("q", "x", 1500)], "stream string, connection string, opened long")
    got = sorted(map(tuple, continuity.gap_reasons(windows, gaps, starts).collect()))
    assert got == [(1, "stream_gap:q:1"), (1, "stream_gap:s:1"), (2, "stream_gap:q:1"), (2, "stream_gap:s:1"), (3, "stream_gap:q:1"), (3, "stream_gap:s:1")]


def test_an_eligible_window_and_its_breaks(spark):
    windows = spark.createDataFrame([(1, 100, 200, 120)], "window_id long, w_start long, w_end long, event_start long")
    expected = spark.createDataFrame([(1, "book", "btc", "up", ["book"], True), (1, "spot", "btc", "", ["trade"], False)], "window_id long, stream string, asset string, token string, needs array<string>, baseline boolean")
    events = [(1, "book", "btc", "up", "book", "c1", 50), (2, "book", "btc", "up", "book", "c1", 150), (3, "spot", "btc", "", "trade", "d1", 90), (4, "spot", "btc", "", "trade", "d1", 130), (5, "spot", "btc", "", "trade", "d1", 260), (6, "spot", None, None, "trade", None, None)]
    schema = "id long, stream string, asset string, token string, kind string, connection string, t long"
    no_gaps = spark.createDataFrame([], "stream string, connection string, opened long")
    seen = spark.createDataFrame([(1, "btc", 125)], "window_id long, asset string, observed long")
    told = continuity.eligibility(windows, expected, spark.createDataFrame(events, schema), no_gaps, seen, ["book", "trade"], 10).first()
    assert told["eligible"] and told["reasons"] == []
    late = spark.createDataFrame([(1, "btc", 131)], "window_id long, asset string, observed long")
    broken = [*events[:4], (7, "book", "btc", "up", "book", "c2", 160), (8, "spot", "btc", "", "quote", "d1", 190)]
    gap = spark.createDataFrame([("book", "c1", 155)], "stream string, connection string, opened long")
    told = continuity.eligibility(windows, expected, spark.createDataFrame(broken, schema), gap, late, ["book", "trade"], 10).first()
    assert not told["eligible"]
    assert told["reasons"] == ["late_or_missing_snapshot:btc", "run_ended_before_window_end", "segment_count:book:btc:up:2", "stream_gap:book:1"]


def test_hazards_are_kaplan_meier(spark):
    """Delays, censoring before and at an edge, against counting by hand."""
    r = random.Random(5)
    edges = [10, 20, 50]
    rows = [(i, 1000, 1000 + r.randrange(0, 70) if i % 3 else None, 1000 + r.randrange(0, 60) if i % 4 == 0 else None, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t long, filled long, pulled long, g int")
    panel = {x["id"]: (x["bucket"], x["watched"]) for x in survival.fill_panel(df, "t", "filled", edges, "pulled").collect()}
    for i, t, f, p, _ in rows:
        stop = 50 if p is None else p - t
        d = None if f is None or f - t > min(stop, 50) else f - t
        bucket = 0 if d is None else next(k for k, e in enumerate(edges, 1) if d <= e)
        assert panel[i] == (bucket, bucket or sum(stop >= e for e in edges))
    got = {(x["g"], x["interval"]): x for x in survival.hazards(survival.fill_panel(df, "t", "filled", edges, "pulled"), ["g"]).collect()}
    for g in (0, 1):
        s = 1.0
        for k in (1, 2, 3):
            mine = [panel[i] for i, *_, h in rows if h == g]
            risk, hit = sum(w >= k for _, w in mine), sum(b == k for b, _ in mine)
            s *= 1 - hit / risk
            x = got[g, k]
            assert (x["at_risk"], x["events"]) == (risk, hit) and math.isclose(x["survival"], s, abs_tol=1e-12)
    told = survival.risk_rows(survival.fill_panel(df, "t", "filled", edges, "pulled")).where("interval = 2").select("id", "event").collect()
    assert sorted(map(tuple, told)) == sorted(map(tuple, survival.hazard_risk_set(survival.fill_panel(df, "t", "filled", edges, "pulled"), 1).select("id", "label").collect()))
    gone = survival.hazards(survival.fill_panel(df.where("id = 1").selectExpr("id", "t", "t + 1 AS filled", "g"), "t", "filled", edges), []).collect()
    assert [(x["at_risk"], x["survival"]) for x in gone] == [(1, 0.0)]


def test_paths_merge_across_stretches(spark):
    r = random.Random(9)
    rows = [("m", t, 100 + r.random()) for t in sorted(r.sample(range(10_000), 200))] + [("n", 5, 7.0)]
    df = spark.createDataFrame(rows, "market_id string, source long, price double")
    for stretch in (1, 97, 20_000):
        got = {x["market_id"]: x for x in paths.path_aggregate(df, "market_id", "source", "price", stretch).collect()}
        p = [x for k, _, x in rows if k == "m"]
        steps = [math.log(b / a) for a, b in zip(p, p[1:], strict=False)]
        m = got["m"]
        assert (m["n"], m["first"]["price"], m["last"]["price"]) == (200, p[0], p[-1])
        assert math.isclose(m["length"], sum(map(abs, steps))) and math.isclose(m["variance"], sum(x * x for x in steps))
        assert (got["n"]["n"], got["n"]["length"]) == (1, 0.0)


def test_paths_of_overlapping_windows_and_late_ticks(spark):
    markets = spark.createDataFrame([(1, "a", 0, 100, 60), (2, "a", 50, 150, 120), (3, "a", 0, 100, 100), (4, "b", 0, 100, 50), (5, None, 0, 100, 50)], "market_id long, symbol string, start long, `end` long, observed long")
    ticks = [("a", 1, 0, 1, 2, 10.0), ("a", 2, 20, 21, 25, 11.0), ("a", 3, 40, 41, 130, 99.0), ("a", 4, 50, 51, 52, 12.0), ("a", 5, 50, 51, 51, 12.5), ("a", 6, 90, 91, 92, 11.0), ("a", 7, None, 1, 1, 5.0), ("a", 8, 30, 31, 32, -1.0), (None, 9, 0, 1, 2, 10.0)]
    df = spark.createDataFrame(ticks, "symbol string, id long, source long, published long, received long, price double")
    got = {x["market_id"]: x for x in paths.path_features(markets, df, 40, 1, 0.03, 30).collect()}
    assert got[1]["available"] and got[1]["tick_count"] == 3 and got[1]["current"] == 12.5
    assert math.isclose(got[1]["log_distance"], math.log(1.25)) and math.isclose(got[1]["efficiency"], 1.0)
    assert got[2]["reasons"] == [] and got[2]["opening"] == 12.5 and got[2]["tick_count"] == 2
    assert got[3]["reasons"] == ["market_window_not_live"] and got[3]["tick_count"] == 4 and got[3]["log_distance"] is None
    assert got[4]["reasons"] == ["exact_opening_missing", "no_causal_ticks", "insufficient_return_count", "insufficient_time_coverage"] == got[5]["reasons"]


def test_episodes_and_survivors(spark):
    """A loop over states in order, with two outcomes that come at their own times and at the same one."""
    r = random.Random(11)
    t, quotes = 0, []
    for i in range(400):
        t += r.choice((0, 1, 5, 30, 400))
        quotes.append(("k" if i % 5 else "l", r.choice(("up", "down")), t, t + 3, i, 0.5, None if r.random() < 0.1 else r.uniform(0.4, 0.6), r.uniform(0.4, 0.6)))
    quotes.append((None, "up", 5, 5, 999, 0.5, 0.1, 0.1))
    segments = [("k", 0, 20_000, 19_000, 10), ("l", 0, 50_000, 60_000, 25), ("none", 0, 1, 1, 1)]
    q = spark.createDataFrame(quotes, "key string, outcome string, t long, wall long, id long, ask double, buy double, sell double")
    s = spark.createDataFrame(segments, "key string, seg_start long, seg_end long, market_end long, delay long")
    got = {x["key"]: tuple(x)[1:] for x in pairs.episode_survivors(pairs.paired_quotes(q, s, 40), s).collect()}
    for key, _, end, market_end, delay in segments:
        last, states = {}, []
        mine = [x for x in quotes if x[0] == key]
        for at in sorted({x[2] for x in mine}):
            for x in sorted((x for x in mine if x[2] == at), key=lambda x: x[4]):
                last[x[1]] = x
            if len(last) == 2 and abs(last["up"][2] - last["down"][2]) <= 40 and (wall := max(last["up"][3], last["down"][3])) <= end:
                states.append((at, wall, last["up"][6], last["down"][6]))
        cost = lambda x: None if None in x[2:] else x[2] + x[3]
        active, starts = False, []
        for x in states:
            now = cost(x) is not None and cost(x) < 1
            if now and not active:
                starts.append(x)
            active = now
        one, seq = [], []
        for x in starts:
            def then(d, x=x):
                held = [y for y in states if y[0] <= x[0] + d]
                return held[-1] if x[1] + d <= end and x[1] + d < market_end else None
            a, b = then(delay), then(2 * delay)
            if a and cost(a) is not None:
                one.append(cost(a))
            ways = [u + v for u, v in ((a[2], b[3]), (a[3], b[2])) if u is not None and v is not None] if a and b else []
            seq += [min(ways)] if ways else []
        want = (len(starts), sum(c < 1 for c in one), sum(c < 1 for c in seq), min(map(cost, starts), default=None), min(one, default=None), min(seq, default=None))
        assert all(a == b or math.isclose(a, b) for a, b in zip(got[key], want, strict=True)), (key, got[key], want)
    assert got["k"][0] > 5


def test_ids_of_two_archives_are_an_error(spark):
    import pytest
    from pyspark.errors import PySparkException

    from tidemark.sources import frames

    target = spark.createDataFrame([(1, 10), (2, 10), (None, 10)], "id long, archive long")
    manifest = spark.createDataFrame([(10, "verified"), (11, "verified"), (12, "partial")], "archive long, status string")
    good = spark.createDataFrame([(3, 11), (None, 11), (1, 12), (9, 10)], "id long, archive long")
    assert sorted(map(tuple, frames.merge_verified(target, good, manifest, "archive", "id").collect()), key=repr) == sorted([(1, 10), (2, 10), (None, 10), (3, 11), (None, 11)], key=repr)
    with pytest.raises(PySparkException, match="id of two archives: 2"):
        frames.merge_verified(target, spark.createDataFrame([(2, 11)], "id long, archive long"), manifest, "archive", "id").collect()
    assert sorted(map(tuple, frames.merge_manifest(manifest.where("archive = 10"), manifest, "archive").collect())) == [(10, "verified"), (11, "verified")]


def test_clusters_stop_at_their_bound(spark):
    import pytest

    from tidemark.operators import regimes

    chain = spark.createDataFrame([(f"s{i:03}", f"s{i + 1:03}", 0.9) for i in range(40)], "symbol string, other string, corr double")
    symbols = spark.createDataFrame([(f"s{i:03}",) for i in range(41)], "symbol string")
    with pytest.raises(RuntimeError, match="did not settle"):
        regimes.correlation_clusters(chain, symbols, 0.5, max_rounds=1)


def test_tape_rows_know_nothing_later(spark):
    """Prices and depth after a decision's second change its targets at most; rows without a symbol or a time are left out."""
    from pyspark.sql import functions as F

    from tidemark.operators import tapedepth

    r = random.Random(2)
    tape = [("a", i * 1000, p := 100 + r.random(), p + 1, p - 1, p, 2.0, 2 * p, 1.5, 0.5, 3) for i in range(80) if i % 7]
    schema = "symbol string, open_time long, open double, high double, low double, close double, base_volume double, quote_volume double, buy_volume double, sell_volume double, trade_count long"
    depth = [("a", i * 1500 + 300, *[r.uniform(1, 9) for _ in range(6)], 0.1, 0.2, 0.3) for i in range(50)]
    cells = ", ".join([*(f"{s}_{b} double" for b in tapedepth.BANDS for s in ("bid", "ask")), *(f"imbalance_{b} double" for b in tapedepth.BANDS)])
    t, d = spark.createDataFrame([*tape, (None, *tape[0][1:]), ("a", None, *tape[0][2:])], schema), spark.createDataFrame(depth, f"symbol string, depth_time long, {cells}")
    make = lambda t, d: {x["decision_time"]: x.asDict() for x in tapedepth.tape_depth_dataset(t, d, 1000, 90, 1, 3, 1, 2_000).collect()}
    one = make(t, d)
    two = make(t.withColumns({c: F.when(F.col("open_time") > 40_000, 7.0).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}), d.withColumn("bid_far", F.when(F.col("depth_time") > 40_000, 1e6).otherwise(F.col("bid_far"))))
    targets = ("entry_price", "exit_price", "gross_return")
    assert len(one) > 50
    for k in (x for x in one if x <= 41_000):
        assert {c: v for c, v in one[k].items() if c not in targets} == {c: v for c, v in two[k].items() if c not in targets}
    assert one[41_000]["exit_price"] != two[41_000]["exit_price"]
