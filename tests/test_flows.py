"""Metric sets by window: chunks change nothing, the first five minutes, buckets without flow, empty tables."""

import math

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def test_chunks_change_nothing(spark, monkeypatch):
    from tidemark.operators import bars, features, flows
    from tidemark.plans.base import dense
    from tidemark.sources import views

    def results():
        trades = views.trades(spark, SF)
        made = [flows.market_windows(bars.dense_flow(trades, HOUR), (1, 6), HOUR), flows.tape_windows(dense(spark, SF), bars.tape_buckets(trades, HOUR), (6,)), flows.activity_day(bars.trade_bars(trades, 60_000), 60_000)]
        return [sorted(map(str, (tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in df.collect()))) for df in made]

    whole = results()
    monkeypatch.setattr(features, "CHUNK_ROWS", 1)
    assert results() == whole


def test_activity_begins_after_five_minutes(spark):
    from tidemark.operators import flows

    rows = [("a", i * 60_000, 10.0, 3) for i in (0, 1, 4, 5)] + [("a", 5 * 60_000 + 86_400_000, 10.0, 3)]
    got = {r["open_time"]: r for r in flows.activity_day(spark.createDataFrame(rows, "symbol string, open_time long, quote_volume double, trade_count long"), 60_000).collect()}
    assert [got[i * 60_000]["quote_volume_day"] for i in (0, 1)] == [0.0, 0.0] and got[0]["trade_count_day"] == 0
    assert math.isclose(got[240_000]["quote_volume_day"], 30 * 86_400_000 / 300_000) and got[240_000]["observed"] == 300_000
    last = got[5 * 60_000 + 86_400_000]  # the bar of a day before is still in, and a day is the most that counts
    assert (last["observed"], last["quote_volume_day"], last["trade_count_day"]) == (86_400_000, 20.0, 6)


def test_windows_without_flow_and_empty(spark):
    from tidemark.operators import flows

    schema = "symbol string, open_time long, open double, high double, low double, close double, buy_quote double, sell_quote double, aggregates long, constituents long, max_quote double, squared_quote double, age long"
    quiet = [("a", i * 1000, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0, 0, 0.0, 0.0, 1000) for i in range(4)]
    got = sorted(flows.market_windows(spark.createDataFrame(quiet, schema), (2,)).collect(), key=lambda r: r["open_time"])
    assert got[0]["signed_flow_2"] is None and got[1]["signed_flow_2"] == 0.0 and got[1]["return_2"] is None
    assert got[3]["concentration_2"] == 0.0 and got[3]["zero_share_2"] == 1.0 and got[3]["log_volume_change_2"] == 0.0
    assert flows.market_windows(spark.createDataFrame([], schema), (2,)).count() == 0
