"""Resampling and clocks: trade bars, quote bars, dense spines, coarser bars, calendar phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join


def bucket(t: str, step: int) -> Column:
    return (F.floor(F.col(t) / step) * step).cast("long")


def place(t: str, order: str) -> Column:
    """(t, order) as one decimal, which a hash aggregate can hold; both below 10^18."""
    return F.col(t).cast("decimal(18,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(order).cast("decimal(18,0)")


def trade_bars(trades: DataFrame, step: int) -> DataFrame:
    """One row for each symbol and bucket with trades; first and last by (t, id). Map-side combined, in a hash table.

    A row may stand for several trades: ``trade_count`` counts the ids from its first to its last.
    """
    order = place("t", "id")
    return trades.groupBy("symbol", bucket("t", step).alias("open_time")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
        F.sum(F.col("last_id") - F.col("first_id") + 1).alias("trade_count"),
        F.sum(F.when(~F.col("buyer_is_maker"), F.col("qty")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(~F.col("buyer_is_maker"), F.col("price") * F.col("qty")).otherwise(0.0)).alias("buy_quote_volume"),
    )


def clock_spine(bars: DataFrame, step: int) -> DataFrame:
    """Every bucket from a symbol's first to its last."""
    ends = bars.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(step))).alias("open_time"))


def held(spine: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """The spine with each bucket's bar, or the close before it without volume; null prices before the first."""
    j = asof_join(spine, bars, "symbol", "open_time", "open_time", "open_time", bucket_ms=step * 4096)
    here = F.col("r_open_time") == F.col("open_time")
    prices = [F.when(here, F.col(f"r_{c}")).otherwise(F.col("r_close")).alias(c) for c in ("open", "high", "low", "close")]
    return j.select("symbol", "open_time", *prices, *[F.when(here, F.col(f"r_{c}")).otherwise(F.lit(0)).alias(c) for c in ("volume", "quote_volume", "trade_count", "buy_volume", "buy_quote_volume")])


def fill_bars(bars: DataFrame, step: int) -> DataFrame:
    """Dense bars: an empty bucket takes the close before it, without volume."""
    return held(clock_spine(bars, step), bars, step)


def fill_period(bars: DataFrame, step: int, start: int, end: int) -> DataFrame:
    """Dense bars over a whole period; buckets before a symbol's first known price are left out."""
    spine = bars.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step))).alias("open_time"))
    return held(spine, bars, step).where("close is not null")


def tape_buckets(trades: DataFrame, step: int) -> DataFrame:
    """Takers' buying and selling of each bucket."""
    notional, sell = F.col("price") * F.col("qty"), F.col("buyer_is_maker")
    order = F.struct("t", "id")
    return trades.groupBy("symbol", bucket("t", step).alias("open_time")).agg(
        F.sum(F.when(~sell, F.col("qty")).otherwise(0.0)).alias("buy_qty"), F.sum(F.when(sell, F.col("qty")).otherwise(0.0)).alias("sell_qty"),
        F.sum(F.when(~sell, notional).otherwise(0.0)).alias("buy_notional"), F.sum(F.when(sell, notional).otherwise(0.0)).alias("sell_notional"),
        F.count_if(~sell).alias("buys"), F.count_if(sell).alias("sells"), F.max(notional).alias("max_notional"), F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"),
    )


def dense_flow(trades: DataFrame, step: int) -> DataFrame:
    """Dense buckets with prices, quote flow of both sides, aggregate and constituent counts, concentration sums and the age of the last trade.

    A bucket without trades takes the close before it for all its prices.
    """
    quote, sell = F.col("price") * F.col("qty"), F.col("buyer_is_maker")
    order = place("t", "id")
    flow = trades.groupBy("symbol", bucket("t", step).alias("open_time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum(F.when(~sell, quote).otherwise(0.0)).alias("buy_quote"), F.sum(F.when(sell, quote).otherwise(0.0)).alias("sell_quote"),
        F.count("*").alias("aggregates"), F.sum(F.col("last_id") - F.col("first_id") + 1).alias("constituents"), F.max(quote).alias("max_quote"), F.sum(quote * quote).alias("squared_quote"), F.max("t").alias("last_t"),
    )
    j = asof_join(clock_spine(flow, step), flow, "symbol", "open_time", "open_time", "open_time", bucket_ms=step * 4096)
    here = F.col("r_open_time") == F.col("open_time")
    sums = [F.when(here, F.col(f"r_{c}")).otherwise(F.lit(0)).alias(c) for c in ("buy_quote", "sell_quote", "aggregates", "constituents", "max_quote", "squared_quote")]
    prices = [F.when(here, F.col(f"r_{c}")).otherwise(F.col("r_close")).alias(c) for c in ("open", "high", "low", "close")]
    return j.select("symbol", "open_time", *prices, *sums, (F.col("open_time") + step - F.col("r_last_t")).alias("age"))


def quote_path(quotes: DataFrame, step: int) -> DataFrame:
    """Lowest, highest and last bid and ask of each bucket."""
    order = F.struct("event_ms", "update_id")
    aggs = [a for c in ("bid", "ask") for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.max_by(c, order).alias(f"last_{c}"))]
    return quotes.groupBy("symbol", bucket("event_ms", step).alias("open_time")).agg(*aggs, F.max("txn_ms").alias("last_txn_ms"))


def bars_across_files(trades: DataFrame, file: str, step: int) -> DataFrame:
    """One bar for each bucket whatever files its trades are in, and how many those are."""
    order = F.struct("t", "id")
    return trades.groupBy("symbol", bucket("t", step).alias("open_time")).agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"), F.count("*").alias("trades"), F.count_distinct(F.col(file)).alias("files"))


def depth_pivot(depth: DataFrame, bands: list[int]) -> DataFrame:
    """Depth and notional by band as columns, with the imbalance of each pair of bands."""
    sides = [(b, F.col("band") == s * b, n) for b in bands for s, n in ((-1, "bid"), (1, "ask"))]
    aggs = [F.sum(F.when(here, F.col("depth"))).alias(f"{n}_{b}") for b, here, n in sides]
    aggs += [F.sum(F.when(here, F.col("depth") * F.col("price"))).alias(f"{n}_notional_{b}") for b, here, n in sides]
    wide = depth.groupBy("symbol", "id").agg(*aggs)
    return wide.withColumns({f"imbalance_{b}": (F.col(f"bid_{b}") - F.col(f"ask_{b}")) / (F.col(f"bid_{b}") + F.col(f"ask_{b}")) for b in bands})


def liquidity_bucket(t: str, minutes: int) -> list[Column]:
    """Weekday (Monday 0), hour and stretch of the hour."""
    ms = F.col(t)
    return [F.pmod(F.floor(ms / 86_400_000) + 3, F.lit(7)).alias("weekday"), F.pmod(F.floor(ms / 3_600_000), F.lit(24)).alias("hour"), F.floor(F.pmod(ms, F.lit(3_600_000)) / (60_000 * minutes)).alias("part")]


def rebar(bars: DataFrame, step: int, k: int) -> DataFrame:
    """k bars to one; only blocks that are whole."""
    wide = bars.groupBy("symbol", bucket("open_time", step * k).alias("block")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )
    return wide.where(F.col("n") == k).select("symbol", F.col("block").alias("open_time"), "open", "high", "low", "close", "volume")


def quote_bars(quotes: DataFrame, step: int) -> DataFrame:
    """Mid open to close, the last quote and its microprice's distance from mid, spread, imbalance and delay quantiles of each bucket."""
    order = place("event_ms", "update_id")
    mid = (F.col("bid") + F.col("ask")) / 2
    q = quotes.withColumns({
        "mid": mid,
        "spread": (F.col("ask") - F.col("bid")) / mid * 10_000,
        "imbalance": (F.col("bid_qty") - F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty")),
        "delay": F.col("event_ms") - F.col("txn_ms"),
        "offset": ((F.col("ask") * F.col("bid_qty") + F.col("bid") * F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty")) / mid - 1) * 10_000,
    })
    last = [F.max_by(c, order).alias(f"close_{c}") for c in ("bid", "ask", "bid_qty", "ask_qty")]
    return q.groupBy("symbol", bucket("event_ms", step).alias("open_time")).agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"),
        F.avg("spread").alias("mean_spread"), F.max("spread").alias("max_spread"), F.avg("imbalance").alias("mean_imbalance"),
        F.max_by("imbalance", order).alias("close_imbalance"), *last, F.max_by("offset", order).alias("microprice_offset"), F.percentile("delay", 0.5).alias("delay_p50"), F.percentile("delay", 0.99).alias("delay_p99"),
    )


def calendar_features(df: DataFrame, t: str) -> DataFrame:
    """Phases of the day, 8 hours, the week and 1, 5 and 15 minutes, and whether it is the weekend; weekday 0 is Monday."""
    day = F.floor(F.col(t) / 86_400_000)
    weekday = F.pmod(day + 3, F.lit(7)).cast("int")
    periods = {"day": 86_400_000, "eight": 28_800_000, "week": 7 * 86_400_000, "minute": 60_000, "five": 300_000, "quarter": 900_000}

    def clean(x: Column) -> Column:
        return F.round(x, 12) + F.lit(0.0)  # no negative zero

    waves = {}
    for name, period in periods.items():
        into = F.pmod(F.col(t) + (3 * 86_400_000 if name == "week" else 0), F.lit(period)) / period * (2 * 3.141592653589793)
        waves |= {f"{name}_sin": clean(F.sin(into)), f"{name}_cos": clean(F.cos(into))}
    return df.withColumns({"weekday": weekday, "weekend": weekday >= 5, **waves})
