"""The query of microstructure features, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars, microstructure
from tidemark.operators.microstructure import DELTAS, RANGES, RETURNS, VOLATILITIES
from tidemark.plans.base import HOUR, Query, V
from tidemark.sources import views

#: Rows of 8 hours stand for seconds, and an hour of them for 30 rows.
STEP, UNIT, CADENCE = 8 * HOUR, 120, 2
#: Left out here: over a window of one row they divide by a spread of nothing.
SHOWN = [c for c in microstructure.NAMES if c not in ("drift_60", "spread_to_volatility")]


def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and trades of two groups of symbols, by 8 hours."""
    pair = F.when(F.col("symbol") < "m", "a").otherwise("b")
    q = views.quotes(spark, sf_dir).withColumn("symbol", pair)
    quoted = bars.quote_bars(q, STEP).withColumnsRenamed({"mean_spread": "spread", "mean_imbalance": "imbalance"}).drop("open")
    updates = q.groupBy("symbol", bars.bucket("event_ms", STEP).alias("open_time")).agg(F.count("*").cast("double").alias("quote_updates"))
    bought = F.when(~F.col("buyer_is_maker"), F.col("qty")).otherwise(0.0)
    t = views.trades(spark, sf_dir).withColumn("symbol", pair).groupBy("symbol", bars.bucket("t", STEP).alias("open_time")).agg(
        F.max_by("price", F.struct("t", "id")).alias("trade_close"), F.sum("qty").alias("base_volume"), F.sum(bought).alias("buy_volume"), F.count("*").cast("double").alias("trade_count"),
    )
    t = t.withColumn("sell_volume", F.col("base_volume") - F.col("buy_volume")).withColumn("trade_imbalance", (F.col("buy_volume") - F.col("sell_volume")) / F.col("base_volume"))
    return quoted.join(updates, ["symbol", "open_time"]).join(t, ["symbol", "open_time"])


def _n(s: int) -> int:
    return max(1, s // UNIT)


def _w(s: int) -> str:
    return f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {_n(s) - 1} PRECEDING AND CURRENT ROW)"


def _sql() -> str:
    o = "(PARTITION BY symbol ORDER BY open_time)"
    ratio = lambda a, d: f"({a}) / greatest({d}, 1e-12::DOUBLE)"
    mean, total = lambda c, s: f"avg({c}) OVER {_w(s)}", lambda c, s: f"sum({c}) OVER {_w(s)}"
    vol = {s: f"coalesce(stddev_pop(step) OVER {_w(s)}, 0)" for s in VOLATILITIES}
    f = {f"return_{s}": f"{total('step', s)} * 10000" for s in RETURNS} | {f"volatility_{s}": f"{vol[s]} * 10000" for s in VOLATILITIES}
    f |= {"range_1": "(high - low) * 10000 / close"} | {f"range_{s}": f"(max(high) OVER {_w(s)} - min(low) OVER {_w(s)}) * 10000 / close" for s in RANGES}
    f |= {c: c for c in ("spread", "max_spread", "imbalance", "close_imbalance", "ofi", "trade_imbalance", "delay_p50", "delay_p99")} | {"microprice": "microprice_offset"}
    for name, c, sizes in (("spread", "spread", (60, 300, 900)), ("quote", "quote_updates", (60, 300, 900)), ("volume", "base_volume", (60, 300, 900)), ("trade", "trade_count", (900,)), ("delay", "delay_p99", (60,)), ("depth", "depth_quote", (60, 300))):
        f |= {f"{name}_ratio_{s}": ratio(c, mean(c, s)) for s in sizes}
    for c in ("imbalance", "ofi", "trade_imbalance"):
        f |= {f"{c}_mean_{s}": mean(c, s) for s in (10, 60, 300)}
    for name, c in (("close_imbalance", "close_imbalance"), ("microprice", "microprice_offset"), ("ofi", "ofi"), ("trade_imbalance", "trade_imbalance")):
        f |= {f"{name}_delta_{s}": f"{c} - lag({c}, {_n(s)}) OVER {o}" for s in DELTAS}
    f |= {"log_quotes": "ln(1 + quote_updates)", "log_volume": "ln(1 + base_volume)", "log_trades": "ln(1 + trade_count)", "log_bid_depth": "ln(1 + bid_quote)", "log_ask_depth": "ln(1 + ask_quote)"}
    f |= {f"signed_share_{s}": ratio(total("signed", s), total("base_volume", s)) for s in (10, 60, 300)} | {"trade_gap": "(trade_close / close - 1) * 10000"}
    f |= {f"efficiency_{s}": ratio(f"abs({total('step', s)})", total("abs(step)", s)) for s in (60, 300, 900, 3_600)}
    f |= {f"drift_{s}": ratio(total("step", s), f"{vol[s]} * sqrt({_n(s)})") for s in (60, 300, 900, 1_800, 3_600)}
    f |= {f"volatility_ratio_{a}_{z}": ratio(vol[a], vol[z]) for a, z in ((10, 300), (60, 900), (300, 3_600), (900, 3_600))}
    f |= {"spread_to_volatility": ratio("spread", f"{vol[10]} * 10000"), "ofi_trade": "ofi * trade_imbalance", "quotes_to_trades": "ln(1 + quote_updates) - ln(1 + trade_count)", "place_in_range": "CASE WHEN high > low THEN 2 * (close - low) / greatest(high - low, 1e-12::DOUBLE) - 1 ELSE 0 END"}
    for name, period, shift in (("day", 86_400, 0), ("eight", 28_800, 0), ("week", 604_800, 259_200)):
        f |= {f"{name}_{k}": f"{k}(((open_time // 1000 + {shift}) % {period}) * (2 * 3.141592653589793::DOUBLE / {period}))" for k in ("sin", "cos")}
    f["weekend"] = "CASE WHEN (open_time // 86400000 + 3) % 7 >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE"
    for s in (10, 60, 300):
        flow = total("signed", s)
        f[f"pressure_{s}"] = f"CASE WHEN {flow} >= 0 THEN ln(1 + abs({flow}) / greatest(close_ask_qty, 1e-12::DOUBLE)) ELSE -ln(1 + abs({flow}) / greatest(close_bid_qty, 1e-12::DOUBLE)) END"
    late = ", ".join(f"lag({c}) OVER w AS {c}" for c in microstructure.TRADE)
    kept = ", ".join(c for c in microstructure.COLUMNS if c not in microstructure.TRADE)
    return (
        V
        + f""", q AS (SELECT *, CASE WHEN symbol < 'm' THEN 'a' ELSE 'b' END AS pair, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) * 10000 AS sp, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS im, ((ask * bid_qty + bid * ask_qty) / (bid_qty + ask_qty) / ((bid + ask) / 2) - 1) * 10000 AS mp, event_ms - txn_ms AS delay FROM v_quotes),
b AS (SELECT pair AS symbol, event_ms // {STEP} * {STEP} AS open_time, max(mid) AS high, min(mid) AS low, arg_max(mid, (event_ms, update_id)) AS close, {', '.join(f'arg_max({c}, (event_ms, update_id)) AS close_{c}' for c in ('bid', 'ask', 'bid_qty', 'ask_qty'))}, avg(sp) AS spread, max(sp) AS max_spread, avg(im) AS imbalance,
  arg_max(im, (event_ms, update_id)) AS close_imbalance, arg_max(mp, (event_ms, update_id)) AS microprice_offset, count(*)::DOUBLE AS quote_updates, quantile_cont(delay, 0.5) AS delay_p50, quantile_cont(delay, 0.99) AS delay_p99 FROM q GROUP BY 1, 2),
t0 AS (SELECT CASE WHEN symbol < 'm' THEN 'a' ELSE 'b' END AS symbol, t // {STEP} * {STEP} AS open_time, arg_max(price, (t, id)) AS trade_close, sum(qty) AS base_volume, sum(CASE WHEN buyer_is_maker THEN 0 ELSE qty END) AS buy_volume, count(*)::DOUBLE AS trade_count FROM v_trades GROUP BY 1, 2),
j AS (SELECT b.*, trade_close, base_volume, buy_volume, base_volume - buy_volume AS sell_volume, (2 * buy_volume - base_volume) / base_volume AS trade_imbalance, trade_count FROM b JOIN t0 ON t0.symbol = b.symbol AND t0.open_time = b.open_time),
d AS (SELECT symbol, open_time, {kept}, {late}, lag(buy_volume - sell_volume) OVER w AS signed, ln(close / lag(close) OVER w) AS step, close_bid * close_bid_qty AS bid_quote, close_ask * close_ask_qty AS ask_quote, close_bid * close_bid_qty + close_ask * close_ask_qty AS depth_quote,
  (CASE WHEN close_bid >= lag(close_bid) OVER w THEN close_bid_qty ELSE 0 END - CASE WHEN close_bid <= lag(close_bid) OVER w THEN lag(close_bid_qty) OVER w ELSE 0 END - CASE WHEN close_ask <= lag(close_ask) OVER w THEN close_ask_qty ELSE 0 END + CASE WHEN close_ask >= lag(close_ask) OVER w THEN lag(close_ask_qty) OVER w ELSE 0 END)
   / greatest((close_bid_qty + close_ask_qty + lag(close_bid_qty) OVER w + lag(close_ask_qty) OVER w) / 2, 1e-12::DOUBLE) AS ofi, lag(open_time, 30) OVER w AS first FROM j WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
e AS (SELECT symbol, open_time, first, {', '.join(f'{v} AS "{k}_"' for k, v in f.items())} FROM d)
SELECT symbol, open_time, open_time + {STEP} AS decision_time, {', '.join(f'round("{k}_" + 1e-9::DOUBLE, 6) AS "{k}"' for k in SHOWN)} FROM e WHERE first = open_time - 30 * {STEP} AND (open_time // {STEP} + 1) % {CADENCE} = 0"""
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = microstructure.microstructure_features(seconds(spark, sf_dir), STEP, UNIT, CADENCE)
    return out.select("symbol", "open_time", "decision_time", *[(F.col(c) + 1e-9).alias(c) for c in SHOWN])


QUERIES: dict[str, tuple[Query, str]] = {"F27_microstructure_features": (featured, _sql())}
