"""Queries of resampling and point-in-time joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, features
from tidemark.plans.base import DAY, DENSE, HOUR, TIE, Query, V, hourly
from tidemark.sources import views


def _span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last whole day of the trades, one row from an aggregate."""
    a, b = views.trades(spark, sf_dir).agg(F.min("t"), F.max("t")).first()
    return a // DAY * DAY, b // DAY * DAY + DAY - HOUR


def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.fill_period(hourly(spark, sf_dir), HOUR, *_span(spark, sf_dir))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.trades(spark, sf_dir).withColumn("band", F.explode(F.array(*[F.lit(b) for b in (-5, -3, -1, 1, 3, 5)])))
    return bars.depth_pivot(rows.select("symbol", "id", "band", "price", (F.col("qty") * F.abs("band") + F.when(F.col("band") > 0, 1.0).otherwise(0.0)).alias("depth")), [1, 3, 5])


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade on lane a; on lane b later, every 11th missing; messages repeat."""
    t = views.trades(spark, sf_dir).select("id", "t", F.concat_ws("|", "symbol", (F.col("id") % 50).cast("string")).alias("message"))
    late = t.where("id % 11 != 0").select("message", (F.col("t") + F.col("id") % 3000).alias("received"), F.lit("b").alias("lane"))
    return t.select("message", F.col("t").alias("received"), F.lit("a").alias("lane")).unionByName(late)


def levelled(df: DataFrame) -> DataFrame:
    return df.withColumn("level", F.concat_ws("|", "symbol", F.floor(F.col("price") / 100).cast("string")))


def passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = levelled(views.trades(spark, sf_dir))
    orders = t.select("id", "level", (F.col("t") + 750).alias("t"))
    return asof.first_passage(orders, t.select("level", "t", "id", "qty"), 40, 2 * DAY).select("id", "t", "filled")


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each symbol and 8 hours."""
    step = 8 * HOUR
    return views.trades(spark, sf_dir).groupBy("symbol", bars.bucket("t", step).alias("t")).agg((F.avg("price") / 100).alias("rate"), F.min("id").alias("id"))


FUNDING = V + ", f AS (SELECT symbol, t // 28800000 * 28800000 AS t, avg(price) / 100 AS rate, min(id) AS id FROM v_trades GROUP BY 1, 2)"
FLOW = "SELECT symbol, t // 3600000 * 3600000 AS open_time, "

QUERIES: dict[str, tuple[Query, str]] = {
    "R03_fill_period": (
        period,
        V
        + f""", e AS (SELECT min(t) // {DAY} * {DAY} AS a, max(t) // {DAY} * {DAY} + {DAY - HOUR} AS b FROM v_trades),
s AS (SELECT symbol, unnest(generate_series(a, b, {HOUR})) AS open_time FROM e, (SELECT DISTINCT symbol FROM v_bars)),
h AS (SELECT s.symbol, s.open_time, open, high, low, close, volume, quote_volume, trade_count, buy_volume, buy_quote_volume, last_value(close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior
  FROM s LEFT JOIN v_bars b ON b.symbol = s.symbol AND b.open_time = s.open_time)
SELECT symbol, open_time, round(coalesce(open, prior), 6) AS open, round(coalesce(high, prior), 6) AS high, round(coalesce(low, prior), 6) AS low, round(coalesce(close, prior), 6) AS close,
  round(coalesce(volume, 0), 6) AS volume, round(coalesce(quote_volume, 0), 6) AS quote_volume, coalesce(trade_count, 0) AS trade_count, round(coalesce(buy_volume, 0), 6) AS buy_volume, round(coalesce(buy_quote_volume, 0), 6) AS buy_quote_volume FROM h WHERE prior IS NOT NULL""",
    ),
    "R04_tape_buckets": (
        lambda s, d: bars.tape_buckets(views.trades(s, d), HOUR),
        V
        + FLOW
        + """round(sum(CASE WHEN NOT buyer_is_maker THEN qty ELSE 0 END), 6) AS buy_qty, round(sum(CASE WHEN buyer_is_maker THEN qty ELSE 0 END), 6) AS sell_qty,
  round(sum(CASE WHEN NOT buyer_is_maker THEN price * qty ELSE 0 END), 6) AS buy_notional, round(sum(CASE WHEN buyer_is_maker THEN price * qty ELSE 0 END), 6) AS sell_notional,
  count(*) FILTER (NOT buyer_is_maker) AS buys, count(*) FILTER (buyer_is_maker) AS sells, round(max(price * qty), 6) AS max_notional, round(arg_min(price, (t, id)), 6) AS first_price, round(arg_max(price, (t, id)), 6) AS last_price FROM v_trades GROUP BY 1, 2""",
    ),
    "R05_dense_flow": (
        lambda s, d: bars.dense_flow(views.trades(s, d), HOUR).withColumn("squared_quote", F.col("squared_quote") / 1e6),
        DENSE
        + f""", f AS ({FLOW}sum(CASE WHEN NOT buyer_is_maker THEN price * qty ELSE 0 END) AS bq, sum(CASE WHEN buyer_is_maker THEN price * qty ELSE 0 END) AS sq, count(*) AS aggregates, sum(last_id - first_id + 1)::BIGINT AS constituents,
  max(price * qty) AS mq, sum(price * qty * (price * qty)) AS qq, max(t) AS lt FROM v_trades GROUP BY 1, 2)
SELECT d.symbol, d.open_time, round(d.open, 6) AS open, round(d.high, 6) AS high, round(d.low, 6) AS low, round(d.close, 6) AS close, round(coalesce(bq, 0), 6) AS buy_quote, round(coalesce(sq, 0), 6) AS sell_quote, coalesce(aggregates, 0) AS aggregates, coalesce(constituents, 0) AS constituents, round(coalesce(mq, 0), 6) AS max_quote,
  round(coalesce(qq, 0) / 1e6, 6) AS squared_quote, d.open_time + 3600000 - last_value(lt IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS age
FROM dense d LEFT JOIN f ON f.symbol = d.symbol AND f.open_time = d.open_time""",
    ),
    "R07_quote_path": (
        lambda s, d: bars.quote_path(views.quotes(s, d), HOUR),
        V
        + """SELECT symbol, event_ms // 3600000 * 3600000 AS open_time, round(min(bid), 6) AS min_bid, round(max(bid), 6) AS max_bid, round(arg_max(bid, (event_ms, update_id)), 6) AS last_bid,
  round(min(ask), 6) AS min_ask, round(max(ask), 6) AS max_ask, round(arg_max(ask, (event_ms, update_id)), 6) AS last_ask, max(txn_ms) AS last_txn_ms FROM v_quotes GROUP BY 1, 2""",
    ),
    "R08_bars_across_files": (
        lambda s, d: bars.bars_across_files(views.trades(s, d).withColumn("file", F.col("id") % 3), "file", HOUR),
        V + FLOW + "round(arg_min(price, (t, id)), 6) AS open, round(arg_max(price, (t, id)), 6) AS close, count(*) AS trades, count(DISTINCT id % 3) AS files FROM v_trades GROUP BY 1, 2",
    ),
    "R11_depth_pivot": (
        depth,
        V
        + "SELECT symbol, id, "
        + ", ".join(f"round(qty * {b}, 6) AS bid_{b}, round(qty * {b} + 1, 6) AS ask_{b}, round(qty * {b} * price, 6) AS bid_notional_{b}, round((qty * {b} + 1) * price, 6) AS ask_notional_{b}, round((qty * {b} - (qty * {b} + 1)) / (qty * {b} + (qty * {b} + 1)), 6) AS imbalance_{b}" for b in (1, 3, 5))
        + " FROM v_trades",
    ),
    "R13_liquidity_bucket": (
        lambda s, d: views.trades(s, d).groupBy("symbol", *bars.liquidity_bucket("t", 15)).agg(F.count("*").alias("n"), F.sum("qty").alias("qty")),
        V + f"SELECT symbol, (t // {DAY} + 3) % 7 AS weekday, t // {HOUR} % 24 AS hour, t % {HOUR} // 900000 AS part, count(*) AS n, round(sum(qty), 6) AS qty FROM v_trades GROUP BY ALL",
    ),
    "J03_asof_lags": (
        lambda s, d: asof.asof_lags(views.requests(s, d), views.trades(s, d).select("symbol", "t", "id", "price"), [HOUR, 6 * HOUR, DAY], "price"),
        V
        + f""", q AS (SELECT r.id, r.symbol, l, r.t - l AS at FROM v_requests r, (VALUES ({HOUR}), ({6 * HOUR}), ({DAY})) v(l)),
m AS (SELECT q.id, q.symbol, q.l, x.price FROM q ASOF LEFT JOIN v_trades x ON x.symbol = q.symbol AND q.at >= x.t)
SELECT id, symbol, """
        + ", ".join(f"round(max(price) FILTER (l = {k}), 6) AS price_{k}" for k in (HOUR, 6 * HOUR, DAY))
        + " FROM m GROUP BY 1, 2",
    ),
    "J05_next_row": (
        lambda s, d: asof.next_row_join(hourly(s, d).select("symbol", "open_time", "close"), HOUR),
        V + f"SELECT a.symbol, a.open_time, round(a.close, 6) AS close, round(b.close, 6) AS next_close FROM v_bars a JOIN v_bars b ON a.symbol = b.symbol AND b.open_time = a.open_time + {HOUR}",
    ),
    "J06_interval_sum": (
        lambda s, d: asof.interval_sum(hourly(s, d).select("symbol", "open_time", (F.col("open_time") + DAY).alias("exit")), funding(s, d), "open_time", "exit", "rate").withColumn("between", F.col("between") + TIE),
        FUNDING + f" SELECT b.symbol, b.open_time, b.open_time + {DAY} AS exit, round(coalesce(sum(rate), 0) + 1e-9, 6) AS between FROM v_bars b LEFT JOIN f ON f.symbol = b.symbol AND f.t > b.open_time AND f.t <= b.open_time + {DAY} GROUP BY ALL".replace("AS between", 'AS "between"'),
    ),
    "J08_asof_forward": (
        lambda s, d: asof.asof_forward(views.requests(s, d).withColumn("later", F.col("t") + 3_600_000), views.quotes(s, d).select("symbol", "event_ms", "update_id", "bid"), "symbol", "later", "event_ms", "update_id", max_age=1_800_000),
        V + "SELECT r.id, r.symbol, r.t, r.t + 3600000 AS later, CASE WHEN q.event_ms - r.t <= 5400000 THEN q.event_ms END AS r_event_ms, CASE WHEN q.event_ms - r.t <= 5400000 THEN q.update_id END AS r_update_id, CASE WHEN q.event_ms - r.t <= 5400000 THEN round(q.bid, 6) END AS r_bid FROM v_requests r ASOF LEFT JOIN v_quotes q ON r.symbol = q.symbol AND r.t + 3600000 <= q.event_ms",
    ),
    "J09_anchor_vectors": (
        lambda s, d: views.trades(s, d).select("symbol", "id", "t").join(views.quotes(s, d).select("symbol", F.col("update_id").alias("id"), F.col("event_ms").alias("t"), "bid", "ask"), ["symbol", "id", "t"]),
        V + "SELECT symbol, id, t, round(bid, 6) AS bid, round(ask, 6) AS ask FROM v_trades JOIN v_quotes ON v_quotes.symbol = v_trades.symbol AND update_id = id AND event_ms = t".replace("SELECT symbol", "SELECT v_trades.symbol"),
    ),
    "J10_common_timestamps": (
        lambda s, d: asof.common_timestamps(bars.trade_bars(views.trades(s, d), DAY).select("symbol", "open_time", "close")),
        V + f", b AS (SELECT symbol, t // {DAY} * {DAY} AS open_time, arg_max(price, (t, id)) AS close FROM v_trades GROUP BY 1, 2) SELECT symbol, open_time, round(close, 6) AS close FROM b WHERE open_time IN (SELECT open_time FROM b GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM b))",
    ),
    "J11_causal_left_join": (
        lambda s, d: asof.causal_left_join(hourly(s, d).select("symbol", "open_time", "close"), funding(s, d).select("symbol", F.col("t").alias("open_time"), "rate"), ["symbol", "open_time"]),
        FUNDING + " SELECT b.symbol, b.open_time, round(close, 6) AS close, round(rate, 6) AS rate, rate IS NOT NULL AS available FROM v_bars b LEFT JOIN f ON f.symbol = b.symbol AND f.t = b.open_time",
    ),
    "J13_current_view": (
        lambda s, d: asof.current_view(views.trades(s, d).withColumn("day", F.floor(F.col("t") / DAY)), views.trades(s, d).groupBy(F.floor(F.col("t") / DAY).alias("day")).agg((F.max("id") % 2 == 0).alias("is_current")), ["day"]).select("id", "day"),
        V + f"SELECT id, t // {DAY} AS day FROM v_trades WHERE t // {DAY} IN (SELECT t // {DAY} FROM v_trades GROUP BY 1 HAVING max(id) % 2 = 0)",
    ),
    "J14_redundant_pairing": (
        lambda s, d: asof.redundant_pairing(lanes(s, d), 2000),
        V
        + """, t AS (SELECT id, t, symbol || '|' || (id % 50)::VARCHAR AS message FROM v_trades), l AS (SELECT message, t AS received, 'a' AS lane FROM t UNION ALL SELECT message, t + id % 3000, 'b' FROM t WHERE id % 11 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY message, lane ORDER BY received)::INT AS k FROM l), p AS (SELECT coalesce(x.message, y.message) AS message, coalesce(x.k, y.k) AS k, x.received AS a, y.received AS b, coalesce(abs(x.received - y.received) <= 2000, false) AS paired
  FROM (FROM k WHERE lane = 'a') x FULL JOIN (FROM k WHERE lane = 'b') y ON x.message = y.message AND x.k = y.k)
SELECT message, k, least(a, b) AS received, paired, abs(a - b) AS lane_gap FROM p WHERE paired UNION ALL SELECT message, k, a, paired, NULL FROM p WHERE NOT paired AND a IS NOT NULL UNION ALL SELECT message, k, b, paired, NULL FROM p WHERE NOT paired AND b IS NOT NULL""",
    ),
    "J15_scenarios": (
        lambda s, d: asof.scenarios(views.closed_trades(s, d).select("id", "symbol", "pnl"), [("base", 1.0), ("stress", 25.0)]).groupBy("symbol", "scenario").agg(F.sum(F.col("pnl") - F.col("cost")).alias("net"), F.count("*").alias("n")),
        V + "SELECT symbol, scenario, round(sum(pnl - cost), 6) AS net, count(*) AS n FROM v_closed, (VALUES ('base', 1.0::DOUBLE), ('stress', 25.0::DOUBLE)) v(scenario, cost) GROUP BY 1, 2",
    ),
    "J16_first_passage": (
        passage,
        V
        + f""", l AS (SELECT *, symbol || '|' || floor(price / 100)::BIGINT::VARCHAR AS level FROM v_trades), o AS (SELECT id, level, t + 750 AS t FROM l),
c AS (SELECT o.id, x.t AS at, sum(x.qty) OVER (PARTITION BY o.id ORDER BY x.t, x.id) AS s FROM o JOIN l x ON x.level = o.level AND x.t > o.t AND x.t <= o.t + {2 * DAY})
SELECT o.id, o.t, min(c.at) FILTER (c.s >= 40) AS filled FROM o LEFT JOIN c ON c.id = o.id GROUP BY 1, 2""",
    ),
    "F15_funding_features": (
        lambda s, d: features.funding_features(hourly(s, d).select("symbol", "open_time"), funding(s, d).select("symbol", "t", "id", "rate")),
        FUNDING
        + f""", g AS (SELECT symbol, t, rate, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS "interval", CASE WHEN count(*) OVER w = 30 THEN avg(rate) OVER w END AS mean30, CASE WHEN count(*) OVER w = 30 THEN CASE WHEN stddev_pop(rate) OVER w > 1e-12 THEN (rate - avg(rate) OVER w) / stddev_pop(rate) OVER w ELSE 0 END END AS z30
  FROM f WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
a AS (SELECT b.symbol, b.open_time, g.rate, "interval", b.open_time - g.t AS age, mean30, z30 FROM v_bars b ASOF LEFT JOIN g ON g.symbol = b.symbol AND b.open_time >= g.t)
SELECT a.symbol, a.open_time, round(any_value(a.rate), 6) AS rate, any_value(a."interval") AS "interval", any_value(a.age) AS age, round(any_value(mean30), 6) AS mean30, round(any_value(z30), 6) AS z30,
  {', '.join(f'round(coalesce(sum(f.rate) FILTER (f.t > a.open_time - {k * HOUR}), 0) + 1e-9, 6) AS sum_{k}' for k in (24, 72, 168))}
FROM a LEFT JOIN f ON f.symbol = a.symbol AND f.t <= a.open_time AND f.t > a.open_time - {168 * HOUR} GROUP BY 1, 2""",
    ),
}
