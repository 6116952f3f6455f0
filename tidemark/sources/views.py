"""Market views over the star-schema tables: trades, quotes, requests, predictions, closed trades, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        (F.col("value") + 100).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("qty"),
        (F.col("event_id") * 3).alias("first_id"),
        (F.col("event_id") * 3 + F.col("event_id") % 3).alias("last_id"),
        (F.col("user_id") % 2 == 0).alias("buyer_is_maker"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("update_id"),
        F.col("event_type").alias("symbol"),
        t.alias("event_ms"),
        (t - F.col("event_id") % 5).alias("txn_ms"),
        (100 + F.col("value") - 0.01 * (1 + F.col("event_id") % 4)).alias("bid"),
        (100 + F.col("value") + 0.01 * (1 + F.col("event_id") % 3)).alias("ask"),
        (1 + F.col("user_id") % 7).cast("double").alias("bid_qty"),
        (1 + F.col("user_id") % 11).cast("double").alias("ask_qty"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of 20 levels a side, one cent apart, around a middle that moves by ticks."""
    e = read(spark, sf_dir, "events")
    tick = 10_000 + (F.floor("value") % 5) * 2
    i = F.sequence(F.lit(0), F.lit(19))
    return e.select(
        F.col("event_id").alias("update_id"),
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"),
        F.transform(i, lambda k: F.struct(((tick - k) / 100.0).alias("price"), (1.0 + (F.col("event_id") + k) % 9).alias("qty"))).alias("bids"),
        F.transform(i, lambda k: F.struct(((tick + 1 + k) / 100.0).alias("price"), (1.0 + (F.col("event_id") + 2 * k) % 7).alias("qty"))).alias("asks"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request just before every event, so that what it may know is older than the event's own quote."""
    return trades(spark, sf_dir).select("id", "symbol", (F.col("t") - 1).alias("t"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (0.05 + 0.9 * (F.col("o_custkey") % 1000) / 1000).alias("p"),
        (1 + F.col("o_orderkey") % 3).cast("double").alias("weight"),
    )


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_returnflag").alias("symbol"),
        day.alias("entry"),
        (day + F.col("l_linenumber")).cast("long").alias("exit"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"),
    )


def actions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Trades as proposed actions: side, score, when they would end and what they would earn, plainly and under stress; ``more`` columns of the trade."""
    end = F.col("t") + (1 + F.col("id") % 5) * 600_000
    return trades(spark, sf_dir).select(
        "id", "symbol", "t",
        F.when(F.col("buyer_is_maker"), -1).otherwise(1).alias("side"),
        ((F.col("price") - 345) / 100).alias("score"),
        end.alias("end"),
        (end + 300_000).alias("stress_end"),
        ((F.col("id") * 37 % 101 - 48) / 10.0).alias("net"),
        *more,
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("observed_at"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source"),
        ((F.col("value") - 50) / 500).alias("score"),
        F.col("props").alias("payload"),
    )


#: The same views for DuckDB; epoch milliseconds are floored on both sides.
SQL = """
WITH v_trades AS (
  SELECT event_id AS id, event_type AS symbol, epoch_us(ts) // 1000 AS t, value + 100 AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS qty,
    event_id * 3 AS first_id, event_id * 3 + event_id % 3 AS last_id, user_id % 2 = 0 AS buyer_is_maker FROM events),
v_quotes AS (
  SELECT event_id AS update_id, event_type AS symbol, epoch_us(ts) // 1000 AS event_ms, epoch_us(ts) // 1000 - event_id % 5 AS txn_ms,
    100 + value - 0.01::DOUBLE * (1 + event_id % 4) AS bid, 100 + value + 0.01::DOUBLE * (1 + event_id % 3) AS ask,
    (1 + user_id % 7)::DOUBLE AS bid_qty, (1 + user_id % 11)::DOUBLE AS ask_qty FROM events),
v_levels AS (
  SELECT event_id AS update_id, event_type AS symbol, epoch_us(ts) // 1000 AS event_ms, i, side,
    (10000 + floor(value)::BIGINT % 5 * 2 + CASE side WHEN 'bid' THEN -i ELSE 1 + i END) / 100.0::DOUBLE AS price,
    1.0::DOUBLE + CASE side WHEN 'bid' THEN (event_id + i) % 9 ELSE (event_id + 2 * i) % 7 END AS qty
  FROM events, generate_series(0, 19) g(i), (VALUES ('bid'), ('ask')) s(side)),
v_requests AS (SELECT id, symbol, t - 1 AS t FROM v_trades),
v_predictions AS (
  SELECT o_orderkey AS id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS day, (o_orderstatus = 'F')::INT AS y,
    0.05::DOUBLE + 0.9::DOUBLE * (o_custkey % 1000) / 1000 AS p, (1 + o_orderkey % 3)::DOUBLE AS weight FROM orders),
v_closed AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS symbol, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS entry,
    date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT + l_linenumber AS exit, l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl FROM lineitem),
v_actions AS (
  SELECT id, symbol, t, CASE WHEN buyer_is_maker THEN -1 ELSE 1 END AS side, (price - 345) / 100 AS score, t + (1 + id % 5) * 600000 AS "end", t + (1 + id % 5) * 600000 + 300000 AS stress_end,
    (id * 37 % 101 - 48) / 10.0::DOUBLE AS net FROM v_trades),
v_obs AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS observed_at, event_type AS kind, 's' || (user_id % 10)::VARCHAR AS source, (value - 50) / 500 AS score, props AS payload FROM events),
v_bars AS (
  SELECT symbol, (t // 3600000) * 3600000 AS open_time, arg_min(price, (t, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, id)) AS close,
    sum(qty) AS volume, sum(price * qty) AS quote_volume, sum(last_id - first_id + 1)::BIGINT AS trade_count, sum(CASE WHEN NOT buyer_is_maker THEN qty ELSE 0 END) AS buy_volume,
    sum(CASE WHEN NOT buyer_is_maker THEN price * qty ELSE 0 END) AS buy_quote_volume
  FROM v_trades GROUP BY 1, 2)
"""
