"""Queries of sources and data quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, models, quality
from tidemark.plans.base import BY, DAY, HOUR, Query, V
from tidemark.plans.joins import FUNDING, funding
from tidemark.sources import frames, views

NOW = 1_705_500_000_000


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as JSON frames; every 7th torn, every 11th a mark price, every 13th a liquidation, every 3rd a quote, every 5th without a quantity."""
    t = views.trades(spark, sf_dir)
    trade = F.to_json(F.struct(F.lit("trade").alias("e"), F.col("t").alias("E"), F.col("symbol").alias("s"), F.col("price").alias("p"), F.when(F.col("id") % 5 != 0, F.col("qty")).alias("q")))
    quote = F.to_json(F.struct(F.lit("bookTicker").alias("e"), F.col("t").alias("E"), F.col("symbol").alias("s"), F.col("price").alias("b"), (F.col("price") + 1).alias("a")))
    mark = F.to_json(F.struct(F.lit("markPriceUpdate").alias("e"), F.col("t").alias("E"), F.col("symbol").alias("s"), F.col("price").alias("p"), (F.col("price") - 1).alias("i"), (F.col("qty") / 100).alias("r")))
    forced = F.to_json(F.struct(F.lit("forceOrder").alias("e"), F.col("t").alias("E"), F.struct(F.col("symbol").alias("s"), F.when(F.col("buyer_is_maker"), "SELL").otherwise("BUY").alias("S"), F.when(F.col("id") % 5 != 0, F.col("qty")).alias("q"), F.col("price").alias("p")).alias("o")))
    return t.select("id", F.when(F.col("id") % 7 == 0, "{torn").when(F.col("id") % 11 == 0, mark).when(F.col("id") % 13 == 0, forced).when(F.col("id") % 3 == 0, quote).otherwise(trade).alias("raw_text"))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade as a candle of its hour, some of them broken."""
    low = F.when(F.col("id") % 9 == 0, F.col("price") + 1).otherwise(F.col("price") - 1)
    return views.trades(spark, sf_dir).select("symbol", bars.bucket("t", HOUR).alias("open_time"), "id", F.col("price").alias("open"), (F.col("price") + 2).alias("high"), low.alias("low"), F.col("price").alias("close"), F.col("qty").alias("volume"))


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candles by source, some with volumes that are no numbers, infinite or below 0, some that come in late."""
    odd = F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, float("inf")).when(F.col("id") % 17 == 0, -1.0).otherwise(F.col("volume"))
    late = F.when(F.col("id") % 19 == 0, F.col("open_time") - 3 * HOUR).otherwise(F.col("open_time"))
    return candles(spark, sf_dir).withColumns({"volume": odd, "open_time": late, "source": F.when(F.col("id") % 3 == 0, "archive").otherwise("live")})


def archives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = views.trades(spark, sf_dir).select("id", F.floor(F.col("t") / DAY).alias("archive"))
    manifest = t.select("archive").distinct().withColumn("status", F.when(F.col("archive") % 3 == 0, "partial").otherwise("verified"))
    return t.where("archive % 4 = 0"), t, manifest



def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' manifest against stated digests, of which some are wrong and some are not there."""
    m = frames.ingest_manifest(views.trades(spark, sf_dir).select(F.floor(F.col("t") / DAY).alias("archive"), "id", "symbol", "t"), "archive", "t")
    stated = m.where("archive % 3 != 0").select("archive", F.when(F.col("archive") % 3 == 2, "0").otherwise(F.col("digest")).alias("digest"))
    return frames.checked_manifest(m, stated, "archive")


def checks():
    return {"wrong_price": F.col("price").between(120, 580), "odd_qty": F.col("qty") >= 5, "no_maker": F.col("buyer_is_maker").isNotNull()}


QUERIES: dict[str, tuple[Query, str]] = {
    "B02_level_changes": (
        lambda s, d: models.level_changes(views.quotes(s, d).select("symbol", F.lit("bid").alias("side"), (F.round(F.col("bid") / 10) * 10).alias("price"), "update_id", F.col("bid_qty").alias("qty"))),
        V
        + """, l AS (SELECT symbol, 'bid' AS side, round(bid / 10) * 10 AS price, update_id, bid_qty AS qty FROM v_quotes), c AS (SELECT *, qty - coalesce(lag(qty) OVER (PARTITION BY symbol, price ORDER BY update_id), 0) AS d FROM l)
SELECT symbol, side, price, update_id, greatest(d, 0) AS added, greatest(-d, 0) AS removed, greatest(d, 0) * price AS added_quote, greatest(-d, 0) * price AS removed_quote FROM c""",
    ),
    "F51_stress_state": (
        lambda s, d: models.stress_state(views.trades(s, d).select("id", "price", "qty"), models.stress_bounds(views.trades(s, d).where("id % 2 = 0"), ["price", "qty"]), ["price", "qty"]).select("id", "state"),
        V + ", b AS (SELECT quantile_cont(price, 2 / 3.0::DOUBLE) AS a, quantile_cont(qty, 2 / 3.0::DOUBLE) AS c FROM v_trades WHERE id % 2 = 0) SELECT id, (price > a)::INT + (qty > c)::INT AS state FROM v_trades, b",
    ),
    "S06_funding_checks": (
        lambda s, d: frames.funding_checks(funding(s, d), HOUR, 24 * HOUR).select("symbol", "t", "interval", "valid"),
        FUNDING + f' SELECT symbol, t, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS "interval", coalesce(t - lag(t) OVER (PARTITION BY symbol ORDER BY t) BETWEEN {HOUR} AND {24 * HOUR}, true) AS valid FROM f',
    ),
    "S07_prune_periods": (
        lambda s, d: frames.prune_periods(views.trades(s, d).select("id", F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd").alias("period")), NOW - 10 * DAY, NOW),
        V + f"SELECT id, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS period FROM v_trades WHERE t // {DAY} * {DAY} <= {NOW} AND (t // {DAY} + 1) * {DAY} > {NOW - 10 * DAY}",
    ),
    "S08_ingest_manifest": (
        manifest,
        V
        + f""", m AS (SELECT t // {DAY} AS archive, count(*) AS rows_read, min(t) AS first_ms, max(t) AS last_ms, sum(('0x' || substr(sha256(id::VARCHAR || '|' || symbol || '|' || t::VARCHAR), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM v_trades GROUP BY 1)
SELECT *, CASE archive % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'verified' ELSE 'mismatch' END AS checksum_status FROM m""",
    ),
    "S10_merge_verified": (lambda s, d: frames.merge_verified(*archives(s, d), "archive", "id"), V + f", a AS (SELECT id, t // {DAY} AS archive FROM v_trades) SELECT id, archive FROM a WHERE archive % 4 = 0 OR archive % 3 <> 0"),
    "S10_merge_manifest": (
        lambda s, d: frames.merge_manifest(archives(s, d)[2].where("archive % 4 = 0"), archives(s, d)[2], "archive"),
        V + f", a AS (SELECT DISTINCT t // {DAY} AS archive FROM v_trades) SELECT archive, CASE WHEN archive % 3 = 0 THEN 'partial' ELSE 'verified' END AS status FROM a WHERE archive % 4 = 0 OR archive % 3 <> 0",
    ),
    "S12_content_store": (lambda s, d: frames.content_store(views.observations(s, d), "payload"), V + "SELECT sha256(payload) AS payload_hash, payload, count(*) AS uses FROM v_obs GROUP BY ALL"),
    "S13_prune_retention": (
        lambda s, d: frames.prune_retention(views.observations(s, d).select("id", "observed_at"), "observed_at", "id", NOW - 5 * DAY, 200),
        V + f"SELECT id, observed_at FROM v_obs WHERE observed_at >= {NOW - 5 * DAY} ORDER BY observed_at DESC, id DESC LIMIT 200",
    ),
    "S14_decode_frames": (
        lambda s, d: frames.decode_frames(feed(s, d)).drop("raw_text"),
        V
        + """, k AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'torn' WHEN id % 11 = 0 THEN 'mark' WHEN id % 13 = 0 THEN 'liquidation' WHEN id % 3 = 0 THEN 'quote' ELSE 'trade' END AS f FROM v_trades), g AS (SELECT *, f IN ('quote', 'mark') OR f IN ('trade', 'liquidation') AND id % 5 <> 0 AS good FROM k)
SELECT id, CASE WHEN good THEN f END AS kind, CASE WHEN f <> 'torn' THEN symbol END AS symbol, CASE WHEN f <> 'torn' THEN t END AS event_ms, CASE WHEN f IN ('trade', 'mark', 'liquidation') THEN round(price, 6) END AS price,
  CASE WHEN f IN ('trade', 'liquidation') AND id % 5 <> 0 THEN qty END AS qty, CASE WHEN f = 'quote' THEN round(price, 6) END AS bid, CASE WHEN f = 'quote' THEN round(price + 1, 6) END AS ask, CASE WHEN f = 'mark' THEN round(price - 1, 6) END AS index_price,
  CASE WHEN f = 'mark' THEN round(qty / 100, 6) END AS funding_rate, CASE WHEN f = 'liquidation' THEN CASE WHEN buyer_is_maker THEN 'SELL' ELSE 'BUY' END END AS side, CASE WHEN f = 'torn' THEN 'unknown frame' WHEN NOT good THEN 'bad values' END AS reason FROM g""",
    ),
    "S21_top_of_book": (
        lambda s, d: frames.top_of_book(views.quotes(s, d), NOW, HOUR, 5000.0, 3.0),
        V
        + f""", q AS (SELECT * FROM v_quotes QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY event_ms DESC, update_id DESC) = 1),
m AS (SELECT symbol, event_ms, (ask - bid) / ((bid + ask) / 2) * 10000 AS sp, least(1, (bid * bid_qty + ask * ask_qty) / 5000) AS dp FROM q)
SELECT symbol, event_ms, round(sp, 6) AS spread_bps, round(dp, 6) AS depth_score, round(0.35::DOUBLE * (1 - least(1, sp / 3)) + 0.65::DOUBLE * dp, 6) AS score, {NOW} - event_ms > {HOUR} AS stale FROM m""",
    ),
    "Q01_clean_candles": (
        lambda s, d: quality.clean_candles(candles(s, d), HOUR, NOW, "id"),
        V + f", c AS (SELECT symbol, t // {HOUR} * {HOUR} AS open_time, id, price, qty FROM v_trades WHERE id % 9 <> 0 AND t // {HOUR} * {HOUR} + {HOUR} <= {NOW}) SELECT symbol, open_time, id, round(price, 6) AS open, round(price + 2, 6) AS high, round(price - 1, 6) AS low, round(price, 6) AS close, qty AS volume FROM c QUALIFY row_number() OVER (PARTITION BY symbol, open_time ORDER BY id DESC) = 1",
    ),
    "Q03_series_profile": (
        lambda s, d: quality.series_profile(sourced(s, d), HOUR),
        V
        + f""", g AS (SELECT symbol, id, t // {HOUR} * {HOUR} - CASE WHEN id % 19 = 0 THEN {3 * HOUR} ELSE 0 END AS open_time, CASE WHEN id % 3 = 0 THEN 'archive' ELSE 'live' END AS source FROM v_trades),
h AS (SELECT *, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time, id) AS gap, open_time < lag(open_time) OVER (PARTITION BY symbol ORDER BY id) AS fell FROM g),
c AS (SELECT symbol, source, count(*) AS n FROM g GROUP BY 1, 2)
SELECT symbol, count(*) FILTER (id % 11 = 0 OR id % 13 = 0) AS not_finite, count(*) AS n, count(*) FILTER (gap = 0) AS repeated, count(*) FILTER (gap > {HOUR}) AS gaps, count(*) FILTER (fell) AS regressed, count(*) FILTER (id % 9 = 0) AS bad_prices,
  count(*) FILTER (id % 17 = 0 AND id % 11 <> 0 AND id % 13 <> 0) AS bad_volumes, (SELECT string_agg(source || ':' || n::VARCHAR, ',' ORDER BY source || ':' || n::VARCHAR) FROM c WHERE c.symbol = h.symbol) AS sources FROM h GROUP BY symbol""",
    ),
    "Q04_completeness": (
        lambda s, d: quality.completeness(views.trades(s, d), "t"),
        V + f", e AS (SELECT max(t // {DAY}) - min(t // {DAY}) + 1 AS n FROM v_trades) SELECT symbol, any_value(e.n) AS expected, count(DISTINCT t // {DAY}) AS present, any_value(e.n) - count(DISTINCT t // {DAY}) AS missing FROM v_trades, e GROUP BY 1",
    ),
    "Q06_quality_audit": (
        lambda s, d: quality.quality_audit(views.trades(s, d), "symbol", "id", checks()),
        V
        + """, c AS (SELECT symbol, id, price BETWEEN 120 AND 580 AS a, qty >= 5 AS b FROM v_trades), n AS (SELECT symbol, count(*) FILTER (a AND b) AS accepted, count(*) FILTER (NOT a) AS wrong_price, count(*) FILTER (NOT b) AS odd_qty, 0::BIGINT AS no_maker FROM c GROUP BY 1),
x AS (SELECT symbol, string_agg(id::VARCHAR, ',' ORDER BY id) AS examples FROM (SELECT * FROM c WHERE NOT (a AND b) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY id) <= 3) GROUP BY 1)
SELECT n.*, x.examples FROM n LEFT JOIN x ON x.symbol = n.symbol""",
    ),
    "Q07_feed_coverage": (
        lambda s, d: quality.feed_coverage(views.observations(s, d).where("not (kind like '%e%' and source in ('s3', 's5'))"), "kind", "source"),
        V
        + """, o AS (SELECT * FROM v_obs WHERE NOT (kind LIKE '%e%' AND source IN ('s3', 's5'))), p AS (SELECT * FROM (SELECT DISTINCT kind FROM o), (SELECT DISTINCT source FROM o)), n AS (SELECT kind, source, count(*) AS n FROM o GROUP BY 1, 2)
SELECT p.kind, count(*) AS expected, count(n) AS observed, coalesce(string_agg(p.source, ',' ORDER BY p.source) FILTER (n IS NULL), '') AS absent, sum(n)::BIGINT AS rows FROM p LEFT JOIN n ON n.kind = p.kind AND n.source = p.source GROUP BY 1""",
    ),
    "Q10_reconcile": (
        lambda s, d: quality.reconcile(views.trades(s, d).withColumn("day", F.floor(F.col("t") / DAY)), views.trades(s, d).where("id % 50 != 0").groupBy("symbol", F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("stated")), ["symbol", "day"]),
        V + f"SELECT symbol, t // {DAY} AS day, count(*) AS counted, count(*) FILTER (id % 50 <> 0) AS stated, count(*) = count(*) FILTER (id % 50 <> 0) AS agrees FROM v_trades GROUP BY 1, 2",
    ),
    "Q12_age_audit": (
        lambda s, d: quality.age_audit(asof.asof_quotes(views.requests(s, d), views.quotes(s, d), HOUR), 2 * HOUR),
        V
        + f""", j AS (SELECT r.symbol, r.t - q.event_ms AS age FROM v_requests r ASOF LEFT JOIN v_quotes q ON r.symbol = q.symbol AND r.t >= q.event_ms)
SELECT symbol, count(*) AS n, count(age) AS available, min(age) AS min_age, round(quantile_cont(age, 0.5), 6) AS p50_age, round(quantile_cont(age, 0.99), 6) AS p99_age, max(age) AS max_age, count(*) FILTER (age > {2 * HOUR}) AS breaks FROM j GROUP BY 1""",
    ),
    "Q13_cutoff": (lambda s, d: quality.before_cutoff(views.trades(s, d).select("id", "symbol", "t"), "t", NOW), V + f"SELECT id, symbol, t FROM v_trades WHERE t < {NOW}"),
    "Q13_partitions": (
        lambda s, d: quality.partitions_by_cutoff(views.trades(s, d), "t", NOW),
        V + f"SELECT t // {DAY} AS part, count(*) FILTER (t < {NOW}) AS kept, count(*) FILTER (t >= {NOW}) AS rejected, CASE WHEN max(t) < {NOW} THEN 'frozen' WHEN min(t) >= {NOW} THEN 'prospective' ELSE 'cut' END AS kind FROM v_trades GROUP BY 1",
    ),
    "Q14_support_apply": (
        lambda s, d: quality.support_apply(views.trades(s, d).select("id", "price", "qty"), quality.support_fit(views.trades(s, d).where(F.col("t") < NOW - 8 * DAY), ["price", "qty"], 0.4), ["price", "qty"], 0, 0).select("id", "outside", "extreme", "abstain"),
        V
        + f""", r AS (SELECT price, qty FROM v_trades WHERE t < {NOW - 8 * DAY}), b AS (SELECT min(price) AS pl, max(price) AS ph, quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, min(qty) AS ql, max(qty) AS qh, quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3 FROM r),
k AS (SELECT *, least(pl, p1 - 0.4::DOUBLE * (p3 - p1)) AS pa, greatest(ph, p3 + 0.4::DOUBLE * (p3 - p1)) AS pz, least(ql, q1 - 0.4::DOUBLE * (q3 - q1)) AS qa, greatest(qh, q3 + 0.4::DOUBLE * (q3 - q1)) AS qz FROM b),
o AS (SELECT id, (price < pl OR price > ph)::INT + (qty < ql OR qty > qh)::INT AS outside, (price < pa OR price > pz)::INT + (qty < qa OR qty > qz)::INT AS extreme FROM v_trades, k)
SELECT id, outside, extreme, outside > 0 OR extreme > 0 AS abstain FROM o""",
    ),
}
