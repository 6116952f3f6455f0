"""Queries of windows, paths, fills and paired quotes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import continuity, pairs, paths, survival
from tidemark.operators.features import fee
from tidemark.plans.base import DAY, HOUR, Query, V
from tidemark.plans.joins import passage
from tidemark.sources import views

KINDS = ["book", "trade", "quote", "index"]
EDGES = [HOUR, 6 * HOUR, DAY, 2 * DAY]


def _lines(df: DataFrame, column: str = "reasons") -> DataFrame:
    return df.withColumn(column, F.concat_ws(";", column))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event on one of four lines, whose connections change every 40 hours, each line at its own time."""
    lane = F.col("id") % 4
    stream = F.when(lane < 2, "book").when(lane == 2, "spot").otherwise("index")
    kind = F.when(lane < 2, "book").when(lane == 3, "index").when(F.col("buyer_is_maker"), "trade").otherwise("quote")
    block = F.floor((F.col("t") + F.length(stream) * 5 * HOUR) / (40 * HOUR))
    return views.trades(spark, sf_dir).select(
        "id", stream.alias("stream"), F.col("symbol").alias("asset"), F.when(lane == 0, "up").when(lane == 1, "down").otherwise("").alias("token"),
        kind.alias("kind"), F.concat_ws("-", stream, block.cast("string")).alias("connection"), "t",
    )


def continuity_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 5 hours, one every 6, over all that was received."""
    events = stream_events(spark, sf_dir)
    block = F.floor(F.col("t") / (6 * HOUR)).alias("window_id")
    snapshots = events.groupBy(block, "asset").agg(F.min("t").alias("observed"))
    start = F.col("window_id") * 6 * HOUR
    windows = snapshots.select("window_id").distinct().select("window_id", start.alias("w_start"), (start + 5 * HOUR).alias("w_end"), (start + HOUR).alias("event_start"))
    specs = [("book", "up", ["book"], True), ("book", "down", ["book"], True), ("spot", "", ["trade", "quote"], False), ("index", "", ["index"], False)]
    listed = F.array(*[F.struct(F.lit(s).alias("stream"), F.lit(t).alias("token"), F.array(*map(F.lit, k)).alias("needs"), F.lit(b).alias("baseline")) for s, t, k, b in specs])
    expected = snapshots.select("window_id", "asset", F.inline(listed))
    gaps = events.groupBy("stream", "connection").agg(F.max("t").alias("opened"))
    return _lines(continuity.eligibility(windows, expected, events, gaps, snapshots, KINDS, HOUR))


Q08_SQL = (
    V
    + """, l AS (SELECT id, t, symbol AS asset, CASE WHEN id % 4 < 2 THEN 'book' WHEN id % 4 = 2 THEN 'spot' ELSE 'index' END AS stream, CASE id % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE '' END AS token,
  CASE WHEN id % 4 < 2 THEN 'book' WHEN id % 4 = 3 THEN 'index' WHEN buyer_is_maker THEN 'trade' ELSE 'quote' END AS kind FROM v_trades),
e AS (SELECT *, stream || '-' || ((t + length(stream) * 18000000) // 144000000)::VARCHAR AS connection FROM l),
st AS (SELECT stream, connection, min(t) AS started, max(t) AS opened FROM e GROUP BY 1, 2),
g AS (SELECT stream, opened, (SELECT min(o.started) FROM st o WHERE o.stream = st.stream AND o.started > st.opened) AS resumed FROM st),
sn AS (SELECT t // 21600000 AS window_id, asset, min(t) AS observed FROM e GROUP BY 1, 2),
w AS (SELECT DISTINCT window_id, window_id * 21600000 AS w_start, window_id * 21600000 + 18000000 AS w_end, window_id * 21600000 + 3600000 AS event_start FROM sn),
x AS (SELECT sn.window_id, asset, w_start, w_end, stream, token, needs, baseline FROM sn JOIN w USING (window_id), (VALUES ('book', 'up', ['book'], true), ('book', 'down', ['book'], true), ('spot', '', ['trade', 'quote'], false), ('index', '', ['index'], false)) v(stream, token, needs, baseline)),
ev AS (SELECT x.*, count(e.id) AS n, count(DISTINCT e.connection) AS connections, min(e.connection) AS connection, list(DISTINCT e.kind) AS kinds FROM x LEFT JOIN e ON e.stream = x.stream AND e.asset = x.asset AND e.token = x.token AND e.t >= w_start AND e.t <= w_end GROUP BY ALL),
bs AS (SELECT ev.*, st.started, (SELECT arg_max(e.connection, (e.t, e.id)) FROM e WHERE e.stream = ev.stream AND e.asset = ev.asset AND e.token = ev.token AND e.t <= ev.w_start) AS base FROM ev LEFT JOIN st ON st.stream = ev.stream AND st.connection = ev.connection),
nm AS (SELECT *, stream || ':' || asset || CASE WHEN token <> '' THEN ':' || token ELSE '' END AS name, asset || CASE WHEN token <> '' THEN ':' || token ELSE '' END AS place FROM bs),
r AS (
  SELECT window_id, 'missing:' || stream || ':' || k || ':' || place AS reason FROM (SELECT *, unnest(needs) AS k FROM nm) WHERE NOT list_contains(coalesce(kinds, []), k)
  UNION ALL SELECT window_id, 'missing_window:' || name FROM nm WHERE n = 0
  UNION ALL SELECT window_id, 'segment_count:' || name || ':' || connections::VARCHAR FROM nm WHERE connections <> 1
  UNION ALL SELECT window_id, 'segment_started_after_window:' || name FROM nm WHERE started IS NULL OR started > w_start
  UNION ALL SELECT window_id, 'missing_baseline:' || name FROM nm WHERE baseline AND base IS NULL
  UNION ALL SELECT window_id, 'baseline_segment_mismatch:' || name FROM nm WHERE baseline AND base IS NOT NULL AND base IS DISTINCT FROM connection
  UNION ALL SELECT window_id, 'stream_gap:' || stream || ':' || count(*)::VARCHAR FROM w JOIN g ON opened <= w_end AND (resumed IS NULL OR resumed > w_start) GROUP BY window_id, stream
  UNION ALL SELECT sn.window_id, 'late_or_missing_snapshot:' || asset FROM sn JOIN w USING (window_id) WHERE observed > event_start + 3600000
  UNION ALL SELECT window_id, 'run_started_after_window_start' FROM w WHERE (SELECT min(t) FROM e) > w_start
  UNION ALL SELECT window_id, 'run_ended_before_window_end' FROM w WHERE (SELECT max(t) FROM e) < w_end)
SELECT w.window_id, w_start, w_end, event_start, coalesce(string_agg(DISTINCT reason, ';' ORDER BY reason), '') AS reasons, count(reason) = 0 AS eligible FROM w LEFT JOIN r ON r.window_id = w.window_id GROUP BY 1, 2, 3, 4"""
)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue fills by delay; a third of the orders are pulled after 10 hours."""
    pulled = F.when(F.col("id") % 3 == 0, F.col("t") + 10 * HOUR)
    return survival.fill_panel(passage(spark, sf_dir).withColumn("pulled", pulled).withColumn("half", F.col("id") % 2), "t", "filled", EDGES, "pulled")


FILLS = (
    V
    + f""", l AS (SELECT *, symbol || '|' || floor(price / 100)::BIGINT::VARCHAR AS level FROM v_trades), o AS (SELECT id, level, t + 750 AS t FROM l),
c AS (SELECT o.id, x.t AS at, sum(x.qty) OVER (PARTITION BY o.id ORDER BY x.t, x.id) AS s FROM o JOIN l x ON x.level = o.level AND x.t > o.t AND x.t <= o.t + {2 * DAY}),
f AS (SELECT o.id, o.t, min(c.at) FILTER (c.s >= 40) - o.t AS delay, CASE WHEN o.id % 3 = 0 THEN {10 * HOUR} ELSE {EDGES[-1]} END AS stop FROM o LEFT JOIN c ON c.id = o.id GROUP BY 1, 2),
b AS (SELECT id, t, id % 2 AS half, stop, CASE WHEN delay IS NULL OR delay > stop OR delay > {EDGES[-1]} THEN 0 {' '.join(f'WHEN delay <= {e} THEN {i}' for i, e in enumerate(EDGES, 1))} END AS bucket FROM f),
p AS (SELECT *, CASE WHEN bucket > 0 THEN bucket ELSE {' + '.join(f'(stop >= {e})::INT' for e in EDGES)} END AS watched FROM b)"""
)


def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 6 hours that open at every 20th trade, seen a few hours later; some ticks come late."""
    t = views.trades(spark, sf_dir)
    markets = t.where("id % 20 = 0").select(F.col("id").alias("market_id"), "symbol", F.col("t").alias("start"), (F.col("t") + 6 * HOUR).alias("end"), (F.col("t") + (3 + F.col("id") % 5) * HOUR).alias("observed"))
    published = F.col("t") + F.col("id") % 50
    ticks = t.select("symbol", "id", F.col("t").alias("source"), published.alias("published"), (published + F.col("id") % 7 * 600_000).alias("received"), "price")
    return _lines(paths.path_features(markets, ticks, 2 * HOUR, 2, 3600.0, HOUR))


F38_SQL = (
    V
    + """, m AS (SELECT id AS market_id, symbol, t AS start, t + 21600000 AS "end", t + (3 + id % 5) * 3600000 AS observed FROM v_trades WHERE id % 20 = 0),
k AS (SELECT symbol, id, t AS source, t + id % 50 AS published, t + id % 50 + id % 7 * 600000 AS received, price FROM v_trades),
j AS (SELECT market_id, k.*, ln(price / lag(price) OVER (PARTITION BY market_id ORDER BY source)) AS r FROM m JOIN k ON k.symbol = m.symbol AND source >= start AND source < "end" AND received <= observed),
a AS (SELECT market_id, count(*) AS n, arg_min(source, source) AS s0, arg_min(price, source) AS p0, max(source) AS s1, arg_max(price, source) AS p1, arg_max(published, source) AS u1, arg_max(received, source) AS r1, sum(abs(r)) AS len, sum(r * r) AS var FROM j GROUP BY 1),
x AS (SELECT m.*, coalesce(n, 0) AS tick_count, coalesce((s1 - s0) / 1000, 0) AS coverage_seconds, CASE WHEN s0 = start THEN p0 END AS opening, p1 AS current, observed - s1 AS source_age, u1 - s1 AS publish_delay, r1 - u1 AS receipt_delay, len, var FROM m LEFT JOIN a USING (market_id)),
y AS (SELECT *, concat_ws(';', CASE WHEN NOT (observed >= start AND observed < "end") THEN 'market_window_not_live' END, CASE WHEN opening IS NULL THEN 'exact_opening_missing' END, CASE WHEN tick_count = 0 THEN 'no_causal_ticks' END,
  CASE WHEN tick_count > 0 AND (source_age < 0 OR source_age > 7200000) THEN 'current_stale_or_future' END, CASE WHEN tick_count - 1 < 2 THEN 'insufficient_return_count' END, CASE WHEN coverage_seconds < 3600 THEN 'insufficient_time_coverage' END) AS reasons FROM x)
SELECT market_id, symbol, observed, reasons = '' AS available, greatest(0, ("end" - observed) / 1000) AS remaining_seconds, tick_count, round(coverage_seconds, 6) AS coverage_seconds, round(opening, 6) AS opening, round(current, 6) AS current,
  CASE WHEN reasons = '' THEN round(ln(current / opening), 6) END AS log_distance, CASE WHEN reasons = '' THEN round(var / coverage_seconds, 6) END AS variance_rate, CASE WHEN reasons = '' THEN round(CASE WHEN len = 0 THEN 0 ELSE least(1, abs(ln(current / opening)) / len) END, 6) END AS efficiency,
  source_age, publish_delay, receipt_delay, reasons FROM y"""
)


def outcome_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each event as a quote of one outcome of its symbol's day, and the days as segments."""
    t = views.trades(spark, sf_dir)
    ask, bid = (30 + F.col("id") * 7 % 23) / 100, (24 + F.col("id") * 11 % 29) / 100
    key = F.concat_ws("|", "symbol", F.floor(F.col("t") / DAY).cast("string"))
    one = F.lit(5.0)
    quotes = t.select(
        key.alias("key"), F.when(F.col("buyer_is_maker"), "up").otherwise("down").alias("outcome"), "t", (F.col("t") + F.col("id") % 3).alias("wall"), "id",
        F.when(F.col("id") % 13 == 0, (94 + F.col("id") % 6) / 100).otherwise(ask).alias("ask"),
        F.when(F.col("qty") >= 5, ask + fee(ask, one, 0.05) / 5).alias("buy"), F.when(F.col("qty") >= 5, bid + 0.2 - fee(bid, one, 0.05) / 5).alias("sell"),
    )
    day = t.select(key.alias("key"), (F.floor(F.col("t") / DAY) * DAY).alias("__d")).distinct()
    segments = day.select("key", F.col("__d").alias("seg_start"), (F.col("__d") + 23 * HOUR).alias("seg_end"), (F.col("__d") + 22 * HOUR).alias("market_end"), F.lit(1800_000).cast("long").alias("delay"))
    return quotes, segments


def mechanics(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes, segments = outcome_quotes(spark, sf_dir)
    return pairs.episode_survivors(pairs.paired_quotes(quotes, segments, 3 * HOUR), segments)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes, segments = outcome_quotes(spark, sf_dir)
    return pairs.candidate_counts(pairs.paired_quotes(quotes, segments, 3 * HOUR), F.col("key"))


def _fee_sql(p: str) -> str:
    raw = f"(5.0::DOUBLE * 0.05::DOUBLE * ({p} * (1 - {p})))"
    return f"(CASE WHEN {raw} < 1e-5::DOUBLE THEN 0 ELSE ceil(round({raw} * 1e5::DOUBLE, 6)) / 1e5::DOUBLE END)"


PAIRED = (
    V
    + f""", a AS (SELECT *, (30 + id * 7 % 23) / 100.0::DOUBLE AS ap, (24 + id * 11 % 29) / 100.0::DOUBLE AS bp FROM v_trades),
q AS (SELECT symbol || '|' || (t // 86400000)::VARCHAR AS key, buyer_is_maker AS up, t, t + id % 3 AS wall, id, CASE WHEN id % 13 = 0 THEN (94 + id % 6) / 100.0::DOUBLE ELSE ap END AS ask,
  CASE WHEN qty >= 5 THEN ap + {_fee_sql('ap')} / 5 END AS buy, CASE WHEN qty >= 5 THEN bp + 0.2::DOUBLE - {_fee_sql('bp')} / 5 END AS sell FROM a),
sg AS (SELECT DISTINCT key, t // 86400000 * 86400000 AS d FROM q),
tm AS (SELECT DISTINCT key, t FROM q),
u AS (SELECT tm.*, x.t AS ut, x.wall AS uw, x.ask AS ua, x.buy AS ub, x.sell AS us FROM tm ASOF JOIN (SELECT * FROM q WHERE up QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY id DESC) = 1) x ON x.key = tm.key AND tm.t >= x.t),
s0 AS (SELECT u.key, u.t, greatest(uw, x.wall) AS wall, ua, x.ask AS da, ub, x.buy AS db, ub + x.buy AS cost, us + x.sell AS value, ut - x.t AS gap FROM u ASOF JOIN (SELECT * FROM q WHERE NOT up QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY id DESC) = 1) x ON x.key = u.key AND u.t >= x.t),
s AS (SELECT s0.*, d + 82800000 AS seg_end, d + 79200000 AS market_end FROM s0 JOIN sg ON sg.key = s0.key WHERE abs(gap) <= 10800000 AND wall >= d AND wall <= d + 82800000)"""
)

QUERIES: dict[str, tuple[Query, str]] = {
    "Q08_continuity_eligibility": (continuity_eligibility, Q08_SQL),
    "T13_fill_panel": (lambda s, d: fills(s, d).select("id", "t", "bucket", "watched"), FILLS + " SELECT id, t, bucket, watched FROM p"),
    "T13_hazard_risk_set": (
        lambda s, d: survival.hazard_risk_set(fills(s, d), 1).select("id", "label"),
        FILLS + " SELECT id, (bucket = 2)::INT AS label FROM p WHERE watched > 1",
    ),
    "T13_hazards": (
        lambda s, d: survival.hazards(fills(s, d), ["half"]),
        FILLS
        + """, r AS (SELECT half, unnest(generate_series(1, watched)) AS "interval", bucket FROM p), h AS (SELECT half, "interval"::INT AS "interval", count(*) AS at_risk, sum((bucket = "interval")::INT)::BIGINT AS events FROM r GROUP BY 1, 2)
SELECT half, "interval", at_risk, events, round(events / at_risk, 6) AS hazard, round(product(1 - events / at_risk) OVER (PARTITION BY half ORDER BY "interval"), 6) AS survival FROM h""",
    ),
    "F38_twap_path_features": (path_features, F38_SQL),
    "E62_candidate_counts": (
        candidates,
        PAIRED
        + """, k AS (SELECT key, unnest([CASE WHEN ua BETWEEN 0.01 AND 0.05 OR ua BETWEEN 0.95 AND 0.99 OR da BETWEEN 0.01 AND 0.05 OR da BETWEEN 0.95 AND 0.99 THEN 'extreme_settlement_value' END,
  CASE WHEN market_end - wall BETWEEN 5000 AND 60000 AND (ua BETWEEN 0.95 AND 0.99 OR da BETWEEN 0.95 AND 0.99) THEN 'late_strong_favourite' END, CASE WHEN cost < 1 THEN 'complete_set_after_fee' END, CASE WHEN value > 1 THEN 'split_sell_after_fee' END]) AS kind FROM s)
SELECT v.kind, count(k.key) AS states, count(DISTINCT k.key) AS markets FROM (VALUES ('extreme_settlement_value'), ('late_strong_favourite'), ('complete_set_after_fee'), ('split_sell_after_fee')) v(kind) LEFT JOIN k ON k.kind = v.kind GROUP BY 1""",
    ),
    "E62_paired_quote_mechanics": (
        mechanics,
        PAIRED
        + """, fl AS (SELECT *, coalesce(cost < 1, false) AS active FROM s), ed AS (SELECT *, lag(active) OVER (PARTITION BY key ORDER BY t) AS before FROM fl),
b AS (SELECT key, t, wall, seg_end, market_end, cost, t + 1800000 AS t1, t + 3600000 AS t2 FROM ed WHERE active AND NOT coalesce(before, false)),
d1 AS (SELECT b.*, CASE WHEN wall + 1800000 <= b.seg_end AND b.wall + 1800000 < b.market_end THEN x.cost END AS c1, CASE WHEN b.wall + 1800000 <= b.seg_end AND b.wall + 1800000 < b.market_end THEN x.ub END AS ub1, CASE WHEN b.wall + 1800000 <= b.seg_end AND b.wall + 1800000 < b.market_end THEN x.db END AS db1 FROM b ASOF LEFT JOIN s x ON x.key = b.key AND b.t1 >= x.t),
d2 AS (SELECT y.*, CASE WHEN y.wall + 3600000 <= y.seg_end AND y.wall + 3600000 < y.market_end THEN x.ub END AS ub2, CASE WHEN y.wall + 3600000 <= y.seg_end AND y.wall + 3600000 < y.market_end THEN x.db END AS db2 FROM d1 y ASOF LEFT JOIN s x ON x.key = y.key AND y.t2 >= x.t),
z AS (SELECT *, least(ub1 + db2, db1 + ub2) AS sq FROM d2)
SELECT sg.key, count(z.t) AS episodes, count(*) FILTER (c1 < 1) AS delay_survivors, count(*) FILTER (sq < 1) AS sequential_survivors, round(min(cost), 6) AS best_cost, round(min(c1), 6) AS best_delay_cost, round(min(sq), 6) AS best_sequential_cost FROM sg LEFT JOIN z ON z.key = sg.key GROUP BY 1""".replace("CASE WHEN wall +", "CASE WHEN b.wall +"),
    ),
}
