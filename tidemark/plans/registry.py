"""Every query of the market operators over the tables, and the SQL it must agree with.

Keys begin with the operator's id in the inventory. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import asof, bars, evaluation, features, quality, ranks
from tidemark.plans import audits, evidence, fitted, flows, joins, micro, orderbooks, outcomes, panel, panels, portfolio, stats, tapes, windows
from tidemark.plans.base import BY, DENSE, HOUR, TIE, Query, V, dense, frame_sql, hourly, rounded, rounds
from tidemark.sources import ingest, views


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, filled, with momentum, spread of means and range, against the next bar's return, by symbol."""
    usable = features.outlook(dense(spark, sf_dir)).where("momentum_10 is not null and sma_spread is not null and atr is not null and target is not null")
    out = usable.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg(F.col("target") ** 2).alias("mse_zero"), F.corr("momentum_1", "target").alias("momentum_corr"),
        F.corr("sma_spread", "target").alias("spread_corr"), F.avg((F.signum("momentum_1") == F.signum("target")).cast("double")).alias("sign_accuracy"), F.avg("atr").alias("mean_atr"),
    )
    return rounded(out)


FLAGSHIP_SQL = (
    DENSE
    + f""", moved AS (SELECT *, close / lag(close, 1) OVER {BY} - 1 AS m1, close / lag(close, 10) OVER {BY} - 1 AS m10, lag(close) OVER {BY} AS before,
    CASE WHEN count(close) OVER {frame_sql(12)} = 12 THEN avg(close) OVER {frame_sql(3)} / avg(close) OVER {frame_sql(12)} - 1 END AS sma,
    ln(lead(open, 2) OVER {BY} / lead(open, 1) OVER {BY}) * 10000 AS target FROM dense),
ranged AS (SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM moved),
atr AS (SELECT *, CASE WHEN count(tr) OVER {frame_sql(14)} = 14 THEN avg(tr) OVER {frame_sql(14)} / close END AS atr FROM ranged)
SELECT symbol, count(*) AS n, round(avg(target ** 2), 6) AS mse_zero, round(corr(m1, target), 6) AS momentum_corr, round(corr(sma, target), 6) AS spread_corr,
  round(avg((sign(m1) = sign(target))::INT::DOUBLE), 6) AS sign_accuracy, round(avg(atr), 6) AS mean_atr
FROM atr WHERE m10 IS NOT NULL AND sma IS NOT NULL AND atr IS NOT NULL AND target IS NOT NULL GROUP BY 1"""
)

def _tied(df: DataFrame) -> DataFrame:
    return df.select("symbol", "open_time", *[(F.col(c) + TIE).alias(c) for c in df.columns[2:]])


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides walked for 85 units, which some books lack."""
    both = views.books(spark, sf_dir).select("update_id", book.walk_detail(F.col("asks"), F.lit(85.0)).alias("a"), book.walk_detail(F.col("bids"), F.lit(85.0)).alias("b"), book.imbalance(F.col("bids"), F.col("asks"), 5).alias("imbalance"))
    named = [F.col(f"{s}.{k}").alias(n) for s, way in (("a", "buy"), ("b", "sell")) for k, n in (("price", way), ("worst", f"{way}_worst"), ("used", f"{way}_levels"))]
    return both.select("update_id", *named, "imbalance")


#: name -> (query, SQL)
_ALL: dict[str, tuple[Query, str]] = audits.QUERIES | evidence.QUERIES | fitted.QUERIES | flows.QUERIES | joins.QUERIES | micro.QUERIES | orderbooks.QUERIES | outcomes.QUERIES | panel.QUERIES | panels.QUERIES | portfolio.QUERIES | stats.QUERIES | tapes.QUERIES | windows.QUERIES | {
    "flagship": (flagship, FLAGSHIP_SQL),
    "R01_trade_bars": (hourly, V + "SELECT symbol, open_time, " + rounds("open", "high", "low", "close", "volume", "quote_volume", "buy_volume", "buy_quote_volume") + ", trade_count FROM v_bars"),
    "R02_fill_bars": (dense, DENSE + "SELECT symbol, open_time, " + rounds("open", "high", "low", "close", "volume", "quote_volume", "buy_volume", "buy_quote_volume") + ", trade_count FROM dense"),
    "R06_quote_bars": (
        lambda s, d: bars.quote_bars(views.quotes(s, d), HOUR),
        V
        + f""", q AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) * 10000 AS spread, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS imbalance, event_ms - txn_ms AS delay, ((ask * bid_qty + bid * ask_qty) / (bid_qty + ask_qty) / ((bid + ask) / 2) - 1) * 10000 AS mp FROM v_quotes)
SELECT symbol, event_ms // 3600000 * 3600000 AS open_time, {', '.join(f'round(arg_max({c}, (event_ms, update_id)), 6) AS close_{c}' for c in ('bid', 'ask', 'bid_qty', 'ask_qty'))}, round(arg_max(mp, (event_ms, update_id)), 6) AS microprice_offset, round(arg_min(mid, (event_ms, update_id)), 6) AS open, round(max(mid), 6) AS high, round(min(mid), 6) AS low, round(arg_max(mid, (event_ms, update_id)), 6) AS close,
  round(avg(spread), 6) AS mean_spread, round(max(spread), 6) AS max_spread, round(avg(imbalance), 6) AS mean_imbalance, round(arg_max(imbalance, (event_ms, update_id)), 6) AS close_imbalance,
  round(quantile_cont(delay, 0.5), 6) AS delay_p50, round(quantile_cont(delay, 0.99), 6) AS delay_p99 FROM q GROUP BY 1, 2""",
    ),
    "R09_rebar": (
        lambda s, d: bars.rebar(dense(s, d), HOUR, 4),
        DENSE + "SELECT symbol, open_time // 14400000 * 14400000 AS open_time, round(arg_min(open, open_time), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, open_time), 6) AS close, round(sum(volume), 6) AS volume FROM dense GROUP BY 1, 2 HAVING count(*) = 4",
    ),
    "R10_clock_spine": (lambda s, d: bars.clock_spine(hourly(s, d), HOUR), DENSE + "SELECT symbol, open_time FROM spine"),
    "R12_calendar_features": (
        lambda s, d: bars.calendar_features(views.trades(s, d).select("id", "t"), "t"),
        V
        + "SELECT id, t, ((t // 86400000 + 3) % 7)::INT AS weekday, (t // 86400000 + 3) % 7 >= 5 AS weekend, "
        + ", ".join(
            f"round(round({wave}(((t + {shift}) % {period}) / {period}.0::DOUBLE * (2 * 3.141592653589793::DOUBLE)), 12) + 0.0::DOUBLE, 6) AS {name}_{wave}"
            for name, period, shift in (("day", 86_400_000, 0), ("eight", 28_800_000, 0), ("week", 604_800_000, 259_200_000), ("minute", 60_000, 0), ("five", 300_000, 0), ("quarter", 900_000, 0))
            for wave in ("sin", "cos")
        )
        + " FROM v_trades",
    ),
    "Q02_coverage_report": (
        lambda s, d: quality.coverage_report(hourly(s, d), HOUR),
        V
        + f""", g AS (SELECT symbol, open_time, open_time - lag(open_time) OVER {BY} AS gap FROM v_bars)
, c AS (SELECT symbol, count(*) AS bars, min(open_time) AS first_time, max(open_time) AS last_time, count(*) FILTER (gap > 5400000) AS gaps, coalesce(max(gap), 0) AS largest_gap,
  round(count(*) / ((max(open_time) - min(open_time)) / 3600000.0::DOUBLE + 1), 6) AS coverage FROM g GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN gaps > 0 THEN 'gaps' END, CASE WHEN coverage < 0.995 THEN 'coverage' END, CASE WHEN last_time > first_time AND last_time - first_time < 31536000000 THEN 'under_a_year' END) AS warnings,
  CASE WHEN gaps > 0 OR coverage < 0.995 THEN 'fail' WHEN last_time > first_time AND last_time - first_time < 31536000000 THEN 'warn' ELSE 'ok' END AS status FROM c""",
    ),
    "Q05_id_sequence_audit": (
        lambda s, d: quality.id_sequence_audit(views.trades(s, d)),
        V
        + """, g AS (SELECT symbol, id = lag(id) OVER w AS dup, t < lag(t) OVER w AS back, first_id - lag(last_id) OVER w - 1 AS gap FROM v_trades WINDOW w AS (PARTITION BY symbol ORDER BY id))
SELECT symbol, count(*) AS n, count(*) FILTER (dup) AS duplicates, count(*) FILTER (back) AS time_regressions, coalesce(sum(greatest(gap, 0)), 0)::BIGINT AS missing_ids FROM g GROUP BY 1""",
    ),
    "Q09_raw_evidence": (lambda s, d: quality.raw_evidence(views.trades(s, d)), V + "SELECT symbol, count(*) AS n, min(t) AS first_t, max(t) AS last_t, min(id) AS first_id, max(id) AS last_id FROM v_trades GROUP BY 1"),
    "Q14_support_bounds": (
        lambda s, d: quality.support_bounds(views.trades(s, d), "price", "symbol"),
        V + "SELECT symbol, round(low, 6) AS low, round(q1, 6) AS q1, round(q3, 6) AS q3, round(high, 6) AS high, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence FROM (SELECT symbol, min(price) AS low, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, max(price) AS high FROM v_trades GROUP BY 1)",
    ),
    "Q15_dedupe_conflicts": (
        lambda s, d: quality.dedupe_conflicts(views.closed_trades(s, d), ["symbol", "entry"], ["exit"]),
        V + "SELECT symbol, entry, count(*) AS n, count(DISTINCT exit) AS contents, count(DISTINCT exit) > 1 AS conflict FROM v_closed GROUP BY 1, 2",
    ),
    "J01_asof_join": (
        lambda s, d: asof.asof_join(views.requests(s, d), views.quotes(s, d).select("symbol", "event_ms", "update_id", "bid", "ask"), "symbol", "t", "event_ms", "update_id"),
        V + "SELECT r.id, r.symbol, r.t, q.event_ms AS r_event_ms, q.update_id AS r_update_id, round(q.bid, 6) AS r_bid, round(q.ask, 6) AS r_ask FROM v_requests r ASOF LEFT JOIN v_quotes q ON r.symbol = q.symbol AND r.t >= q.event_ms",
    ),
    "J02_asof_quotes": (
        lambda s, d: asof.asof_quotes(views.requests(s, d), views.quotes(s, d), 1_800_000).select("id", "symbol", "age", "valid"),
        V + "SELECT r.id, r.symbol, r.t - q.event_ms AS age, coalesce(r.t - q.event_ms BETWEEN 0 AND 1800000 AND bid > 0 AND bid < ask AND bid_qty > 0 AND ask_qty > 0, false) AS valid FROM v_requests r ASOF LEFT JOIN v_quotes q ON r.symbol = q.symbol AND r.t >= q.event_ms",
    ),
    "J04_exact_horizon_join": (
        lambda s, d: asof.exact_horizon_join(hourly(s, d).select("symbol", "open_time", "close"), 2 * HOUR),
        V + "SELECT a.symbol, a.open_time, round(a.close, 6) AS close, round(b.close, 6) AS later_close FROM v_bars a JOIN v_bars b ON a.symbol = b.symbol AND b.open_time = a.open_time + 7200000 WHERE a.open_time // 86400000 = b.open_time // 86400000",
    ),
    "J04_horizon_exclusions": (
        lambda s, d: asof.horizon_exclusions(hourly(s, d), 2 * HOUR),
        V
        + """SELECT a.symbol, count(*) AS rows, count(*) FILTER (b.symbol IS NOT NULL AND a.open_time // 86400000 = (a.open_time + 7200000) // 86400000) AS kept, count(*) FILTER (a.open_time // 86400000 <> (a.open_time + 7200000) // 86400000) AS crosses_day,
  count(*) FILTER (b.symbol IS NULL AND a.open_time // 86400000 = (a.open_time + 7200000) // 86400000) AS no_later_bar FROM v_bars a LEFT JOIN v_bars b ON a.symbol = b.symbol AND b.open_time = a.open_time + 7200000 GROUP BY 1""",
    ),
    "J07_trailing_event_sum": (
        lambda s, d: asof.trailing_event_sum(hourly(s, d).select("symbol", "open_time"), views.trades(s, d), 24 * HOUR, "qty"),
        V + "SELECT b.symbol, b.open_time, round(coalesce(sum(t.qty), 0), 6) AS trailing FROM v_bars b LEFT JOIN v_trades t ON t.symbol = b.symbol AND t.t <= b.open_time AND t.t > b.open_time - 86400000 GROUP BY 1, 2",
    ),
    "F01_momentum": (lambda s, d: features.momentum(dense(s, d)), DENSE + "SELECT symbol, open_time, " + ", ".join(f"round(close / lag(close, {k}) OVER {BY} - 1, 6) AS momentum_{k}" for k in (1, 3, 10)) + " FROM dense"),
    "F01_candle_features": (
        lambda s, d: _tied(features.candle_features(dense(s, d), 3, 12)),
        DENSE
        + f""", x AS (SELECT *, close - lag(close) OVER {BY} AS d, abs(close / lag(close) OVER {BY} - 1) AS a, row_number() OVER {BY} AS i, greatest(high - low, abs(high - lag(close) OVER {BY}), abs(low - lag(close) OVER {BY})) AS tr,
  list_reduce(list(close) OVER {frame_sql(24)}, lambda e, c: e * (1 - 2.0::DOUBLE / 13) + c * (2.0::DOUBLE / 13)) AS ema FROM dense),
y AS (SELECT *, {', '.join(f'avg(close) OVER {frame_sql(n)} AS c{n}' for n in (3, 5, 12))}, {', '.join(f'avg(volume) OVER {frame_sql(n)} AS v{n}' for n in (3, 12))}, avg(volume) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vb,
  avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING) AS cb, avg(greatest(d, 0)) OVER {frame_sql(14)} AS gain, avg(greatest(-d, 0)) OVER {frame_sql(14)} AS loss, avg(tr) OVER {frame_sql(14)} AS tr14, avg(a) OVER {frame_sql(20)} AS a20,
  {', '.join(f'close / lag(close, {k}) OVER {BY} - 1 AS m{k}' for k in (1, 3, 10, 20))} FROM x)
SELECT symbol, open_time, {', '.join(f'round(m{k} + 1e-9::DOUBLE, 6) AS momentum_{k}' for k in (1, 3, 10, 20))}, round(c3 / c12 - 1 + 1e-9::DOUBLE, 6) AS sma_spread, round(CASE WHEN loss = 0 THEN 1 ELSE 1 - 1 / (1 + gain / loss) END + 1e-9::DOUBLE, 6) AS rsi, round((ema - close) / close + 1e-9::DOUBLE, 6) AS ema_gap, round(tr14 / close + 1e-9::DOUBLE, 6) AS atr, round(a20 + 1e-9::DOUBLE, 6) AS mean_abs_return,
  round(CASE WHEN vb <> 0 THEN (volume - vb) / vb ELSE 0 END + 1e-9::DOUBLE, 6) AS volume_ratio, round((c3 - cb) / cb + 1e-9::DOUBLE, 6) AS acceleration, round((close - c5) / close + 1e-9::DOUBLE, 6) AS gap_5, round(CASE WHEN v12 <> 0 THEN (v3 - v12) / v12 ELSE 0 END + 1e-9::DOUBLE, 6) AS volume_trend FROM y WHERE i > 44""",
    ),
    "F03_rsi": (
        lambda s, d: features.rsi(dense(s, d)),
        DENSE
        + f""", d AS (SELECT symbol, open_time, close - lag(close) OVER {BY} AS d FROM dense),
g AS (SELECT symbol, open_time, count(d) OVER {frame_sql(14)} AS n, avg(CASE WHEN d IS NULL THEN 0 ELSE greatest(d, 0) END) OVER {frame_sql(14)} AS gain, avg(CASE WHEN d IS NULL THEN 0 ELSE greatest(-d, 0) END) OVER {frame_sql(14)} AS loss FROM d)
SELECT symbol, open_time, round(CASE WHEN n = 14 THEN CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END END, 6) AS rsi FROM g""",
    ),
    "F04_atr": (
        lambda s, d: features.atr(dense(s, d)),
        DENSE
        + f""", d AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {BY}), abs(low - lag(close) OVER {BY})) AS tr FROM dense)
SELECT symbol, open_time, round(CASE WHEN count(tr) OVER {frame_sql(14)} = 14 THEN avg(tr) OVER {frame_sql(14)} / close END, 6) AS atr FROM d""",
    ),
    "F09_realised_volatility": (
        lambda s, d: features.realised_volatility(dense(s, d), 24),
        DENSE + f", d AS (SELECT *, ln(close / lag(close) OVER {BY}) AS r FROM dense) SELECT symbol, open_time, round(CASE WHEN count(r) OVER {frame_sql(24)} = 24 THEN stddev_pop(r) OVER {frame_sql(24)} END, 6) AS volatility FROM d",
    ),
    "F11_path_efficiency": (
        lambda s, d: features.path_efficiency(dense(s, d), 12),
        DENSE
        + f""", d AS (SELECT *, abs(close - lag(close) OVER {BY}) AS d, lag(close, 12) OVER {BY} AS past FROM dense)
SELECT symbol, open_time, round(CASE WHEN count(d) OVER {frame_sql(12)} = 12 THEN CASE WHEN sum(d) OVER {frame_sql(12)} > 0 THEN abs(close - past) / sum(d) OVER {frame_sql(12)} ELSE 0 END END, 6) AS efficiency FROM d""",
    ),
    "F13_cross_section": (
        lambda s, d: features.cross_section(dense(s, d)),
        DENSE + f", d AS (SELECT open_time, close / lag(close) OVER {BY} - 1 AS r FROM dense) SELECT open_time, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS dispersion, round(abs(avg(sign(r))), 6) AS agreement, count(*) AS n FROM d WHERE r IS NOT NULL GROUP BY 1",
    ),
    "F28_order_flow_imbalance": (
        lambda s, d: features.order_flow_imbalance(views.quotes(s, d)),
        V
        + """SELECT symbol, update_id, round(CASE WHEN lag(bid) OVER w IS NOT NULL THEN ((CASE WHEN bid >= lag(bid) OVER w THEN bid_qty ELSE 0 END - CASE WHEN bid <= lag(bid) OVER w THEN lag(bid_qty) OVER w ELSE 0 END)
  - (CASE WHEN ask <= lag(ask) OVER w THEN ask_qty ELSE 0 END - CASE WHEN ask >= lag(ask) OVER w THEN lag(ask_qty) OVER w ELSE 0 END)) / greatest((bid_qty + ask_qty + lag(bid_qty) OVER w + lag(ask_qty) OVER w) / 2, 1e-12::DOUBLE) END, 6) AS ofi
FROM v_quotes WINDOW w AS (PARTITION BY symbol ORDER BY event_ms, update_id)""",
    ),
    "T01_fixed_horizon_return": (lambda s, d: features.next_return(dense(s, d)), DENSE + f"SELECT symbol, open_time, round(ln(lead(open, 2) OVER {BY} / lead(open, 1) OVER {BY}) * 10000, 6) AS target FROM dense"),
    "P05_equal_windows": (
        lambda s, d: evaluation.equal_windows(views.predictions(s, d), 8),
        V
        + """, days AS (SELECT day, count(*) AS rows FROM v_predictions GROUP BY 1), w AS (SELECT *, ((row_number() OVER (ORDER BY day) - 1) * 8 // count(*) OVER () + 1)::INT AS "window" FROM days)
SELECT "window", min(day) AS first_day, max(day) AS last_day, sum(rows)::BIGINT AS n FROM w GROUP BY 1""",
    ),
    "P10_group_equal_weights": (lambda s, d: evaluation.day_weights(views.predictions(s, d)), V + "SELECT id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY day), 6) AS weight FROM v_predictions"),
    "E01_binary_metrics": (
        lambda s, d: evaluation.binary_metrics(views.predictions(s, d)),
        V
        + """, k AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM v_predictions GROUP BY 1), r AS (SELECT pos, sum(pos) OVER w / sum(n) OVER w AS pr FROM k WINDOW w AS (ORDER BY p DESC)), ap AS (SELECT round(sum(pos * pr) / sum(pos), 6) AS average_precision FROM r),
c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS a, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS b, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS c, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS d FROM v_predictions),
m AS (SELECT round(CASE WHEN (a + b) * (a + c) * (d + b) * (d + c) > 0 THEN (a * d - b * c) / sqrt((a + b) * (a + c) * (d + b) * (d + c)) ELSE 0 END, 6) AS mcc FROM c),
s AS (SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT::DOUBLE), 6) AS accuracy, round(avg(y::DOUBLE), 6) AS prevalence FROM v_predictions) SELECT * FROM s, m, ap""",
    ),
    "E05_roc_auc": (
        lambda s, d: ranks.roc_auc(views.predictions(s, d)),
        V
        + """, c AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM v_predictions GROUP BY 1), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM b""",
    ),
    "E07_calibration_error": (
        lambda s, d: evaluation.calibration_error(views.predictions(s, d)),
        V + ", c AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y::DOUBLE) AS y FROM v_predictions GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM c",
    ),
    "E08_confusion": (
        lambda s, d: evaluation.confusion(views.predictions(s, d)),
        V
        + """, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM v_predictions)
SELECT *, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy FROM c""",
    ),
    "E09_daily_metric": (lambda s, d: evaluation.daily_metric(views.predictions(s, d)), V + "SELECT day, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier FROM v_predictions GROUP BY 1"),
    "E21_replay_metrics": (
        lambda s, d: evaluation.replay_metrics(views.closed_trades(s, d)),
        V
        + """SELECT symbol, count(*) AS trades, round(sum(pnl), 6) AS net, round(median(pnl), 6) AS median, round(avg((pnl > 0)::INT::DOUBLE), 6) AS positive_rate,
  round(CASE WHEN -sum(least(pnl, 0)) > 0 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) END, 6) AS profit_factor, count(DISTINCT exit) AS active_days FROM v_closed GROUP BY 1""",
    ),
    "E29_drawdown": (
        lambda s, d: evaluation.drawdown(views.closed_trades(s, d)),
        V
        + """, d AS (SELECT symbol, exit, sum(pnl) AS pnl FROM v_closed GROUP BY 1, 2), e AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY exit) AS equity FROM d),
p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY exit), 0) AS peak FROM e) SELECT symbol, round(max(peak - equity), 6) AS drawdown FROM p GROUP BY 1""",
    ),
    "E30_concurrent_exposure": (
        lambda s, d: evaluation.concurrent_exposure(views.closed_trades(s, d)),
        V
        + """, s AS (SELECT symbol, entry AS day, 1 AS d FROM v_closed UNION ALL SELECT symbol, exit, -1 FROM v_closed), g AS (SELECT symbol, day, sum(d) AS d FROM s GROUP BY 1, 2),
r AS (SELECT symbol, sum(d) OVER (PARTITION BY symbol ORDER BY day) AS o FROM g) SELECT symbol, max(o)::BIGINT AS most_open FROM r GROUP BY 1""",
    ),
    "E55_source_rollups": (
        lambda s, d: evaluation.source_rollups(views.observations(s, d)),
        V + "SELECT source, kind, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(abs(score)), 6) AS mean_abs, round(avg(CAST(json_extract_string(payload, '$.k') AS DOUBLE)), 6) AS mean_k FROM v_obs GROUP BY 1, 2",
    ),
    "E57_latest_per_key": (
        lambda s, d: evaluation.latest_per_key(views.observations(s, d)),
        V + "SELECT source, kind, observed_at, id, round(score, 6) AS score FROM v_obs QUALIFY row_number() OVER (PARTITION BY source, kind ORDER BY observed_at DESC, id DESC) = 1",
    ),
    "S04_normalize_epoch": (
        lambda s, d: views.trades(s, d).select("id", ingest.normalize_epoch(F.when(F.col("id") % 2 == 0, F.col("t") * 1000 + 7).otherwise(F.col("t"))).alias("t")),
        V + "SELECT id, t FROM v_trades",
    ),
    "S09_upsert": (
        lambda s, d: ingest.upsert(views.closed_trades(s, d), views.closed_trades(s, d).where("id % 3 = 0").withColumn("pnl", F.lit(0.0)), ["symbol", "entry"], "id"),
        V
        + """, b AS (SELECT *, 0 AS r FROM v_closed UNION ALL SELECT id, symbol, entry, exit, 0, 1 FROM v_closed WHERE id % 3 = 0)
SELECT id, symbol, entry, exit, round(pnl, 6) AS pnl FROM b QUALIFY row_number() OVER (PARTITION BY symbol, entry ORDER BY r DESC, id DESC) = 1""",
    ),
    "S11_append_observations": (
        lambda s, d: ingest.append_observations(views.observations(s, d).where("id % 2 = 0"), views.observations(s, d), 8).select("id", "kind", "payload_hash", "payload", "truncated"),
        V + "SELECT id, kind, sha256(payload) AS payload_hash, substr(payload, 1, 8) AS payload, octet_length(payload::BLOB) > 8 AS truncated FROM v_obs WHERE id % 2 = 1",
    ),
    "F31_book_walk": (
        _walks,
        V
        + """, c AS (SELECT *, greatest(0, least(qty, 85 - coalesce(sum(qty) OVER (PARTITION BY update_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM v_levels),
w AS (SELECT update_id, side, sum(take) AS got, sum(take * price) / 85 AS price, arg_max(price, i) FILTER (take > 0) AS worst, count(*) FILTER (take > 0) AS used, sum(qty) FILTER (i < 5) AS d FROM c GROUP BY 1, 2)
SELECT b.update_id, round(CASE WHEN a.got >= 85 THEN a.price END, 6) AS buy, round(CASE WHEN a.got >= 85 THEN a.worst END, 6) AS buy_worst, CASE WHEN a.got >= 85 THEN a.used END::INT AS buy_levels,
  round(CASE WHEN b.got >= 85 THEN b.price END, 6) AS sell, round(CASE WHEN b.got >= 85 THEN b.worst END, 6) AS sell_worst, CASE WHEN b.got >= 85 THEN b.used END::INT AS sell_levels, round((b.d - a.d) / (b.d + a.d), 6) AS imbalance
FROM w b JOIN w a ON a.update_id = b.update_id AND a.side = 'ask' WHERE b.side = 'bid'""",
    ),
    "E58_recent": (lambda s, d: evaluation.recent(views.observations(s, d), 50), V + "SELECT id, observed_at, source, kind FROM v_obs ORDER BY observed_at DESC, id DESC LIMIT 50"),
}


def queries() -> dict[str, Query]:
    every = {name: query for name, (query, _) in _ALL.items()} | evidence.UNCHECKED | fitted.UNCHECKED
    return {name: (lambda spark, sf_dir, q=query: rounded(q(spark, sf_dir))) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
