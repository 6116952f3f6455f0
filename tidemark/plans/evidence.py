"""Queries of resampling, calibration, greedy replays and regimes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, calibration, evaluation, features, regimes, replay, resampling
from tidemark.plans.base import BY, DAY, DENSE, Query, V, dense
from tidemark.plans.stats import FORECASTS, RETURNS, forecasts, states
from tidemark.sources import views

VR = V.replace("WITH", "WITH RECURSIVE", 1)
#: Daily results in thousands, their places and the sums before them.
DAYS = """, d AS (SELECT symbol, exit AS day, sum(pnl) / 1000 AS value FROM v_closed GROUP BY 1, 2),
pos AS (SELECT symbol, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, coalesce(sum(value) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))"""
INTERVAL = " SELECT symbol, round(quantile_cont(mean, 0.05), 6) AS lower, round(quantile_cont(mean, 0.95), 6) AS upper, round(avg((mean > 0)::INT::DOUBLE), 6) AS positive, count(*) AS replicates FROM means GROUP BY 1"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.closed_trades(spark, sf_dir).groupBy("symbol", F.col("exit").alias("day")).agg((F.sum("pnl") / 1000).alias("value"))


def _digest(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(p + '::VARCHAR' for p in parts)}), 1, 8))::BIGINT"


def _greedy(candidates: str, end: str, key: str = "symbol") -> str:
    """Recursive picks over candidates (symbol, day, t, id, ...)."""
    return f""", cand AS ({candidates}), num AS (SELECT *, row_number() OVER (PARTITION BY {key}, day ORDER BY t, id) AS k FROM cand),
nx AS (SELECT {', '.join('a.' + c for c in key.split(', '))}, a.day, a.k, min(b.k) AS nk FROM num a LEFT JOIN num b ON {' AND '.join(f'b.{c} = a.{c}' for c in key.split(', '))} AND b.day = a.day AND b.k > a.k AND b.t >= a.{end} GROUP BY ALL),
walk AS (SELECT {key}, day, k FROM num WHERE k = 1 UNION ALL SELECT {', '.join('w.' + c for c in key.split(', '))}, w.day, nx.nk FROM walk w JOIN nx ON {' AND '.join(f'nx.{c} = w.{c}' for c in key.split(', '))} AND nx.day = w.day AND nx.k = w.k WHERE nx.nk IS NOT NULL),
picked AS (SELECT num.* FROM walk JOIN num USING ({key}, day, k))"""


SAME_DAY = 'SELECT *, t // 86400000 AS day FROM v_actions WHERE t // 86400000 = "end" // 86400000'
TRACE = VR + _greedy(SAME_DAY + " AND score * side >= 0.5", '"end"')
SURVIVAL = "SELECT id % 4 AS bucket, p / 2 AS h1, 0.2::DOUBLE + (id % 5) / 20.0::DOUBLE AS h2, 0.3::DOUBLE AS h3 FROM v_predictions"
REGIME = (
    DENSE
    + f""", r AS (SELECT symbol, open_time // {DAY} * {DAY} AS "window", open_time, close, volume, close / lag(close) OVER w - 1 AS r, row_number() OVER (PARTITION BY symbol, open_time // {DAY} ORDER BY open_time DESC) AS later FROM dense WINDOW w AS (PARTITION BY symbol, open_time // {DAY} ORDER BY open_time)),
s AS (SELECT *, CASE WHEN r <> 0 THEN sign(r) END AS sg, lag(r) OVER (PARTITION BY symbol, "window" ORDER BY open_time) AS past FROM r),
t AS (SELECT *, sg <> last_value(sg IGNORE NULLS) OVER (PARTITION BY symbol, "window" ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM s),
g AS (SELECT symbol, "window", count(*) AS n, count(r) AS k, arg_max(close, open_time) / arg_min(close, open_time) - 1 AS trend, coalesce(stddev_samp(r), 0) AS vol, avg(abs(r)) AS ma, count(sg) AS signs,
  greatest(count(*) FILTER (sg > 0), count(*) FILTER (sg < 0)) AS most, count(*) FILTER (turn) AS turns, count(*) FILTER (past IS NOT NULL AND r IS NOT NULL) AS pairs,
  var_pop(past) FILTER (past IS NOT NULL AND r IS NOT NULL) AS vx, var_pop(r) FILTER (past IS NOT NULL AND r IS NOT NULL) AS vy, covar_pop(past, r) AS cv,
  CASE WHEN count(*) >= 3 THEN CASE WHEN stddev_samp(volume) FILTER (later > 1) > 1e-12 THEN (arg_max(volume, open_time) - avg(volume) FILTER (later > 1)) / stddev_samp(volume) FILTER (later > 1) ELSE 0 END END AS vz FROM t GROUP BY 1, 2),
e AS (SELECT symbol, "window", n, k, CASE WHEN n >= 3 THEN trend ELSE 0 END AS trend, CASE WHEN n >= 3 THEN vol ELSE 0 END AS vol, CASE WHEN n >= 3 THEN ma ELSE 0 END AS ma, CASE WHEN n >= 3 THEN signs ELSE 0 END AS signs, most, turns, pairs, vx, vy, cv, vz FROM g),
h AS (SELECT *, CASE WHEN signs > 0 THEN most / signs::DOUBLE ELSE 0 END AS consistency, CASE WHEN signs > 0 THEN turns / greatest(1, signs - 1)::DOUBLE ELSE 0 END AS reversals,
  CASE WHEN pairs >= 2 AND sqrt(vx * vy) * pairs > 1e-12 THEN greatest(-1, least(1, cv / sqrt(vx * vy))) ELSE 0 END AS auto, abs(trend) / greatest(1e-9, ma * sqrt(k), vol * sqrt(k)) AS st, greatest(0.0005::DOUBLE, ma * 1.8::DOUBLE) AS fl FROM e),
reg AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient_data' WHEN vol >= fl AND reversals >= 0.55 THEN 'volatile_chop' WHEN st >= 1.15 AND consistency >= 0.55 THEN CASE WHEN trend > 0 THEN 'trend_up' ELSE 'trend_down' END WHEN reversals >= 0.5 AND st < 0.85 THEN 'range_bound' WHEN abs(auto) >= 0.35 THEN 'serial_correlation' ELSE 'mixed' END AS regime,
  CASE WHEN n < 3 THEN 0 WHEN vol >= fl AND reversals >= 0.55 THEN least(1, 0.45 + 0.35 * reversals + 0.1 * least(2, vol / fl)) WHEN st >= 1.15 AND consistency >= 0.55 THEN least(1, 0.4 + 0.175 * least(2, st) + 0.25 * consistency)
  WHEN reversals >= 0.5 AND st < 0.85 THEN least(1, 0.45 + 0.35 * reversals + 0.2 * (1 - least(1, st))) WHEN abs(auto) >= 0.35 THEN least(1, 0.5 + 0.5 * abs(auto)) ELSE greatest(0.2, least(0.7, 0.35 + 0.2 * consistency + 0.15 * least(1, st))) END AS confidence FROM h)"""
)


def _survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.predictions(spark, sf_dir)
    return p.select((F.col("id") % 4).alias("bucket"), (F.col("p") / 2).alias("hazard_1"), (0.2 + (F.col("id") % 5) / 20).alias("hazard_2"), F.lit(0.3).alias("hazard_3"))


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.classify_regime(dense(spark, sf_dir), DAY)


def _stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.scenarios(views.closed_trades(spark, sf_dir).select("symbol", "exit", "pnl"), [("base", 0.0), ("wide", 5.0), ("worst", 25.0)])
    return evaluation.replay_metrics(rows.select(F.concat_ws("/", "symbol", "scenario").alias("symbol"), "exit", (F.col("pnl") - F.col("cost")).alias("pnl")))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = states(spark, sf_dir)
    chances = evaluation.transition_matrix(seen, 3).groupBy("pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("post", "chance"))), lambda x: x["chance"]).alias("p"))
    return seen.join(F.broadcast(chances), "pre").select(F.col("post").alias("state"), "p")


#: No SQL: the fit is iterative; a test compares it with the same fit over arrays.
UNCHECKED: dict[str, Query] = {
    "E49_platt_scaling": lambda s, d: calibration.platt_apply(views.predictions(s, d), *calibration.platt_fit(views.predictions(s, d))).select("id", "p", "calibrated"),
}

QUERIES: dict[str, tuple[Query, str]] = {
    "E11_routed_cost": (
        lambda s, d: views.quotes(s, d).groupBy("symbol").agg(F.count("*").alias("n"), *evaluation.routed_cost(4.0)),
        V
        + """, c AS (SELECT symbol, (ask - bid) / ((bid + ask) / 2) * 10000 AS spread, event_ms - txn_ms AS delay FROM v_quotes)
SELECT symbol, count(*) AS n, round(avg(spread), 6) AS spread_cost, round(avg(spread + 8), 6) AS total_cost, round(avg(delay), 6) AS mean_delay, round(avg((spread + 8 < 9)::INT::DOUBLE), 6) AS cheap_rate FROM c GROUP BY 1""",
    ),
    "E13_block_bootstrap": (
        lambda s, d: resampling.block_bootstrap(days(s, d), "symbol", 200),
        V
        + DAYS
        + f""", z AS (SELECT symbol, any_value(n) AS n, sum(value) AS total, greatest(1, least(any_value(n), round_even(sqrt(any_value(n)), 0)))::BIGINT AS length FROM pos GROUP BY 1),
b AS (SELECT *, unnest(generate_series(0, (n + length - 1) // length - 1)) AS block FROM z, generate_series(1, 200) r(rep)), c AS (SELECT *, least(length, n - block * length) AS size FROM b),
e AS (SELECT *, {_digest('symbol', 'rep', 'block')} % (n - size + 1) AS f FROM c),
means AS (SELECT e.symbol, rep, sum(coalesce(h.before, total) - l.before) / any_value(e.n) AS mean FROM e JOIN pos l ON l.symbol = e.symbol AND l.i = f LEFT JOIN pos h ON h.symbol = e.symbol AND h.i = f + size GROUP BY 1, 2)"""
        + INTERVAL,
    ),
    "E14_day_block_bootstrap": (
        lambda s, d: resampling.day_bootstrap(days(s, d), "symbol", 100),
        V + DAYS + f", e AS (SELECT symbol, rep, {_digest('symbol', 'rep', 'i')} % n AS j FROM pos, generate_series(1, 100) r(rep)), means AS (SELECT e.symbol, rep, avg(value) AS mean FROM e JOIN pos ON pos.symbol = e.symbol AND pos.i = j GROUP BY 1, 2)" + INTERVAL,
    ),
    "E15_stationary_bootstrap": (
        lambda s, d: resampling.stationary_bootstrap(days(s, d), "symbol", 100, 8),
        V
        + DAYS
        + f""", e AS (SELECT symbol, n, rep, i AS step, i = 0 OR {_digest("'new'", 'symbol', 'rep', 'i')} < 536870912 AS fresh, {_digest('symbol', 'rep', 'i')} % n AS j FROM pos, generate_series(1, 100) r(rep)),
f AS (SELECT *, last_value(CASE WHEN fresh THEN step END IGNORE NULLS) OVER w AS s0, last_value(CASE WHEN fresh THEN j END IGNORE NULLS) OVER w AS j0 FROM e WINDOW w AS (PARTITION BY symbol, rep ORDER BY step)),
means AS (SELECT f.symbol, rep, avg(value) AS mean FROM f JOIN pos ON pos.symbol = f.symbol AND pos.i = (j0 + step - s0) % f.n GROUP BY 1, 2)"""
        + INTERVAL,
    ),
    "E16_iid_bootstrap_lower": (
        lambda s, d: resampling.lcg_lower_mean(days(s, d), "symbol", 64, 0.9),
        VR
        + DAYS
        + """, z AS (SELECT symbol, any_value(n) AS n FROM pos GROUP BY 1), g AS (SELECT symbol, n, rep, 1 AS step, (1664525 * rep + 1013904223) % 4294967296 AS state FROM z, generate_series(1, 64) r(rep)
  UNION ALL SELECT symbol, n, rep, step + 1, (1664525 * state + 1013904223) % 4294967296 FROM g WHERE step < n),
means AS (SELECT g.symbol, rep, avg(value) AS mean FROM g JOIN pos ON pos.symbol = g.symbol AND pos.i = state % g.n GROUP BY 1, 2) SELECT symbol, round(quantile_cont(mean, 1 - 0.9::DOUBLE), 6) AS lower, count(*) AS replicates FROM means GROUP BY 1""",
    ),
    "E19_placebo": (
        lambda s, d: resampling.placebo_exceedance(views.predictions(s, d), "day", "p", "y", 20),
        V
        + """, e AS (SELECT day, id, p, y, rep, row_number() OVER (PARTITION BY day, rep ORDER BY id) AS own, row_number() OVER (PARTITION BY day, rep ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5(rep::VARCHAR || '|' || id::VARCHAR) END, id) AS place FROM v_predictions, generate_series(0, 20) r(rep)),
g AS (SELECT a.rep, avg(b.p) FILTER (a.y = 1) - avg(b.p) FILTER (a.y = 0) AS gap FROM e a JOIN e b ON b.day = a.day AND b.rep = a.rep AND b.place = a.own GROUP BY 1), o AS (SELECT gap AS observed FROM g WHERE rep = 0)
SELECT round(any_value(observed), 6) AS observed, round((count(*) FILTER (gap >= observed - 1e-9) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM g, o WHERE rep > 0""",
    ),
    "E22_action_trace": (
        lambda s, d: replay.action_trace(views.actions(s, d), 0.5),
        TRACE + ' SELECT id, symbol, t, side, round(score, 6) AS score, "end", stress_end, net FROM picked',
    ),
    "E23_fixed_ledger": (
        lambda s, d: replay.fixed_ledger(views.actions(s, d).withColumn("slot", F.floor(F.col("t") / 1_800_000)), "slot", 0.5, 1.0).select("symbol", "slot", "id", "t", "until", "net", "stress_net"),
        VR
        + _greedy('SELECT *, t // 86400000 AS day FROM (SELECT *, t // 1800000 AS slot, greatest("end", stress_end) AS until FROM v_actions WHERE net >= 0.5 AND net - 1 > 0 QUALIFY row_number() OVER (PARTITION BY symbol, t // 1800000 ORDER BY net DESC, id DESC) = 1) WHERE t // 86400000 = until // 86400000', "until")
        + " SELECT symbol, slot, id, t, until, net, round(net - 1, 6) AS stress_net FROM picked",
    ),
    "E24_select_threshold": (
        lambda s, d: replay.select_threshold(views.actions(s, d), [0.5, 0.8, 0.9, 0.95], 20),
        VR
        + ", cuts AS (SELECT (row_number() OVER () - 1)::INT AS level, q AS threshold FROM (SELECT unnest(quantile_cont(score * side, [0.5, 0.8, 0.9, 0.95])) AS q FROM v_actions))"
        + _greedy(f"SELECT a.*, level, threshold FROM ({SAME_DAY}) a, cuts WHERE score * side >= threshold", '"end"', "symbol, level")
        + """, f AS (SELECT level, threshold, count(*) AS trades, sum(net) AS net FROM picked GROUP BY 1, 2)
SELECT level, round(threshold, 6) AS threshold, trades, round(net, 6) AS net, row_number() OVER (ORDER BY trades >= 20 DESC, round(net, 9) DESC, level) = 1 AND trades >= 20 AND net > 0 AS chosen FROM f""",
    ),
    "E27_paired_stress": (
        lambda s, d: replay.paired_stress(replay.action_trace(views.actions(s, d), 0.5), 1.0),
        TRACE + ", o AS (SELECT *, coalesce(lag(stress_end) OVER (PARTITION BY symbol, day ORDER BY t, id) > t, false) AS overlap FROM picked) SELECT symbol, count(*) AS trades, round(sum(net), 6) AS net, round(sum(net - 1), 6) AS stress_net, count(*) FILTER (overlap) AS overlaps FROM o GROUP BY 1",
    ),
    "E35_correlation_clusters": (
        lambda s, d: regimes.correlation_clusters(evaluation.correlation_matrix(features.simple_returns(dense(s, d))), views.trades(s, d).select("symbol").distinct(), 0.0),
        RETURNS.replace("WITH", "WITH RECURSIVE", 1)
        + """, c AS (SELECT a.symbol, b.symbol AS other FROM d a JOIN d b ON a.open_time = b.open_time AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING corr(a.r, b.r) >= 0),
l AS (SELECT symbol, other FROM c UNION ALL SELECT other, symbol FROM c), reach AS (SELECT DISTINCT symbol, symbol AS seen FROM v_trades UNION SELECT reach.symbol, l.other FROM reach JOIN l ON l.symbol = reach.seen) SELECT symbol, min(seen) AS cluster FROM reach GROUP BY 1""",
    ),
    "E38_classify_regime": (
        _regimes,
        REGIME + ' SELECT symbol, "window", n, round(trend, 6) AS trend_return, round(vol, 6) AS volatility, round(consistency, 6) AS consistency, round(reversals, 6) AS reversals, round(auto, 6) AS auto, round(vz, 6) AS volume_z, regime, round(confidence, 6) AS confidence FROM reg',
    ),
    "E39_regime_summary": (
        lambda s, d: regimes.regime_summary(_regimes(s, d), "trend_return"),
        REGIME
        + """, f AS (SELECT regime, count(*) AS windows, count(*) FILTER (trend > 0) AS accepted, sum(trend) AS pnl, min(trend) AS worst, avg(confidence) AS mc FROM reg GROUP BY 1)
SELECT regime, windows, accepted, round(pnl, 6) AS pnl, round(worst, 6) AS worst, round(mc, 6) AS mean_confidence, round(accepted / windows::DOUBLE, 6) AS accepted_rate, round(windows / sum(windows) OVER (), 6) AS share, windows / sum(windows) OVER () >= 0.75 AND sum(windows) OVER () >= 3 AS crowded FROM f""",
    ),
    "E40_edge_report": (
        lambda s, d: resampling.edge_report(days(s, d), "symbol", 30, 0.1),
        V
        + DAYS
        + """, s AS (SELECT symbol, count(*) AS n, count(*) FILTER (value > 0) AS wins, sum(value) AS net, avg(value) AS mean, median(value) AS med, sqrt(avg(least(value, 0) ** 2)) AS dn FROM pos GROUP BY 1),
x AS (SELECT symbol, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) AS p FROM (SELECT *, unnest(generate_series(wins, n)) AS k FROM s) GROUP BY 1),
f AS (SELECT s.*, least(1, x.p) AS sign_p, CASE WHEN dn > 0 THEN mean / dn WHEN mean > 0 THEN 999 ELSE 0 END AS dr FROM s JOIN x ON x.symbol = s.symbol),
h AS (SELECT *, concat_ws(',', CASE WHEN net <= 0 THEN 'net' END, CASE WHEN n < 30 THEN 'few_days' END, CASE WHEN sign_p > 0.1 THEN 'sign_test' END, CASE WHEN dr < 0.05 THEN 'downside' END) AS failed FROM f)
SELECT symbol, n, wins, round(net, 6) AS net, round(mean, 6) AS mean, round(med, 6) AS median, round(dr, 6) AS downside_ratio, round(sign_p, 6) AS sign_p, failed, failed = '' AS accepted FROM h""",
    ),
    "E42_rank_candidates": (
        lambda s, d: regimes.rank_candidates(evaluation.replay_metrics(views.closed_trades(s, d)), 50, 1.0),
        V
        + """, m AS (SELECT symbol, count(*) AS trades, sum(pnl) AS net, avg((pnl > 0)::INT::DOUBLE) AS pr, CASE WHEN -sum(least(pnl, 0)) > 0 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) END AS pf FROM v_closed GROUP BY 1),
f AS (SELECT *, concat_ws(',', CASE WHEN trades < 50 THEN 'few_trades' END, CASE WHEN coalesce(pf, 999) < 1 THEN 'profit_factor' END, CASE WHEN net <= 0 THEN 'net' END) AS reasons, pr * least(coalesce(pf, 999), 3) AS score FROM m)
SELECT symbol, trades, round(score, 6) AS score, reasons, row_number() OVER (ORDER BY reasons <> '', score DESC, symbol)::INT AS place FROM f""",
    ),
    "E44_stress_validation": (
        _stressed,
        V
        + """, c AS (SELECT symbol || '/' || name AS symbol, exit, pnl - cost AS pnl FROM v_closed, (VALUES ('base', 0), ('wide', 5), ('worst', 25)) v(name, cost))
SELECT symbol, count(*) AS trades, round(sum(pnl), 6) AS net, round(median(pnl), 6) AS median, round(avg((pnl > 0)::INT::DOUBLE), 6) AS positive_rate,
  round(CASE WHEN -sum(least(pnl, 0)) > 0 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) END, 6) AS profit_factor, count(DISTINCT exit) AS active_days FROM c GROUP BY 1""",
    ),
    "E45_overfit_probability": (
        lambda s, d: resampling.overfit_probability(views.predictions(s, d).groupBy((F.col("id") % 7).alias("trial"), (F.col("day") % 8).alias("fold")).agg((-F.avg((F.col("p") - F.col("y")) ** 2)).alias("score")), 8),
        V
        + """, s AS (SELECT id % 7 AS trial, day % 8 AS fold, -avg((p - y) ** 2) AS score FROM v_predictions GROUP BY 1, 2),
t AS (SELECT m, trial, avg(score) FILTER ((m >> fold::INT) & 1 = 1) AS a, avg(score) FILTER ((m >> fold::INT) & 1 = 0) AS b FROM s, generate_series(0, 255) g(m) WHERE bit_count(m) = 4 GROUP BY 1, 2),
p AS (SELECT row_number() OVER (PARTITION BY m ORDER BY a DESC, trial DESC) AS best, (rank() OVER (PARTITION BY m ORDER BY b) - 1 + (count(*) OVER (PARTITION BY m, b) - 1) / 2.0::DOUBLE + 1) / (count(*) OVER (PARTITION BY m) + 1) AS place FROM t)
SELECT count(*) AS splits, round(avg((place < 0.5)::INT::DOUBLE), 6) AS probability, round(avg(place), 6) AS mean_place FROM p WHERE best = 1""",
    ),
    "E48_temperature": (
        lambda s, d: calibration.fit_temperature(views.predictions(s, d)),
        V
        + """, g AS (SELECT 0.25::DOUBLE * 16.0::DOUBLE ** (i / 64.0::DOUBLE) AS k FROM generate_series(0, 64) g(i)), z AS (SELECT y, ln(p / (1 - p)) AS z FROM v_predictions),
l AS (SELECT k, avg(ln(1 + exp(-abs(z / k))) + greatest(z / k, 0) - y * z / k) AS loss FROM z, g GROUP BY 1), b AS (SELECT arg_min(k, loss) AS k, min(loss) AS after, min(loss) FILTER (abs(k - 1) < 1e-9) AS before FROM l)
SELECT round(CASE WHEN before - after > 1e-12 THEN k ELSE 1 END, 6) AS temperature, before - after > 1e-12 AS fitted, round(before, 6) AS before, round(CASE WHEN before - after > 1e-12 THEN after ELSE before END, 6) AS after FROM b""",
    ),
    "E48_slope": (
        lambda s, d: calibration.fit_slope(forecasts(s, d), "forecast", "target"),
        FORECASTS
        + """, s AS (SELECT greatest(0, least(4, sum(forecast * target) / sum(forecast ** 2))) AS b FROM g), e AS (SELECT any_value(b) AS b, avg((target - forecast) ** 2) AS before, avg((target - b * forecast) ** 2) AS after FROM g, s)
SELECT round(CASE WHEN before - after > 1e-12 THEN b ELSE 1 END, 6) AS slope, before - after > 1e-12 AS fitted, round(before, 6) AS before, round(CASE WHEN before - after > 1e-12 THEN after ELSE before END, 6) AS after FROM e""",
    ),
    "E52_multiclass_loss": (
        lambda s, d: calibration.multiclass_loss(_classes(s, d), 3, 2),
        RETURNS
        + f""", s AS (SELECT symbol, open_time, CASE WHEN r > 0 THEN 2 WHEN r < 0 THEN 0 ELSE 1 END AS post FROM d WHERE r IS NOT NULL), w AS (SELECT lag(post) OVER {BY} AS pre, post FROM s), p AS (SELECT * FROM w WHERE pre IS NOT NULL),
c AS (SELECT a.i AS pre, b.i AS post, (SELECT count(*) FROM p WHERE p.pre = a.i AND p.post = b.i) AS n FROM generate_series(0, 2) a(i), generate_series(0, 2) b(i)), m AS (SELECT pre, post, (n + 1) / (sum(n) OVER (PARTITION BY pre) + 3) AS q FROM c),
v AS (SELECT p.post AS y, a.q AS q0, b.q AS q1, e.q AS q2 FROM p JOIN m a ON a.pre = p.pre AND a.post = 0 JOIN m b ON b.pre = p.pre AND b.post = 1 JOIN m e ON e.pre = p.pre AND e.post = 2)
SELECT count(*) AS n, round(avg(-ln(CASE y WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END)), 6) AS log_loss, round(avg((q0 - (y = 0)::INT) ** 2 + (q1 - (y = 1)::INT) ** 2 + (q2 - (y = 2)::INT) ** 2), 6) AS brier, round(avg((q2 - (y = 2)::INT) ** 2), 6) AS last_brier,
  round(avg((y = CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END)::INT::DOUBLE), 6) AS accuracy FROM v""",
    ),
    "E53_survival_scores": (
        lambda s, d: calibration.survival_scores(_survival(s, d)),
        V
        + f""", h AS ({SURVIVAL}), r AS (SELECT bucket AS k, h1 AS p1, (1 - h1) * h2 AS p2, (1 - h1) * (1 - h2) * h3 AS p3 FROM h), b AS (SELECT (count(*) FILTER (k = 1) + 1) / (count(*) + 4)::DOUBLE AS b1, (count(*) FILTER (k = 2) + 1) / (count(*) + 4)::DOUBLE AS b2, (count(*) FILTER (k = 3) + 1) / (count(*) + 4)::DOUBLE AS b3, (count(*) FILTER (k = 0) + 1) / (count(*) + 4)::DOUBLE AS b4 FROM r),
s AS (SELECT count(*) AS n, avg(-ln(CASE k WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE 1 - p1 - p2 - p3 END)) AS l, avg(-ln(CASE k WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 ELSE b4 END)) AS bl,
  avg(((p1 - (k = 1)::INT) ** 2 + (p1 + p2 - (k IN (1, 2))::INT) ** 2 + (p1 + p2 + p3 - (k > 0)::INT) ** 2) / 3) AS i, avg(((b1 - (k = 1)::INT) ** 2 + (b1 + b2 - (k IN (1, 2))::INT) ** 2 + (b1 + b2 + b3 - (k > 0)::INT) ** 2) / 3) AS bi FROM r, b)
SELECT n, round(l, 6) AS log_loss, round(bl, 6) AS base_log_loss, round(i, 6) AS brier, round(bi, 6) AS base_brier, round(1 - l / bl, 6) AS log_loss_skill, round(1 - i / bi, 6) AS brier_skill FROM s""",
    ),
    "E60_upper_confidence_quantile": (
        lambda s, d: resampling.upper_quantile(views.trades(s, d), "symbol", "price", 0.9, 0.95),
        V
        + """, n AS (SELECT symbol, count(*) AS n FROM v_trades GROUP BY 1), k AS (SELECT *, exp(lgamma(n + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - lgamma(n - k + 1) + k * ln(0.9::DOUBLE) + (n - k) * ln(1 - 0.9::DOUBLE)) AS p FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM n)),
c AS (SELECT symbol, k, sum(p) OVER (PARTITION BY symbol ORDER BY k) AS p FROM k), r AS (SELECT symbol, min(k) + 1 AS rank FROM c WHERE p >= 0.95 GROUP BY 1), o AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY price) AS i FROM v_trades)
SELECT r.symbol, rank, round(price, 6) AS bound FROM r JOIN o ON o.symbol = r.symbol AND o.i = rank""",
    ),
    "E20_nonoverlap_select": (
        lambda s, d: replay.nonoverlap_select(views.trades(s, d), 3_600_000),
        VR + _greedy('SELECT id, symbol, t, t + 3600000 AS "end", t // 86400000 AS day FROM v_trades', '"end"') + " SELECT symbol, id, t FROM picked",
    ),
}
