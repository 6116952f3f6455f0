"""Queries of rolling features, labels and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import factors
from tidemark.operators import asof, bars, features, labels
from tidemark.plans.base import BY, DAY, DENSE, HOUR, Query, V, dense, frame_sql, hourly
from tidemark.plans.joins import FUNDING, funding
from tidemark.sources import views

R = DENSE + f", d AS (SELECT *, close / lag(close) OVER {BY} - 1 AS r FROM dense)"
ROLES = [("train", 8766, 9500), ("stop", 9500, 9900), ("calibrate", 9900, 10300), ("evaluate", 10300, 10700)]
CUTS = [9200, 9600, 10000, 10400]



ADAPTIVE = R + f""", v AS (SELECT *, ln(close / lag(close) OVER {BY}) AS lr FROM dense), s AS (SELECT *, CASE WHEN count(lr) OVER {frame_sql(24)} = 24 THEN stddev_pop(lr) OVER {frame_sql(24)} * sqrt(6.0::DOUBLE) END AS sg FROM v),
wide AS (SELECT * EXCLUDE (sg, lr), greatest(0.05::DOUBLE, least(0.4::DOUBLE, 0.2::DOUBLE * sg)) AS stop, greatest(0.1::DOUBLE, least(0.8::DOUBLE, 0.4::DOUBLE * sg)) AS take FROM s WHERE sg IS NOT NULL)"""


def _barrier(horizon: int, stop: float | str, take: float | str | None, base: str = DENSE, table: str = "dense") -> str:
    take_at = f"entry * (1 + {take}::DOUBLE)" if take is not None else "'infinity'::DOUBLE"
    return (
        base
        + f""", n AS (SELECT *, row_number() OVER {BY} AS i, lead(open) OVER {BY} AS entry, lead(open, {horizon + 1}) OVER {BY} AS late, lead(open_time, {horizon + 1}) OVER {BY} AS late_time FROM {table}),
e AS (SELECT symbol, i, open_time, entry, late, late_time, entry * (1 - {stop}::DOUBLE) AS s, {take_at} AS k FROM n WHERE late IS NOT NULL),
h AS (SELECT e.symbol, e.i, min(x.i) AS at FROM e JOIN n x ON x.symbol = e.symbol AND x.i > e.i AND x.i <= e.i + {horizon} AND (x.low <= s OR x.high >= k) GROUP BY 1, 2)
SELECT e.symbol, e.open_time, CASE WHEN h.at IS NULL THEN 'timeout' WHEN x.low <= s THEN 'stop' ELSE 'take' END AS outcome, coalesce(x.low <= s AND x.high >= k, false) AS ambiguous, coalesce(x.open_time, e.late_time) AS exit_time,
  round((CASE WHEN h.at IS NULL THEN e.late WHEN x.low <= s THEN least(s, x.open) ELSE k END / e.entry - 1) * 10000, 6) AS payoff
FROM e LEFT JOIN h ON h.symbol = e.symbol AND h.i = e.i LEFT JOIN n x ON x.symbol = h.symbol AND x.i = h.at"""
    )


def _flow_sql(widths: tuple[int, ...]) -> str:
    parts = [
        f"""CASE WHEN count(close) OVER {frame_sql(n)} = {n} THEN sum(quote_volume) OVER {frame_sql(n)} END AS quote_{n},
CASE WHEN count(close) OVER {frame_sql(n)} = {n} THEN CASE WHEN sum(volume) OVER {frame_sql(n)} > 0 THEN sum(buy_volume) OVER {frame_sql(n)} / sum(volume) OVER {frame_sql(n)} ELSE 0.5 END END AS share_{n},
CASE WHEN count(close) OVER {frame_sql(n)} = {n} THEN avg(trade_count) OVER {frame_sql(n)} END AS rate_{n}, ln(close / lag(close, {n}) OVER {BY}) AS return_{n}"""
        for n in widths
    ]
    outs = [f"round(quote_{n}, 6) AS quote_{n}, round(share_{n}, 6) AS share_{n}, round(rate_{n}, 6) AS rate_{n}, round(return_{n}, 6) AS return_{n}, round(share_{n} - lag(share_{n}, {n}) OVER {BY}, 6) AS share_change_{n}" for n in widths]
    return DENSE + ", f AS (SELECT symbol, open_time, " + ", ".join(parts) + " FROM dense) SELECT symbol, open_time, " + ", ".join(outs) + " FROM f"


def _basis_sql(widths: tuple[int, ...], lags: tuple[int, ...]) -> str:
    def w(n: int) -> str:
        return f"(ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def flow(k: str, n: int) -> str:
        return f"CASE WHEN sum({k}v) OVER {w(n)} > 0 THEN sum(2 * {k}b - {k}v) OVER {w(n)} / sum({k}v) OVER {w(n)} ELSE 0 END"

    o = "(ORDER BY open_time)"
    cols = [f"basis - lag(basis, {n}) OVER {o} AS basis_change_{n}, 10000 * ln(sc / lag(sc, {n}) OVER {o}) - 10000 * ln(pc / lag(pc, {n}) OVER {o}) AS return_gap_{n}, ({flow('s', n)}) * ({flow('p', n)}) AS flow_product_{n}, abs(({flow('s', n)}) - ({flow('p', n)})) AS flow_gap_{n}, ln(1 + sum(sq) OVER {w(n)}) - ln(1 + sum(pq) OVER {w(n)}) AS volume_gap_{n}, ln(1 + sum(sn) OVER {w(n)} / {n}.0::DOUBLE) - ln(1 + sum(pn) OVER {w(n)} / {n}.0::DOUBLE) AS rate_gap_{n}" for n in widths]
    cols += [f"lag(sf, {k}) OVER {o} * pf AS lagged_product_{k}, lag(sf, {k}) OVER {o} - pf AS lagged_gap_{k}" for k in lags]
    names = [f"{c}_{n}" for n in widths for c in ("basis_change", "return_gap", "flow_product", "flow_gap", "volume_gap", "rate_gap")] + [f"{c}_{k}" for k in lags for c in ("lagged_product", "lagged_gap")]
    return (
        DENSE
        + f""", j AS (SELECT a.open_time, a.close AS sc, b.close AS pc, a.volume AS sv, b.volume AS pv, a.quote_volume AS sq, b.quote_volume AS pq, a.trade_count AS sn, b.trade_count AS pn, a.buy_volume AS sb, b.buy_volume AS pb, 10000 * (ln(b.close) - ln(a.close)) AS basis,
  CASE WHEN a.volume > 0 THEN (2 * a.buy_volume - a.volume) / a.volume ELSE 0 END AS sf, CASE WHEN b.volume > 0 THEN (2 * b.buy_volume - b.volume) / b.volume ELSE 0 END AS pf FROM dense a JOIN dense b ON a.open_time = b.open_time AND a.symbol = 'click' AND b.symbol = 'view'),
f AS (SELECT open_time, basis, {', '.join(cols)} FROM j) SELECT 'pair' AS symbol, open_time, round(basis, 6) AS basis, {', '.join(f'round({c}, 6) AS {c}' for c in names)} FROM f WHERE basis_change_{max(widths)} IS NOT NULL"""
    )


def _exits(s, d):
    q = views.quotes(s, d).select("symbol", "event_ms", "update_id", "bid", "ask")
    j = asof.asof_forward(q.withColumn("later", F.col("event_ms") + HOUR), q, "symbol", "later", "event_ms", "update_id", "exit_")
    return labels.cross_spread(j.where("exit_bid is not null"), 1.5).select("update_id", "long_gross", "short_gross", "long_net", "short_net")


QUERIES: dict[str, tuple[Query, str]] = {
    "F02_ema_truncated": (
        lambda s, d: features.ema_truncated(dense(s, d), 6),
        DENSE + f"SELECT symbol, open_time, round(list_reduce(list(close) OVER {frame_sql(12)}, lambda a, x: a * (1 - 2.0::DOUBLE / 7) + x * (2.0::DOUBLE / 7)), 6) AS ema FROM dense",
    ),
    "F05_activity": (
        lambda s, d: features.activity(dense(s, d)),
        DENSE + f"SELECT symbol, open_time, round(sum(quote_volume) OVER {frame_sql(24)} * 24.0::DOUBLE / count(*) OVER {frame_sql(24)}, 6) AS quote_volume_day, round(sum(trade_count) OVER {frame_sql(24)} * (24.0::DOUBLE / count(*) OVER {frame_sql(24)}), 6) AS trade_count_day FROM dense",
    ),
    "F07_rolling_corr": (
        lambda s, d: features.rolling_corr(dense(s, d), "close", "volume", 24),
        DENSE + f"SELECT symbol, open_time, round(CASE WHEN count(close) OVER {frame_sql(24)} = 24 THEN CASE WHEN var_pop(close) OVER {frame_sql(24)} > 1e-9 AND var_pop(volume) OVER {frame_sql(24)} > 1e-9 THEN corr(close, volume) OVER {frame_sql(24)} ELSE 0 END END, 6) AS corr FROM dense",
    ),
    "F09_zscore": (
        lambda s, d: features.zscore(dense(s, d), "close", 24),
        DENSE + f"SELECT symbol, open_time, round(CASE WHEN count(close) OVER {frame_sql(24)} = 24 THEN CASE WHEN stddev_pop(close) OVER {frame_sql(24)} > 1e-12 THEN (close - avg(close) OVER {frame_sql(24)}) / stddev_pop(close) OVER {frame_sql(24)} ELSE 0 END END, 6) AS z FROM dense",
    ),
    "F10_beta_residual": (
        lambda s, d: features.beta_residual(dense(s, d), 24, "click", ("view", "purchase")),
        R
        + f""", x AS (SELECT open_time, avg(r) FILTER (symbol = 'click') AS lead, avg(r) FILTER (symbol IN ('view', 'purchase')) AS peers FROM d GROUP BY 1),
m AS (SELECT d.symbol, d.open_time, d.r, CASE WHEN symbol = 'click' THEN peers ELSE lead END AS m FROM d JOIN x ON x.open_time = d.open_time WHERE CASE WHEN symbol = 'click' THEN peers ELSE lead END IS NOT NULL),
b AS (SELECT *, CASE WHEN count(r) OVER {frame_sql(24)} = 24 THEN CASE WHEN var_pop(m) OVER {frame_sql(24)} > 1e-15 THEN covar_pop(r, m) OVER {frame_sql(24)} / var_pop(m) OVER {frame_sql(24)} ELSE 0 END END AS beta FROM m)
SELECT symbol, open_time, round(beta, 6) AS beta, round(r - beta * m, 6) AS residual FROM b""",
    ),
    "F12_same_slot_ratio": (
        lambda s, d: features.same_slot_ratio(dense(s, d), "quote_volume", 7 * DAY),
        DENSE
        + f""", m AS (SELECT symbol, open_time, quote_volume AS v, avg(quote_volume) OVER (PARTITION BY symbol, open_time % {7 * DAY} ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m FROM dense)
SELECT symbol, open_time, round(CASE WHEN m > 0 THEN v / m WHEN m IS NOT NULL THEN 0 END, 6) AS slot_ratio FROM m""",
    ),
    "F16_flow_windows": (lambda s, d: features.flow_windows(dense(s, d), (3, 12)), _flow_sql((3, 12))),
    "F17_rolling_extreme": (
        lambda s, d: features.rolling_extreme(dense(s, d), 24),
        DENSE + f"SELECT symbol, open_time, round(CASE WHEN count(high) OVER {frame_sql(24)} = 24 THEN max(high) OVER {frame_sql(24)} END, 6) AS highest, round(CASE WHEN count(low) OVER {frame_sql(24)} = 24 THEN min(low) OVER {frame_sql(24)} END, 6) AS lowest FROM dense",
    ),
    "F18_basis": (
        lambda s, d: features.basis_features(*(dense(s, d).where(F.col("symbol") == name).withColumn("symbol", F.lit("pair")) for name in ("click", "view"))),
        _basis_sql((3, 12), (1, 2)),
    ),
    "F22_peer_context": (
        lambda s, d: features.peer_context(dense(s, d), "click"),
        R + ", x AS (SELECT open_time, r AS a FROM d WHERE symbol = 'click' AND r IS NOT NULL) SELECT a.symbol, a.open_time, round(avg(b.r), 6) AS peer_mean, round(stddev_pop(b.r), 6) AS peer_dispersion, round(any_value(a.r) - avg(b.r), 6) AS relative, round(coalesce(any_value(x.a), 0), 6) AS anchor_return, round(coalesce(any_value(a.r) - any_value(x.a), 0), 6) AS anchor_relative, any_value(x.a) IS NOT NULL AS anchor_available FROM d a LEFT JOIN x ON x.open_time = a.open_time JOIN d b ON a.open_time = b.open_time AND a.symbol <> b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2",
    ),
    "F24_decision_offsets": (
        lambda s, d: features.decision_offsets(hourly(s, d).select("symbol", "open_time"), "open_time", [30_000, 60_000, 240_000]),
        V + 'SELECT symbol, open_time, "offset", open_time + "offset" AS decision FROM v_bars, (VALUES (30000), (60000), (240000)) v("offset")',
    ),
    "F41_clip": (
        lambda s, d: features.clip_apply(views.trades(s, d).select("id", "symbol", "price"), features.clip_bounds(views.trades(s, d).where(F.col("id") % 2 == 0), "price", "symbol"), "price", "symbol").select("id", "price"),
        V + ", b AS (SELECT symbol, quantile_cont(price, 0.005) AS a, quantile_cont(price, 0.995) AS z FROM v_trades WHERE id % 2 = 0 GROUP BY 1) SELECT id, round(greatest(a, least(z, price)), 6) AS price FROM v_trades t LEFT JOIN b ON b.symbol = t.symbol",
    ),
    "F43_action_expand": (
        lambda s, d: features.action_expand(views.quotes(s, d).select("update_id", "bid_qty", "ask_qty", (F.col("bid_qty") - F.col("ask_qty")).alias("tilt")), ["tilt"], ("bid_qty", "ask_qty")),
        V + "SELECT update_id, CASE WHEN side = 1 THEN bid_qty ELSE ask_qty END AS bid_qty, CASE WHEN side = 1 THEN ask_qty ELSE bid_qty END AS ask_qty, (bid_qty - ask_qty) * side AS tilt, side FROM v_quotes, (VALUES (1), (-1)) v(side)",
    ),
    "F48_impact_cost": (
        lambda s, d: views.quotes(s, d).select("update_id", labels.impact_cost(F.lit(50.0), F.col("bid_qty") * F.col("bid"), (F.col("ask") - F.col("bid")) / F.col("bid") * 10_000, 12.0).alias("cost")),
        V + "SELECT update_id, round((ask - bid) / bid * 10000 / 2 + 12 * sqrt(50.0::DOUBLE / (bid_qty * bid)), 6) AS cost FROM v_quotes",
    ),
    "F49_fee_curve": (
        lambda s, d: views.predictions(s, d).select("id", features.fee(F.col("p"), F.col("weight"), 0.07).alias("fee")),
        V + ", r AS (SELECT id, weight * 0.07::DOUBLE * (p * (1 - p)) AS raw FROM v_predictions) SELECT id, round(CASE WHEN raw < 1e-5 THEN 0 ELSE ceil(round(raw * 1e5, 6)) / 1e5 END, 6) AS fee FROM r",
    ),
    "F52_size_eligibility": (
        lambda s, d: views.quotes(s, d).select("update_id", (F.lit(400.0) / (F.col("ask") * F.col("ask_qty")) <= 0.5).alias("long_ok"), (F.lit(400.0) / (F.col("bid") * F.col("bid_qty")) <= 0.5).alias("short_ok")),
        V + "SELECT update_id, 400.0::DOUBLE / (ask * ask_qty) <= 0.5 AS long_ok, 400.0::DOUBLE / (bid * bid_qty) <= 0.5 AS short_ok FROM v_quotes",
    ),
    "T02_lookahead_label": (
        lambda s, d: labels.lookahead_label(dense(s, d), 4, 0.01, 20),
        DENSE + f", f AS (SELECT symbol, open_time, lag(close, 20) OVER {BY} AS w, lead(close, 4) OVER {BY} / close - 1 AS f FROM dense) SELECT symbol, open_time, round(f, 6) AS future, (f >= 0.01)::INT AS label FROM f WHERE w IS NOT NULL AND f IS NOT NULL",
    ),
    "T03_vwap_target": (
        lambda s, d: labels.vwap_target(dense(s, d), 1, 3),
        DENSE + f", v AS (SELECT symbol, open_time, CASE WHEN volume > 0 THEN quote_volume / volume END AS v FROM dense) SELECT symbol, open_time, round(ln(lead(v, 4) OVER {BY} / lead(v, 1) OVER {BY}) * 10000, 6) AS target FROM v",
    ),
    "T04_cross_spread": (
        _exits,
        V
        + f""", j AS (SELECT a.update_id, a.bid, a.ask, b.bid AS xb, b.ask AS xa FROM v_quotes a ASOF JOIN v_quotes b ON a.symbol = b.symbol AND a.event_ms + {HOUR} <= b.event_ms)
SELECT update_id, round((xb / ask - 1) * 10000, 6) AS long_gross, round((1 - xa / bid) * 10000, 6) AS short_gross, round((xb / ask - 1) * 10000 - 3, 6) AS long_net, round((1 - xa / bid) * 10000 - 3, 6) AS short_net FROM j""",
    ),
    "T06_triple_barrier": (lambda s, d: labels.triple_barrier(dense(s, d), 12, 0.2, 0.3), _barrier(12, 0.2, 0.3)),
    "T07_stop_time": (lambda s, d: labels.triple_barrier(dense(s, d), 8, 0.15, None), _barrier(8, 0.15, None)),
    "T08_adaptive_barriers": (
        lambda s, d: labels.triple_barrier(labels.adaptive_distances(dense(s, d), 24, 6, (0.2, 0.05, 0.4), (0.4, 0.1, 0.8)), 6, "stop", "take"),
        _barrier(6, "stop", "take", ADAPTIVE, "wide"),
    ),
    "F40_factor_columns": (
        lambda s, d: factors.factor_columns(views.quotes(s, d).select("update_id", "bid", "ask", "bid_qty", "ask_qty"), {"tilt": "safe_divide(bid_qty - ask_qty, bid_qty + ask_qty)", "width": "clip(ask - bid, 0, 0.05) * 100", "bent": "tanh(minimum(bid_qty, ask_qty) - 3) + sign(bid_qty - 4)"}, {"bid": "price", "ask": "price", "bid_qty": "size", "ask_qty": "size"}).select("update_id", "tilt", "width", "bent"),
        V + "SELECT update_id, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 6) AS tilt, round(greatest(0, least(0.05::DOUBLE, ask - bid)) * 100, 6) AS width, round(tanh(least(bid_qty, ask_qty) - 3) + sign(bid_qty - 4), 6) AS bent FROM v_quotes",
    ),
    "T17_funding_episodes": (
        lambda s, d: labels.funding_episodes(funding(s, d).withColumn("rate", F.col("rate") - 3.0), 0.3),
        FUNDING
        + """, s AS (SELECT symbol, t, rate - 3 AS rate, CASE WHEN rate - 3 >= 0.3 THEN 1 WHEN rate - 3 <= -0.3 THEN -1 ELSE 0 END AS sign FROM f),
n AS (SELECT *, (sign <> coalesce(lag(sign) OVER (PARTITION BY symbol ORDER BY t), 9))::INT AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY t) AS run FROM n)
SELECT symbol, any_value(sign) AS sign, min(t) AS start, max(t) AS "end", count(*) AS events, round(sum(rate), 6) AS total FROM r WHERE sign <> 0 GROUP BY symbol, run""",
    ),
    "P01_assign_roles": (
        lambda s, d: labels.assign_roles(views.closed_trades(s, d).select("id", "entry", "exit"), "entry", "exit", ROLES).select("id", "role"),
        V + "SELECT id, role FROM v_closed JOIN (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in ROLES) + ") v(role, a, b) ON entry >= a AND exit < b",
    ),
    "P03_expanding_folds": (
        lambda s, d: labels.expanding_folds(views.closed_trades(s, d).select("id", "entry", "exit", "pnl"), "entry", "exit", CUTS, 300).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl")),
        V
        + ", x AS (SELECT fold, CASE WHEN exit < cut THEN 'train' WHEN entry >= cut AND exit < cut + 300 THEN 'evaluate' END AS part, pnl FROM v_closed, (VALUES "
        + ", ".join(f"({i}, {c})" for i, c in enumerate(CUTS))
        + ") v(fold, cut)) SELECT fold, part, count(*) AS n, round(sum(pnl), 6) AS pnl FROM x WHERE part IS NOT NULL GROUP BY 1, 2",
    ),
    "P06_inside_day": (lambda s, d: labels.inside_day(views.trades(s, d).select("id", "t"), "t", 2 * HOUR, 3 * HOUR), V + f"SELECT id, t FROM v_trades WHERE t % {DAY} >= {2 * HOUR} AND t % {DAY} + {3 * HOUR} < {DAY}"),
    "P07_day_chunks": (lambda s, d: labels.day_chunks(views.trades(s, d), "t"), V + f'SELECT day, day * {DAY} AS start, (day + 1) * {DAY} AS "end" FROM (SELECT unnest(generate_series(min(t) // {DAY}, max(t) // {DAY})) AS day FROM v_trades)'),
    "P09_recency_weights": (
        lambda s, d: labels.recency_weights(views.predictions(s, d).select("id", "day"), "day", 365.0),
        V + ", r AS (SELECT id, day, pow(2.0::DOUBLE, -((SELECT max(day) FROM v_predictions) - day) / 365.0::DOUBLE) AS raw FROM v_predictions) SELECT id, day, round(raw / avg(raw) OVER (), 6) AS weight FROM r",
    ),
    "P12_successive_halving": (
        lambda s, d: labels.successive_halving(views.observations(s, d), "source", "score", 5, 0.5),
        V + ", m AS (SELECT source, avg(score) AS s, count(*) AS n FROM v_obs GROUP BY 1 HAVING count(*) >= 5), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, source)::INT AS rank FROM m) SELECT source, round(s, 6) AS score, n, rank, rank <= ceil(count(*) OVER () * 0.5) AS kept FROM r",
    ),
}
