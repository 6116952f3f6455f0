"""Queries of feature panels, spaced events, refit splits and capped weights, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import asof, bars, panels
from tidemark.plans.base import BY, DENSE, HOUR, TIE, Query, V, dense, frame_sql, hourly
from tidemark.plans.evidence import VR
from tidemark.sources import views

CUT = 1_705_276_800_000


def _back(a: int, b: int) -> str:
    return f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


F24, F48, F12 = frame_sql(24), frame_sql(48), frame_sql(12)
FLOW = "CASE WHEN volume > 0 THEN (2 * buy_volume - volume) / volume ELSE 0 END"
TAPE = {
    "buy_share": f"CASE WHEN sum(volume) OVER {F24} > 0 THEN sum(buy_volume) OVER {F24} / sum(volume) OVER {F24} ELSE 0.5 END",
    "imbalance": f"CASE WHEN sum(volume) OVER {F24} > 0 THEN sum(2 * buy_volume - volume) OVER {F24} / sum(volume) OVER {F24} ELSE 0 END",
    "surprise": f"tanh(ln((1 + sum(quote_volume) OVER {F24}) / (1 + sum(quote_volume) OVER {_back(47, 24)})))",
    "vwap_gap": f"CASE WHEN sum(volume) OVER {F24} > 0 THEN close / (sum(quote_volume) OVER {F24} / sum(volume) OVER {F24}) - 1 ELSE close - 1 END",
    "range": f"avg((high - low) / close) OVER {F24}",
    "drift": f"avg(close / open - 1) OVER {F24}",
    "silent": f"avg((trade_count = 0)::INT::DOUBLE) OVER {F24}",
    "shift": f"avg(f) OVER {F12} - avg(f) OVER {_back(23, 12)}",
    "flow_corr": f"CASE WHEN var_pop(f) OVER {F24} * var_pop(r) OVER {F24} > 1e-18 THEN covar_pop(f, r) OVER {F24} / sqrt(var_pop(f) OVER {F24} * var_pop(r) OVER {F24}) ELSE 0 END",
}


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = hourly(spark, sf_dir).where("trade_count >= 2").select("symbol", "open_time", (F.col("close") - 345).alias("value"))
    return bars.clock_spine(hourly(spark, sf_dir), HOUR).join(seen, ["symbol", "open_time"], "left")


def _exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book with the one an hour later, at the latest known then."""
    b = views.books(spark, sf_dir)
    later = asof.asof_join(b.withColumn("later", F.col("event_ms") + HOUR), b, "symbol", "later", "event_ms", "update_id", "x_")
    entry, out = book.walk(F.col("asks"), F.lit(30.0)), book.walk(F.col("x_bids"), F.lit(30.0))
    return later.select("update_id", F.col("x_update_id").alias("exit_id"), (10_000 * (out / entry - 1)).alias("payoff"))


def _shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.trades(spark, sf_dir).select("id", "symbol", "t", (F.col("price") / 345).alias("ratio"))
    return panels.shock_events(rows, 0.8, 1.05, CUT, 6 * HOUR)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    rows = a.select("id", (F.col("id") % 7 != 0).alias("available"), F.when(F.col("id") % 5 != 0, F.col("t") + 100).alias("fill_t"), F.when(F.col("id") % 11 != 0, F.col("end")).alias("exit_t"), "net")
    return panels.action_label(rows, 0.25)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.predictions(spark, sf_dir).withColumn("exit", F.col("day") + F.col("weight").cast("long"))


QUERIES: dict[str, tuple[Query, str]] = {
    "F06_tape_features": (
        lambda s, d: panels.tape_features(dense(s, d), 24),
        DENSE
        + f""", x AS (SELECT *, coalesce(close / lag(close) OVER {BY} - 1, 0) AS r, {FLOW} AS f FROM dense)
SELECT symbol, open_time, {', '.join(f'round(CASE WHEN count(close) OVER {F48} = 48 THEN {v} END, 6) AS "{k}"' for k, v in TAPE.items())} FROM x""",
    ),
    "F08_panel_features": (
        lambda s, d: panels.panel_features(dense(s, d), (1, 6, 24), 24),
        DENSE
        + f""", x AS (SELECT *, ln(close / lag(close) OVER {BY}) AS r FROM dense), c AS (SELECT open_time, stddev_pop(r) AS dispersion, abs(avg(sign(r))) AS agreement, avg(r) AS mean FROM x GROUP BY 1),
y AS (SELECT symbol, open_time, r, {', '.join(f'ln(close / lag(close, {k}) OVER {BY}) AS return_{k}' for k in (1, 6, 24))}, count(r) OVER {F24} = 24 AS ok, sqrt(avg(r ** 2) OVER {F24}) AS vol, sqrt(avg(CASE WHEN r IS NULL THEN 0 ELSE least(r, 0) END ** 2) OVER {F24}) AS down,
  CASE WHEN avg(volume) OVER {F24} > 0 THEN volume / avg(volume) OVER {F24} ELSE 0 END AS vr, CASE WHEN stddev_pop(close) OVER {F24} > 1e-9 THEN (close - avg(close) OVER {F24}) / stddev_pop(close) OVER {F24} ELSE 0 END AS z FROM x)
SELECT symbol, y.open_time, {', '.join(f'round(return_{k}, 6) AS return_{k}' for k in (1, 6, 24))}, round(CASE WHEN ok THEN vol END, 6) AS volatility, round(CASE WHEN ok THEN down END, 6) AS semivolatility, round(CASE WHEN ok THEN vr END, 6) AS volume_ratio, round(CASE WHEN ok THEN z END, 6) AS z,
  round(dispersion, 6) AS dispersion, round(agreement, 6) AS agreement, round(r - mean, 6) AS residual FROM y JOIN c ON c.open_time = y.open_time""",
    ),
    "F14_premium_features": (
        lambda s, d: panels.premium_features(_spine(s, d), 24, 0.5),
        DENSE
        + f""", o AS (SELECT s.symbol, s.open_time, CASE WHEN trade_count >= 2 THEN close - 345 END AS v FROM spine s LEFT JOIN v_bars b ON b.symbol = s.symbol AND b.open_time = s.open_time),
w AS (SELECT *, count(v) OVER {F24} AS n, count(*) OVER {F24} = 24 AND count(v) OVER {F24} >= 12 AS ok, avg(v) OVER {F24} AS m, stddev_pop(v) OVER {F24} AS sd, avg((v > 0)::INT::DOUBLE) OVER {F24} AS pos, max(CASE WHEN v IS NOT NULL THEN open_time END) OVER {F24} AS last FROM o)
SELECT symbol, open_time, round(CASE WHEN ok THEN m END, 6) AS mean, round(CASE WHEN ok THEN sd END, 6) AS deviation, round(CASE WHEN ok AND v IS NOT NULL THEN CASE WHEN sd > 1e-9 THEN (v - m) / sd ELSE 0 END END, 6) AS z, round(CASE WHEN ok THEN pos END, 6) AS positive, round(n / 24.0::DOUBLE, 6) AS observed, open_time - last AS age FROM w""",
    ),
    "F19_leader_features": (
        lambda s, d: panels.leader_features(dense(s, d), "click"),
        DENSE
        + f""", x AS (SELECT symbol, open_time, 10000 * ln(close / lag(close) OVER {BY}) AS r, {FLOW} AS f FROM dense), y AS (SELECT * FROM x WHERE r IS NOT NULL),
c AS (SELECT open_time, avg(r) AS rm, stddev_pop(r) AS rd, abs(avg(sign(r))) AS ag, avg(f) AS fm, stddev_pop(f) AS fd, max(r) FILTER (symbol = 'click') AS lr, max(f) FILTER (symbol = 'click') AS lf, avg(r) FILTER (symbol <> 'click') AS xr, avg(f) FILTER (symbol <> 'click') AS xf FROM y GROUP BY 1)
SELECT symbol, y.open_time, round(rm, 6) AS return_mean, round(rd, 6) AS return_dispersion, round(ag, 6) AS agreement, round(fm, 6) AS flow_mean, round(fd, 6) AS flow_dispersion, round(CASE symbol WHEN 'click' THEN xr ELSE lr END, 6) AS leader_return, round(CASE symbol WHEN 'click' THEN xf ELSE lf END, 6) AS leader_flow FROM y JOIN c ON c.open_time = y.open_time""",
    ),
    "F23_flow_history": (
        lambda s, d: panels.flow_history(views.trades(s, d), dense(s, d), HOUR, 24),
        DENSE
        + f""", c AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, sum(price * qty) AS q, sum((price * qty) ** 2) AS qq, sum(CASE WHEN buyer_is_maker THEN -price * qty ELSE price * qty END) AS sq FROM v_trades GROUP BY 1, 2),
x AS (SELECT d.symbol, d.open_time, coalesce(q, 0) AS q, coalesce(qq, 0) AS qq, coalesce(sq, 0) AS sq, ln(close / lag(close) OVER (PARTITION BY d.symbol ORDER BY d.open_time)) AS r FROM dense d LEFT JOIN c ON c.symbol = d.symbol AND c.open_time = d.open_time),
w AS (SELECT symbol, open_time, count(r) OVER {F24} = 24 AS ok, sum(r) OVER {F24} AS lr, sum(r ** 2) OVER {F24} AS v, sum(q) OVER {F24} AS q, sum(sq) OVER {F24} AS sq, sum(qq) OVER {F24} AS qq FROM x)
SELECT symbol, open_time, round(CASE WHEN ok THEN lr END, 6) AS log_return, round(CASE WHEN ok THEN v END, 6) AS variance, round(CASE WHEN ok THEN ln(1 + q) END, 6) AS log_volume, round(CASE WHEN ok THEN CASE WHEN q > 0 THEN sq / q ELSE 0 END END, 6) AS signed_share, round(CASE WHEN ok THEN CASE WHEN q > 0 THEN qq / (q * q) ELSE 0 END END, 6) AS concentration FROM w""",
    ),
    "F50_depth_stress": (
        lambda s, d: panels.depth_stress(views.books(s, d), 5, 20),
        V
        + """, x AS (SELECT update_id, sum(price * qty) FILTER (i < 5) AS n, sum(price * qty) AS w, sum(qty) FILTER (i < 5 AND side = 'bid') AS b, sum(qty) FILTER (i < 5 AND side = 'ask') AS a FROM v_levels GROUP BY 1)
SELECT update_id, round(-ln(1 + n), 6) AS thinness, round(abs((b - a) / (b + a)), 6) AS imbalance, round(ln(1 + w) - ln(1 + n), 6) AS concentration FROM x""",
    ),
    "T11_shock_events": (
        _shocks,
        VR
        + f""", c AS (SELECT symbol, quantile_disc(price / 345, 0.8) AS cut FROM v_trades WHERE t < {CUT} GROUP BY 1), k AS (SELECT id, v.symbol, t, price / 345 AS ratio, row_number() OVER (PARTITION BY v.symbol ORDER BY t, id) AS n FROM v_trades v JOIN c ON c.symbol = v.symbol WHERE price / 345 >= cut AND price / 345 >= 1.05),
nx AS (SELECT a.symbol, a.n, min(b.n) AS m FROM k a JOIN k b ON b.symbol = a.symbol AND b.n > a.n AND b.t >= a.t + 21600000 GROUP BY 1, 2), walk AS (SELECT symbol, n FROM k WHERE n = 1 UNION ALL SELECT w.symbol, nx.m FROM walk w JOIN nx ON nx.symbol = w.symbol AND nx.n = w.n)
SELECT id, k.symbol, t, round(ratio, 6) AS ratio FROM walk JOIN k ON k.symbol = walk.symbol AND k.n = walk.n""",
    ),
    "T14_meta_labels": (
        lambda s, d: panels.meta_samples(views.actions(s, d).select("id", "symbol", "t", "score", "net"), views.trades(s, d).select("symbol", "t", "price")),
        V + "SELECT a.id, a.symbol, a.t, round(score, 6) AS score, net, round(price, 6) AS price, net > 0 AS paid, round(abs(score), 6) AS strength FROM v_actions a JOIN v_trades r ON r.symbol = a.symbol AND r.t = a.t",
    ),
    "T15_action_label": (
        _labels,
        V
        + """, s AS (SELECT id, net, CASE WHEN id % 7 = 0 THEN 'unavailable' WHEN id % 5 = 0 THEN 'no_fill' WHEN id % 11 = 0 THEN 'failed_exit' ELSE 'round_trip' END AS state FROM v_actions)
SELECT id, state, round(CASE state WHEN 'round_trip' THEN net - 0.25 WHEN 'failed_exit' THEN -0.25 WHEN 'no_fill' THEN 0 END, 6) AS utility FROM s""",
    ),
    "T16_book_payoff": (
        _exits,
        V
        + """, u AS (SELECT DISTINCT update_id, symbol, event_ms FROM v_levels), c AS (SELECT *, greatest(0, least(qty, 30 - coalesce(sum(qty) OVER (PARTITION BY update_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM v_levels),
w AS (SELECT update_id, sum(take * price) FILTER (side = 'ask') / 30 AS buy, sum(take * price) FILTER (side = 'bid') / 30 AS sell FROM c GROUP BY 1),
j AS (SELECT a.update_id, b.update_id AS exit_id FROM u a ASOF JOIN u b ON a.symbol = b.symbol AND a.event_ms + 3600000 >= b.event_ms)
SELECT j.update_id, exit_id, round(10000 * (x.sell / e.buy - 1), 6) AS payoff FROM j JOIN w e ON e.update_id = j.update_id JOIN w x ON x.update_id = exit_id""",
    ),
    "P02_walk_forward": (
        lambda s, d: panels.walk_forward(_predictions(s, d), 30, 1, 20).withColumns({"train_rate": F.col("train_rate") + TIE, "eval_rate": F.col("eval_rate") + TIE}),
        V
        + """, r AS (SELECT day, y, day + weight::BIGINT AS exit FROM v_predictions), e AS (SELECT day AS eval_day, count(*) AS eval_rows, avg(y) AS eval_rate FROM r GROUP BY 1)
SELECT eval_day, any_value(eval_rows) AS eval_rows, round(any_value(eval_rate) + 1e-9, 6) AS eval_rate, count(*) AS train_rows, round(avg(y) + 1e-9, 6) AS train_rate FROM e JOIN r ON r.day BETWEEN eval_day - 31 AND eval_day - 2 AND r.exit < eval_day GROUP BY 1 HAVING count(*) >= 20""",
    ),
    "P04_monthly_refit": (
        lambda s, d: panels.monthly_refit(_predictions(s, d), 3),
        V
        + """, m AS (SELECT year(DATE '1970-01-01' + day::INT) * 12 + month(DATE '1970-01-01' + day::INT) - 1 AS m, count(*) AS n FROM v_predictions GROUP BY 1)
SELECT a.m::INT AS month, sum(b.n)::BIGINT AS train_rows, any_value(a.n) AS eval_rows FROM m a JOIN m b ON b.m BETWEEN a.m - 3 AND a.m - 1 GROUP BY 1""",
    ),
    "P08_calendar_windows": (
        lambda s, d: panels.calendar_windows(_predictions(s, d), 180, 30, 30),
        V + ", e AS (SELECT min(day) AS a, max(day) AS b FROM v_predictions) SELECT f AS train_from, f + 180 AS test_from, f + 210 AS test_until FROM (SELECT unnest(generate_series(a, b + 1 - 210, 30)) AS f FROM e)",
    ),
    "E36_capped_weights": (
        lambda s, d: panels.capped_weights(views.closed_trades(s, d).groupBy("symbol", "exit").agg(F.sum("pnl").alias("pnl")).groupBy("symbol").agg((1 / F.stddev_pop("pnl")).alias("inverse")), 0.4),
        V
        + """, d AS (SELECT symbol, exit, sum(pnl) AS pnl FROM v_closed GROUP BY 1, 2), i AS (SELECT symbol, 1 / stddev_pop(pnl) AS v FROM d GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY v DESC, symbol) - 1 AS i, sum(v) OVER (ORDER BY v DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, least(1, 0.4::DOUBLE * count(*) OVER ()) AS budget FROM i),
f AS (SELECT min(i) AS k FROM o WHERE (budget - i * 0.4::DOUBLE) * v / rest <= 0.4::DOUBLE + 1e-12), g AS (SELECT k, budget - k * 0.4::DOUBLE AS l, rest AS r FROM f JOIN o ON o.i = f.k)
SELECT symbol, round(CASE WHEN i < k THEN 0.4::DOUBLE ELSE l * v / r END, 6) AS weight FROM o, g""",
    ),
}
