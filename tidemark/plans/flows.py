"""Queries of whole metric sets by window, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars, flows
from tidemark.plans.base import BY, DENSE, HOUR, Query, V, dense, frame_sql
from tidemark.sources import views

WIDTHS = (1, 2, 3, 6, 12, 24, 48)
MINUTE = 60_000

FLOW = (
    DENSE
    + """, c AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, sum(CASE WHEN buyer_is_maker THEN 0 ELSE price * qty END) AS bq, sum(CASE WHEN buyer_is_maker THEN price * qty ELSE 0 END) AS sq, count(*) AS a, sum(last_id - first_id + 1) AS k, max(price * qty) AS mq, sum((price * qty) ** 2) AS qq, max(t) AS lt FROM v_trades GROUP BY 1, 2),
x AS (SELECT d.symbol, d.open_time, d.high, d.low, d.close, coalesce(bq, 0) + coalesce(sq, 0) AS q, coalesce(bq, 0) - coalesce(sq, 0) AS s, coalesce(a, 0) AS a, coalesce(k, 0) AS k, coalesce(mq, 0) AS mq, coalesce(qq, 0) AS qq,
  coalesce(ln(d.close / lag(d.close) OVER (PARTITION BY d.symbol ORDER BY d.open_time)), 0) AS r, ln(1 + (d.open_time + 3600000 - last_value(lt IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1000.0::DOUBLE) AS log_age
  FROM dense d LEFT JOIN c ON c.symbol = d.symbol AND c.open_time = d.open_time)"""
)


def _market_sql() -> str:
    cols = []
    for n in WIDTHS:
        w = frame_sql(n)
        values = {
            "return": f"10000 * ln(close / lag(close, {n}) OVER {BY})",
            "path": f"10000 * sum(abs(r)) OVER {w}",
            "volatility": f"10000 * sqrt(sum(r * r) OVER {w})",
            "range": f"10000 * ln(max(high) OVER {w} / min(low) OVER {w})",
            "signed_flow": f"CASE WHEN sum(q) OVER {w} > 0 THEN sum(s) OVER {w} / sum(q) OVER {w} ELSE 0 END",
            "log_volume": f"ln(1 + sum(q) OVER {w})",
            "order_rate": f"sum(a) OVER {w} / {n}.0::DOUBLE",
            "log_mean_order": f"ln(1 + CASE WHEN sum(a) OVER {w} > 0 THEN sum(q) OVER {w} / sum(a) OVER {w} ELSE 0 END)",
            "log_max_order": f"ln(1 + max(mq) OVER {w})",
            "concentration": f"CASE WHEN sum(q) OVER {w} > 0 THEN sum(qq) OVER {w} / (sum(q) OVER {w}) ** 2 ELSE 0 END",
            "log_constituents": f"ln(1 + CASE WHEN sum(a) OVER {w} > 0 THEN sum(k) OVER {w} / sum(a) OVER {w} ELSE 0 END)",
            "zero_share": f"avg((a = 0)::INT::DOUBLE) OVER {w}",
        }
        cols += [f'CASE WHEN count(close) OVER {w} = {n} THEN {v} END AS "{k}_{n}"' for k, v in values.items()]
    outs = [f'round("{k}_{n}" + 1e-9::DOUBLE, 6) AS "{k}_{n}"' for n in WIDTHS for k in flows.METRICS]
    outs += [f'round("{k}_{n}" - lag("{k}_{n}", {n}) OVER {BY} + 1e-9::DOUBLE, 6) AS "{k}_change_{n}"' for n in WIDTHS for k in flows.CHANGED]
    return FLOW + f", y AS (SELECT symbol, open_time, log_age, {', '.join(cols)} FROM x) SELECT symbol, open_time, round(log_age + 1e-9::DOUBLE, 6) AS log_age, {', '.join(outs)} FROM y"


def _tape_sql(lookbacks: tuple[int, ...]) -> str:
    cols = []
    for n in lookbacks:
        w, cut = frame_sql(n), max(1, n // 2)
        early, late = (f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {a} PRECEDING AND {b})" for a, b in ((n - 1, f"{n - cut} PRECEDING"), (n - cut - 1, "CURRENT ROW")))
        total, large = f"sum(n) OVER {w}", f"CASE WHEN sum(n) OVER {w} > 0 THEN sum(mx) OVER {w} / sum(n) OVER {w} ELSE 0 END"
        values = {
            "buy_share": f"CASE WHEN {total} > 0 THEN sum(b) OVER {w} / {total} ELSE 0.5 END",
            "imbalance": f"CASE WHEN {total} > 0 THEN (sum(b) OVER {w} - sum(s) OVER {w}) / {total} ELSE 0 END",
            "count_imbalance": f"CASE WHEN sum(c) OVER {w} > 0 THEN (sum(nb) OVER {w} - sum(ns) OVER {w}) / sum(c) OVER {w} ELSE 0 END",
            "notional_surprise": f"tanh(CASE WHEN {total} > 0 THEN n / avg(n) OVER {w} - 1 ELSE 0 END)",
            "count_surprise": f"tanh(CASE WHEN sum(c) OVER {w} > 0 THEN c / avg(c) OVER {w} - 1 ELSE 0 END)",
            "large_share": large,
            "vwap_gap": "tanh(gap * 5000)",
            "range": f"tanh(avg(span) OVER {w} * 5000)",
            "drift": f"tanh(avg(drift) OVER {w} * 5000)",
            "silent": f"avg((n = 0)::INT::DOUBLE) OVER {w}",
            "shift": f"avg(f) OVER {late} - avg(f) OVER {early}",
            "flow_corr": f"CASE WHEN var_pop(f) OVER {w} * var_pop(r) OVER {w} > 1e-18 THEN covar_pop(f, r) OVER {w} / sqrt(var_pop(f) OVER {w} * var_pop(r) OVER {w}) ELSE 0 END",
            "flow_gap": f"f - avg(f) OVER {w}",
            "flow_z": f"tanh(CASE WHEN stddev_pop(f) OVER {w} > 1e-9 THEN (f - avg(f) OVER {w}) / stddev_pop(f) OVER {w} ELSE 0 END / 3)",
            "notional_shift": f"tanh(CASE WHEN {total} > 0 THEN (avg(n) OVER {late} - avg(n) OVER {early}) / avg(n) OVER {w} ELSE 0 END)",
            "large_pressure": f"({large}) * tanh(avg(f) OVER {w} * 3)",
        }
        cols += [f'round(CASE WHEN count(close) OVER {w} = {n} THEN {v} ELSE 0 END + 1e-9::DOUBLE, 6) AS "{k}_{n}"' for k, v in values.items()]
    return (
        DENSE
        + f""", k AS (SELECT symbol, t // 3600000 * 3600000 AS open_time, sum(CASE WHEN buyer_is_maker THEN 0 ELSE price * qty END) AS b, sum(CASE WHEN buyer_is_maker THEN price * qty ELSE 0 END) AS s, sum(price * qty) AS n, sum(qty) AS q, count(*) FILTER (NOT buyer_is_maker) AS nb, count(*) FILTER (buyer_is_maker) AS ns, max(price * qty) AS mx FROM v_trades GROUP BY 1, 2),
x AS (SELECT d.symbol, d.open_time, d.close, coalesce(b, 0) AS b, coalesce(s, 0) AS s, coalesce(n, 0) AS n, coalesce(nb, 0)::DOUBLE AS nb, coalesce(ns, 0)::DOUBLE AS ns, coalesce(nb + ns, 0)::DOUBLE AS c, coalesce(mx, 0) AS mx, coalesce((b - s) / n, 0) AS f, coalesce(close / lag(close) OVER (PARTITION BY d.symbol ORDER BY d.open_time) - 1, 0) AS r,
  coalesce(close / (n / q) - 1, 0) AS gap, CASE WHEN n > 0 THEN (high - low) / close ELSE 0 END AS span, CASE WHEN n > 0 THEN close / open - 1 ELSE 0 END AS drift FROM dense d LEFT JOIN k ON k.symbol = d.symbol AND k.open_time = d.open_time)
SELECT symbol, open_time, {', '.join(cols)} FROM x"""
    )


def _lifted(df, *plain: str):
    """Doubles a little above themselves, so that exact ties round alike on both sides."""
    return df.select(*plain, *[(F.col(c) + 1e-9).alias(c) for c in df.columns if c not in plain])


QUERIES: dict[str, tuple[Query, str]] = {
    "F05_activity_day": (
        lambda s, d: flows.activity_day(bars.trade_bars(views.trades(s, d), MINUTE), MINUTE).withColumn("quote_volume_day", F.col("quote_volume_day") / 1e6 + 1e-9),
        V
        + """, m AS (SELECT symbol, t // 60000 * 60000 AS open_time, sum(price * qty) AS q, sum(last_id - first_id + 1) AS n FROM v_trades GROUP BY 1, 2),
w AS (SELECT symbol, open_time, sum(q) OVER r AS q, sum(n) OVER r AS n, open_time + 60000 - min(open_time) OVER r AS o FROM m WINDOW r AS (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW))
SELECT symbol, open_time, least(o, 86400000) AS observed, round(CASE WHEN o < 300000 THEN 0 ELSE q * (86400000.0::DOUBLE / least(o, 86400000)) END / 1e6 + 1e-9::DOUBLE, 6) AS quote_volume_day, CASE WHEN o < 300000 THEN 0 ELSE round_even(n::DOUBLE * (86400000.0::DOUBLE / least(o, 86400000)), 0) END::BIGINT AS trade_count_day FROM w""",
    ),
    "F06_tape_windows": (lambda s, d: _lifted(flows.tape_windows(dense(s, d), bars.tape_buckets(views.trades(s, d), HOUR), (6, 24)), "symbol", "open_time"), _tape_sql((6, 24))),
    "F16_market_windows": (lambda s, d: _lifted(flows.market_windows(bars.dense_flow(views.trades(s, d), HOUR), WIDTHS, HOUR), "symbol", "open_time"), _market_sql()),
}
