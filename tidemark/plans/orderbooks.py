"""Queries of order books, windows of events and actions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import orderbook as ob
from tidemark.plans.base import BY, DENSE, HOUR, Query, V, dense
from tidemark.sources import views

MINUTES_30 = 1_800_000
#: The book before each book, and the changes of every level between the two.
CHANGES = (
    V
    + """, u AS (SELECT DISTINCT update_id, symbol, event_ms FROM v_levels), p AS (SELECT *, lag(update_id) OVER (PARTITION BY symbol ORDER BY event_ms, update_id) AS before FROM u),
was AS (SELECT p.update_id, p.symbol, side, price, qty FROM p JOIN v_levels l ON l.update_id = p.before), now AS (SELECT p.update_id, p.symbol, side, price, qty FROM p JOIN v_levels l ON l.update_id = p.update_id WHERE before IS NOT NULL),
moved AS (SELECT coalesce(n.update_id, w.update_id) AS update_id, coalesce(n.symbol, w.symbol) AS symbol, coalesce(n.side, w.side) AS side, coalesce(n.price, w.price) AS price, coalesce(n.qty, 0) - coalesce(w.qty, 0) AS d
  FROM now n FULL JOIN was w ON n.update_id = w.update_id AND n.side = w.side AND n.price = w.price)"""
)
STEPS = V + """, a AS (SELECT *, coalesce(ln(price / lag(price) OVER w), 0) AS r FROM v_trades WINDOW w AS (PARTITION BY symbol ORDER BY t, id)),
s AS (SELECT *, coalesce(abs(r * lag(r) OVER (PARTITION BY symbol ORDER BY t, id)), 0) AS bp FROM a)"""
SHAPE = """SELECT update_id, side, count(*)::DOUBLE AS n, sum(x) AS a, sum(x ** 2) AS b, sum(x ** 3) AS c, sum(x ** 4) AS d, sum(y) AS y, sum(x * y) AS xy, sum(x ** 2 * y) AS xxy"""


def _side(side: str) -> str:
    """Depths and walk of one side for the SQL of F29."""
    return f"sum(qty) FILTER (side = '{side}') AS {side}_depth, " + ", ".join(f"sum(qty) FILTER (side = '{side}' AND i < {n}) AS {side}_{n}" for n in (1, 5, 10, 20))


FEED = CHANGES + """, feed AS (SELECT *, update_id % 20 = 1 OR before IS NULL AS snapshot FROM p WHERE update_id % 17 <> 0),
near AS (SELECT *, NOT snapshot AND coalesce(before <> lag(update_id) OVER (PARTITION BY symbol ORDER BY event_ms, update_id), true) AS broken FROM feed),
seg AS (SELECT *, sum((snapshot OR broken)::INT) OVER (PARTITION BY symbol ORDER BY event_ms, update_id)::BIGINT AS segment FROM near),
good AS (SELECT *, bool_or(snapshot) OVER (PARTITION BY symbol, segment) AS ok FROM seg)"""


def _cut(name: str, k: int, side: str) -> str:
    return f"10000 * ln(close / lag(close, {k}) OVER {BY}) AS {side}_{name}_{k}"


def _share(k: int, side: str) -> str:
    w = f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN sum(volume) OVER {w} > 0 THEN sum(2 * buy_volume - volume) OVER {w} / sum(volume) OVER {w} ELSE 0 END AS {side}_share_{k}"


def _market(side: str, symbol: str) -> str:
    cols = ", ".join([_cut("return", k, side) for k in (1, 5, 15)] + [_share(k, side) for k in (1, 5, 15)])
    return f"SELECT open_time, close AS {side}_close, lag(close, 5) OVER {BY} AS {side}_past, {cols} FROM dense WHERE symbol = '{symbol}'"


LEAD_COLS = [f"{s}_{n}_{k}" for s in "ab" for n in ("return", "share") for k in (1, 5, 15)]

QUERIES: dict[str, tuple[Query, str]] = {
    "F25_exp_decay_flow": (
        lambda s, d: ob.exp_decay_flow(views.requests(s, d), views.trades(s, d), HOUR, 250),
        V
        + """, f AS (SELECT r.id, sum(CASE WHEN buyer_is_maker THEN 0 ELSE v END) AS buy, sum(CASE WHEN buyer_is_maker THEN v ELSE 0 END) AS sell
  FROM (SELECT r.id, buyer_is_maker, price * qty * 2.0::DOUBLE ** (-(r.t - 250 - t.t) / 3600000.0::DOUBLE) AS v FROM v_requests r LEFT JOIN v_trades t ON t.symbol = r.symbol AND t.t <= r.t - 250) r GROUP BY 1)
SELECT id, round(ln(1 + coalesce(buy + sell, 0) / 3600), 6) AS log_rate, round(CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell) ELSE 0 END, 6) AS imbalance FROM f""",
    ),
    "F26_event_decay_state": (
        lambda s, d: ob.event_decay_state(views.trades(s, d), HOUR, 2 * HOUR),
        V
        + """, g AS (SELECT *, coalesce(t - lag(t) OVER w > 7200000, true)::INT AS starts FROM v_trades WINDOW w AS (PARTITION BY symbol ORDER BY t, id)), s AS (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY t, id) AS run FROM g)
SELECT a.id, round(sum(2.0::DOUBLE ** (-(a.t - b.t) / 3600000.0::DOUBLE)), 6) AS n, round(sum(b.price * b.qty * 2.0::DOUBLE ** (-(a.t - b.t) / 3600000.0::DOUBLE)), 6) AS notional,
  round(sum(CASE WHEN b.buyer_is_maker THEN -1 ELSE 1 END * b.price * b.qty * 2.0::DOUBLE ** (-(a.t - b.t) / 3600000.0::DOUBLE)), 6) AS signed FROM s a JOIN s b ON b.symbol = a.symbol AND b.run = a.run AND (b.t < a.t OR b.t = a.t AND b.id <= a.id) GROUP BY 1""",
    ),
    "F29_book_metrics": (
        lambda s, d: ob.book_metrics(views.books(s, d), 5_000.0),
        V
        + f""", l AS (SELECT *, ln(1 + sum(qty) OVER w) AS y, abs(price - first_value(price) OVER w) / abs(last_value(price) OVER (PARTITION BY update_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(price) OVER w) AS x,
  first_value(price) OVER w AS best, greatest(0, least(price * qty, 5000 - coalesce(sum(price * qty) OVER (PARTITION BY update_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM v_levels WINDOW w AS (PARTITION BY update_id, side ORDER BY i)),
m AS ({SHAPE}, any_value(best) AS best, sum(take) / sum(take / price) AS vwap FROM l GROUP BY 1, 2),
z AS (SELECT *, n * (b * d - c * c) - a * (a * d - c * b) + b * (a * c - b * b) AS det FROM m),
f AS (SELECT update_id, side, best, vwap, (n * (xy * d - c * xxy) - y * (a * d - c * b) + b * (a * xxy - xy * b)) / det AS slope, (n * (b * xxy - xy * c) - a * (a * xxy - xy * b) + y * (a * c - b * b)) / det AS convexity FROM z),
q AS (SELECT update_id, {_side('bid')}, {_side('ask')} FROM v_levels GROUP BY 1)
SELECT q.update_id, round((b.best + a.best) / 2, 6) AS mid, round(a.best - b.best, 6) AS spread, round((a.best * bid_1 + b.best * ask_1) / (bid_1 + ask_1), 6) AS microprice, bid_depth, ask_depth,
  {', '.join(f'round((bid_{n} - ask_{n}) / (bid_{n} + ask_{n}), 6) AS imbalance_{n}' for n in (1, 5, 10, 20))},
  round(b.slope, 6) AS bid_slope, round(b.convexity, 6) AS bid_convexity, round(a.slope, 6) AS ask_slope, round(a.convexity, 6) AS ask_convexity,
  round(greatest(0, (a.vwap / a.best - 1) * 10000), 6) AS buy_impact, round(greatest(0, (1 - b.vwap / b.best) * 10000), 6) AS sell_impact
FROM q JOIN f b ON b.update_id = q.update_id AND b.side = 'bid' JOIN f a ON a.update_id = q.update_id AND a.side = 'ask'""",
    ),
    "F30_book_change_flow": (
        lambda s, d: ob.book_change_flow(views.requests(s, d), views.books(s, d), MINUTES_30),
        CHANGES
        + """, depth AS (SELECT p.update_id, l.side, (sum(qty) FILTER (l.update_id = p.update_id) + sum(qty) FILTER (l.update_id = p.before)) / 2 AS mean FROM p JOIN v_levels l ON l.update_id IN (p.update_id, p.before) WHERE before IS NOT NULL GROUP BY 1, 2),
c AS (SELECT m.update_id, m.side, sum(greatest(d, 0)) / any_value(mean) AS added, sum(greatest(-d, 0)) / any_value(mean) AS cancelled FROM moved m JOIN depth e ON e.update_id = m.update_id AND e.side = m.side GROUP BY 1, 2),
w AS (SELECT p.symbol, p.event_ms, b.added AS ba, b.cancelled AS bc, a.added AS aa, a.cancelled AS ac FROM p JOIN c b ON b.update_id = p.update_id AND b.side = 'bid' JOIN c a ON a.update_id = p.update_id AND a.side = 'ask')
SELECT r.id, round(coalesce(sum(ba), 0), 6) AS bid_added, round(coalesce(sum(bc), 0), 6) AS bid_cancelled, round(coalesce(sum(aa), 0), 6) AS ask_added, round(coalesce(sum(ac), 0), 6) AS ask_cancelled, count(w.symbol) AS updates
FROM v_requests r LEFT JOIN w ON w.symbol = r.symbol AND w.event_ms >= r.t - 1800000 AND w.event_ms < r.t GROUP BY 1""",
    ),
    "F32_book_walk_limit": (
        lambda s, d: views.books(s, d).select("update_id", book.walk_limit(F.col("asks"), F.lit(30.0), F.col("asks")[0]["price"] + 0.095, 0.02).alias("w")).select("update_id", "w.price", "w.fee"),
        V
        + """, l AS (SELECT *, min(price) OVER (PARTITION BY update_id) + 0.095::DOUBLE AS lim, coalesce(sum(qty) OVER (PARTITION BY update_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_levels WHERE side = 'ask'),
t AS (SELECT *, CASE WHEN price <= lim THEN greatest(0, least(qty, 30 - before)) ELSE 0 END AS take FROM l)
SELECT update_id, round(CASE WHEN sum(take) >= 30 THEN sum(take * price) / 30 END, 6) AS price, round(CASE WHEN sum(take) >= 30 THEN sum(take * 0.02::DOUBLE * price * (1 - price)) END, 6) AS fee FROM t GROUP BY 1""",
    ),
    "F33_level_bands": (
        lambda s, d: ob.band_profile(ob.level_bands(views.books(s, d))),
        CHANGES
        + """, k AS (SELECT m.symbol, m.side, m.update_id, m.price, any_value(d) AS d, count(w.price) FILTER (CASE m.side WHEN 'bid' THEN w.price > m.price ELSE w.price < m.price END) + 1 AS rank FROM moved m JOIN was w ON w.update_id = m.update_id AND w.side = m.side WHERE d <> 0 GROUP BY 1, 2, 3, 4)
SELECT symbol, side, CASE WHEN rank <= 5 THEN '1-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' ELSE 'outside' END AS band, count(*) AS n, round(sum(abs(d)), 6) AS moved FROM k GROUP BY 1, 2, 3""",
    ),
    "F34_sliding_event_windows": (
        lambda s, d: ob.sliding_quotes(views.requests(s, d), views.quotes(s, d), HOUR),
        V
        + """, m AS (SELECT symbol, event_ms, ask - bid AS spread, coalesce(abs(ln((bid + ask) / lag(bid + ask) OVER (PARTITION BY symbol ORDER BY event_ms, update_id))), 0) AS move FROM v_quotes)
SELECT r.id, count(m.symbol) AS updates, round(avg(spread), 6) AS mean_spread, round(max(spread), 6) AS max_spread, round(coalesce(sum(move), 0), 6) AS variation FROM v_requests r LEFT JOIN m ON m.symbol = r.symbol AND m.event_ms > r.t - 3600000 AND m.event_ms <= r.t GROUP BY 1""",
    ),
    "F36_price_windows": (
        lambda s, d: ob.price_windows(views.requests(s, d), views.trades(s, d), HOUR),
        STEPS
        + """, w AS (SELECT r.id, coalesce(sum(s.r) FILTER (s.t > r.t - 3600000), 0) AS log_return, coalesce(sum(s.r ** 2) FILTER (s.t > r.t - 3600000), 0) AS variance,
  pi() / 2 * greatest(0, coalesce(sum(bp) FILTER (s.t > r.t - 3600000) - arg_min(bp, (s.t, s.id)) FILTER (s.t > r.t - 3600000), 0)) AS bipower, count(s.t) AS n FROM v_requests r LEFT JOIN s ON s.symbol = r.symbol AND s.t BETWEEN r.t - 3600000 AND r.t GROUP BY 1)
SELECT id, round(log_return, 6) AS log_return, round(variance, 6) AS variance, round(bipower, 6) AS bipower, n, round(CASE WHEN variance > 0 THEN greatest(0, (variance - bipower) / variance) ELSE 0 END, 6) AS jump_share FROM w""",
    ),
    "F37_trade_windows": (
        lambda s, d: ob.trade_windows(views.requests(s, d), views.trades(s, d), HOUR),
        STEPS
        + """SELECT r.id, round(coalesce(sum(s.r), 0), 6) AS log_return, round(coalesce(sum(s.r ** 2), 0), 6) AS variance, round(coalesce(sum(price * qty), 0), 6) AS quote_volume,
  round(coalesce(sum(price * qty * CASE WHEN buyer_is_maker THEN -1 ELSE 1 END) / sum(price * qty), 0), 6) AS imbalance FROM v_requests r LEFT JOIN s ON s.symbol = r.symbol AND s.t > r.t - 3600000 AND s.t <= r.t GROUP BY 1""",
    ),
    "F39_lead_lag": (
        lambda s, d: ob.lead_lag(dense(s, d).where("symbol = 'click'"), dense(s, d).where("symbol = 'view'")),
        DENSE
        + f""", a AS ({_market('a', 'click')}), b AS ({_market('b', 'view')})
SELECT a.open_time, {', '.join(f'round({c}, 6) AS {c}' for c in LEAD_COLS)}, round(10000 * ln(b_close / a_close), 6) AS basis, round(10000 * ln(b_close / a_close) - 10000 * ln(b_past / a_past), 6) AS basis_change
FROM a JOIN b ON a.open_time = b.open_time WHERE a_return_15 IS NOT NULL AND b_return_15 IS NOT NULL""",
    ),
    "F42_robust_scaler": (
        lambda s, d: ob.robust_scale(views.trades(s, d).select("id", "price", "qty"), ob.robust_bounds(views.trades(s, d), ["price", "qty"], 5_000), ["price", "qty"]),
        V
        + """, p AS (SELECT price, qty FROM v_trades ORDER BY md5(id::VARCHAR) LIMIT 5000),
b AS (SELECT quantile_cont(price, 0.5) AS mp, (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / 1.349::DOUBLE AS sp, quantile_cont(qty, 0.5) AS mq, (quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25)) / 1.349::DOUBLE AS sq FROM p)
SELECT id, round(greatest(-8, least(8, (price - mp) / CASE WHEN sp > 0 THEN sp ELSE 1 END)), 6) AS price, round(greatest(-8, least(8, (qty - mq) / CASE WHEN sq > 0 THEN sq ELSE 1 END)), 6) AS qty FROM v_trades, b""",
    ),
    "F44_action_align": (
        lambda s, d: ob.action_align(views.quotes(s, d).select("update_id", "bid_qty", "ask_qty", (F.col("bid_qty") / (F.col("bid_qty") + F.col("ask_qty"))).alias("share"), (F.col("bid_qty") - F.col("ask_qty")).alias("pressure")), [("bid_qty", "ask_qty")], ["share"], ["pressure"]),
        V
        + """SELECT update_id, side::INT AS side, CASE WHEN side < 0 THEN ask_qty ELSE bid_qty END AS bid_qty, CASE WHEN side < 0 THEN bid_qty ELSE ask_qty END AS ask_qty,
  round(CASE WHEN side < 0 THEN 1 - bid_qty / (bid_qty + ask_qty) ELSE bid_qty / (bid_qty + ask_qty) END, 6) AS share, side * (bid_qty - ask_qty) AS pressure FROM v_quotes, (VALUES (1), (-1)) v(side)""",
    ),
    "F45_four_actions": (
        lambda s, d: ob.four_actions(views.quotes(s, d).select("update_id", "bid", "ask"), {"passive": 1.0, "aggressive": 4.0}),
        V
        + """SELECT update_id, round(bid, 6) AS bid, round(ask, 6) AS ask, style, side::INT AS side, round(p, 6) AS price, fee::DOUBLE AS fee_bps, round(side * (p / ((bid + ask) / 2) - 1) * 10000 + fee, 6) AS cost_bps
FROM (SELECT *, CASE WHEN (style = 'passive') = (side = 1) THEN bid ELSE ask END AS p FROM v_quotes, (VALUES ('passive', 1), ('aggressive', 4)) s(style, fee), (VALUES (1), (-1)) v(side))""",
    ),
    "F46_event_windows": (
        lambda s, d: ob.event_windows(views.trades(s, d), 8, HOUR).select("id", F.size("events").alias("n"), F.col("events")[0]["id"].alias("first_id"), F.aggregate("events", F.lit(0.0), lambda a, e: a + e["price"]).alias("total")),
        V
        + """, g AS (SELECT *, coalesce(t - lag(t) OVER w > 3600000, true)::INT AS starts FROM v_trades WINDOW w AS (PARTITION BY symbol ORDER BY t, id)), s AS (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY t, id) AS run FROM g)
SELECT id, count(*) OVER w AS n, first_value(id) OVER w AS first_id, round(sum(price) OVER w, 6) AS total FROM s WINDOW w AS (PARTITION BY symbol, run ORDER BY t, id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    ),
    "F47_liquidity_session": (
        lambda s, d: ob.liquidity_session(dense(s, d), 336, 0.5),
        DENSE
        + """, o AS (SELECT *, open_time % 604800000 // 3600000 AS slot FROM dense), m AS (SELECT *, count(*) OVER p AS n, median(volume) OVER p AS med, count(*) OVER q AS k, median(volume) OVER q AS smed FROM o
  WINDOW p AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 336 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol, slot ORDER BY open_time RANGE BETWEEN 1209600000 PRECEDING AND 1 PRECEDING)),
f AS (SELECT symbol, open_time, coalesce(n = 336 AND med > 0 AND volume < 0.35::DOUBLE * med, false) AS low, coalesce(n = 336 AND k >= 2 AND smed > 0 AND volume < 0.45::DOUBLE * smed, false) AS quiet FROM m)
SELECT symbol, open_time, low, quiet, round(0.5::DOUBLE + CASE WHEN low THEN 0.04 ELSE 0 END + CASE WHEN quiet THEN 0.01 ELSE 0 END, 6) AS threshold, round((CASE WHEN low THEN 0.5 ELSE 1 END)::DOUBLE * CASE WHEN quiet THEN 0.85 ELSE 1 END, 6) AS size FROM f""",
    ),
    "B01_rebuild_book": (
        lambda s, d: ob.rebuild_book(ob.book_feed(views.books(s, d), 20, 17)),
        FEED
        + """SELECT g.symbol, g.update_id, round(max(price) FILTER (side = 'bid'), 6) AS best_bid, round(min(price) FILTER (side = 'ask'), 6) AS best_ask, sum(qty) FILTER (side = 'bid') AS bid_depth, sum(qty) FILTER (side = 'ask') AS ask_depth,
  round((sum(qty) FILTER (side = 'bid') - sum(qty) FILTER (side = 'ask')) / sum(qty), 6) AS imbalance FROM good g JOIN v_levels l ON l.update_id = g.update_id WHERE ok GROUP BY 1, 2""",
    ),
    "B03_replay_merge": (
        lambda s, d: ob.merged_events(views.trades(s, d), views.quotes(s, d)),
        V + "SELECT symbol, t, 'trade' AS kind, id AS event, round(price, 6) AS value FROM v_trades UNION ALL SELECT symbol, event_ms, 'quote', update_id, round((bid + ask) / 2, 6) FROM v_quotes",
    ),
}
