"""Queries of outcomes and of the grid of signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars, outcomes, signalgrid
from tidemark.plans.base import DAY, HOUR, TIE, Query, V
from tidemark.sources import views

# Hours stand for seconds throughout, since events are minutes to hours apart.
STRESS = {"horizon": 2 * HOUR, "lags": {"near": 3 * HOUR, "far": 8 * HOUR}, "max_age": 5 * HOUR, "max_gap": 9 * HOUR}
DEPTH = ["imbalance", "spread", "size"]


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.quotes(spark, sf_dir)
    size = F.col("bid_qty") + F.col("ask_qty")
    rows = q.select("symbol", F.col("event_ms").alias("t"), ((F.col("bid_qty") - F.col("ask_qty")) / size).alias("imbalance"), ((F.col("ask") - F.col("bid")) * 100).alias("spread"), size.alias("size"))
    out = outcomes.depth_stress_examples(rows, DEPTH, **STRESS)
    return out.select(*[F.round(F.col(c) + TIE, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


def _stress_sql() -> str:
    h, age, gap = STRESS["horizon"], STRESS["max_age"], STRESS["max_gap"]
    names = {"pre": 0} | STRESS["lags"]
    known = lambda n, o: f"(SELECT max(t) FROM sg WHERE sg.symbol = an.symbol AND sg.t <= an.anchor - {o}) AS {n}_t"
    joins = " ".join(f"JOIN sg {n} ON {n}.symbol = tk.symbol AND {n}.t = tk.{n}_t" for n in [*names, "post"])
    fresh = " AND ".join(f"anchor - {o} - {n}_t <= {age} AND {n}.segment = pre.segment" for n, o in names.items())
    cells = [f"pre.{c} AS {c}" for c in DEPTH] + [f"round(pre.{c} - im.{c} + 1e-9::DOUBLE, 6) AS {c}_change" for c in DEPTH] + [f"round(pre.{c} - {n}.{c} + 1e-9::DOUBLE, 6) AS {c}_{n}" for n in STRESS["lags"] for c in DEPTH]
    cells = [c if "round" in c else f"round({c.split(' AS ')[0]} + 1e-9::DOUBLE, 6) AS {c.split(' AS ')[1]}" for c in cells] + [f"round(post.{c} + 1e-9::DOUBLE, 6) AS post_{c}" for c in DEPTH]
    turns = [f"round({k}(2 * pi() * {v}) + 1e-9::DOUBLE, 6) AS {n}_{k}" for n, v in (("hour", "(anchor % 86400000 / 86400000)"), ("weekday", "((anchor // 86400000 + 3) % 7 / 7)")) for k in ("sin", "cos")]
    return (
        V
        + f""", sn AS (SELECT symbol, event_ms AS t, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS imbalance, (ask - bid) * 100 AS spread, bid_qty + ask_qty AS size FROM v_quotes
  QUALIFY row_number() OVER (PARTITION BY symbol, event_ms ORDER BY (bid_qty - ask_qty) / (bid_qty + ask_qty) DESC, (ask - bid) * 100 DESC, bid_qty + ask_qty DESC) = 1),
br AS (SELECT *, lag(t) OVER w AS before, lag(t) OVER w IS NULL OR t - lag(t) OVER w > {gap} OR date_trunc('month', make_timestamp(t * 1000)) <> date_trunc('month', make_timestamp(lag(t) OVER w * 1000)) AS fresh FROM sn WINDOW w AS (PARTITION BY symbol ORDER BY t)),
sg AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY symbol ORDER BY t) AS segment FROM br),
en AS (SELECT symbol, min(t) AS a, max(t) AS z FROM sg GROUP BY symbol, segment),
an AS (SELECT symbol, unnest(generate_series((a + {h - 1}) // {h} * {h}, z - {h}, {h})) AS anchor FROM en),
tk AS (SELECT symbol, anchor, {', '.join(known(n, o) for n, o in names.items())}, (SELECT min(t) FROM sg WHERE sg.symbol = an.symbol AND sg.t >= an.anchor + {h}) AS post_t FROM an)
SELECT tk.symbol, anchor, pre_t, post_t, anchor // 86400000 AS day, (year(make_timestamp(anchor * 1000)) * 12 + month(make_timestamp(anchor * 1000)) - 1)::INT AS month, {', '.join(cells + turns)}
FROM tk {joins} JOIN sg im ON im.symbol = tk.symbol AND im.t = pre.before WHERE {fresh} AND im.segment = pre.segment AND post.segment = pre.segment AND post_t - anchor - {h} <= {age}"""
    )


LATENCY, AHEAD, QUOTE_AGE, COST, NOTIONAL, SHARE = 20 * 60_000, 3 * HOUR, 4 * HOUR, 4.5, 400.0, 0.8


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.trades(spark, sf_dir)
    return outcomes.horizon_path(t.select("symbol", bars.bucket("t", HOUR).alias("t")), views.quotes(spark, sf_dir), LATENCY, AHEAD, COST, NOTIONAL, SHARE, QUOTE_AGE)


def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _path(spark, sf_dir)
    return out.select(*[F.round(F.col(c) + TIE, 5).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


def _sides_sql(a: str, z: str, p: str) -> dict[str, str]:
    bought, sold = f"{z}.bid / {a}.ask", f"{z}.ask / {a}.bid"
    return {
        f"{p}_long_gross": f"({bought} - 1) * 10000", f"{p}_short_gross": f"(1 - {sold}) * 10000",
        f"{p}_long_net": f"({bought} - 1) * 10000 - {COST} * (1 + {bought})", f"{p}_short_net": f"(1 - {sold}) * 10000 - {COST} * (1 + {sold})",
        f"{p}_long_liquid": f"greatest({NOTIONAL} / {a}.ask / {a}.ask_qty, {NOTIONAL} / {a}.ask / {z}.bid_qty) <= {SHARE}", f"{p}_short_liquid": f"greatest({NOTIONAL} / {a}.bid / {a}.bid_qty, {NOTIONAL} / {a}.bid / {z}.ask_qty) <= {SHARE}",
    }


def _horizon_base() -> str:
    ok = lambda q, at: f"coalesce({at} - {q}.event_ms <= {QUOTE_AGE} AND {q}.bid > 0 AND {q}.bid < {q}.ask AND {q}.bid_qty > 0 AND {q}.ask_qty > 0, false)"
    cells = _sides_sql("a.d", "b.d", "delayed") | {n: f"CASE WHEN a.ok AND b.ok THEN {c} END" for n, c in _sides_sql("a.m", "b.m", "zero").items() if "gross" not in n}
    cells |= {n: f"coalesce({c}, false)" for n, c in cells.items() if n.endswith("liquid")}
    return (
        V
        + f""", ts AS (SELECT DISTINCT symbol, t // 3600000 * 3600000 AS t FROM v_trades),
qs AS (SELECT * FROM v_quotes QUALIFY row_number() OVER (PARTITION BY symbol, event_ms ORDER BY update_id DESC) = 1),
j1 AS (SELECT ts.symbol, ts.t, qs AS d FROM ts ASOF LEFT JOIN qs ON qs.symbol = ts.symbol AND ts.t + {LATENCY} >= qs.event_ms),
j2 AS (SELECT j1.symbol, t, d, qs AS m FROM j1 ASOF LEFT JOIN qs ON qs.symbol = j1.symbol AND j1.t >= qs.event_ms),
de AS (SELECT *, {ok('m', 't')} AS ok, row_number() OVER (PARTITION BY symbol ORDER BY t) AS place FROM j2 WHERE {ok('d', f't + {LATENCY}')}),
ho AS (SELECT a.symbol, a.t, a.place, b.t AS future_t, ((b.d.bid + b.d.ask) / (a.d.bid + a.d.ask) - 1) * 10000 AS delayed_mid_return, a.ok AND b.ok AS zero_valid, {', '.join(f'{c} AS {n}' for n, c in cells.items())},
  (SELECT max(place) FROM de c WHERE c.symbol = a.symbol AND c.t <= a.t + {AHEAD + LATENCY}) AS last FROM de a JOIN de b ON a.symbol = b.symbol AND b.t = a.t + {AHEAD} AND a.t // 86400000 = b.t // 86400000)"""
    )


def _horizon_sql() -> str:
    doubles = ["delayed_mid_return", *[n for n in (*_sides_sql("", "", "delayed"), *_sides_sql("", "", "zero")) if not n.endswith("liquid") and n not in ("zero_long_gross", "zero_short_gross")]]
    flags = [f"{p}_{s}_liquid" for p in ("delayed", "zero") for s in ("long", "short")]
    return (
        _horizon_base()
        + f""", op AS (SELECT de.symbol, de.place, count(*) AS n FROM de JOIN ho ON ho.symbol = de.symbol AND de.place BETWEEN ho.place AND ho.last GROUP BY 1, 2),
un AS (SELECT ho.symbol, ho.t, avg(1.0::DOUBLE / op.n) AS u FROM ho JOIN op ON op.symbol = ho.symbol AND op.place BETWEEN ho.place AND ho.last GROUP BY 1, 2)
SELECT ho.symbol, ho.t, future_t, zero_valid, {', '.join(flags)}, {', '.join(f'round({c} + 1e-9::DOUBLE, 5) AS {c}' for c in doubles)}, round(u / avg(u) OVER (PARTITION BY ho.symbol) + 1e-9::DOUBLE, 5) AS uniqueness FROM ho JOIN un ON un.symbol = ho.symbol AND un.t = ho.t"""
    )


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.horizon_exclusion_counts(_path(spark, sf_dir))


EXCLUSIONS_SQL = (
    _horizon_base()
    + " SELECT symbol, count(*) AS rows, count(*) FILTER (NOT zero_valid) AS zero_invalid, "
    + ", ".join(f"count(*) FILTER ({seen} AND NOT {p}_{s}_liquid) AS {p}_{s}_thin" for p, seen in (("delayed", "true"), ("zero", "zero_valid")) for s in ("long", "short"))
    + " FROM ho GROUP BY 1"
)

STEP, LIFE, GUARD, MARKS = HOUR // 4, 10 * HOUR, 2 * HOUR, {"short": 3 * HOUR, "long": 6 * HOUR}


def payoff(adverse: bool) -> Query:
    """Exits of trades over a path of quarter hours, blocks of two hours."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = bars.quote_path(views.quotes(spark, sf_dir), STEP).select("symbol", F.col("open_time").alias("t"), "min_bid", "max_bid", F.col("last_bid").alias("close_bid"), "min_ask", "max_ask", F.col("last_ask").alias("close_ask"))
        stop = 800 + F.col("id") % 5 * 400
        acts = views.actions(spark, sf_dir, "price").select("id", "symbol", "t", "side", F.col("price").alias("entry"), stop.alias("stop"), (stop * 1.5).alias("take"), F.lit(2.0).alias("entry_cost"), F.lit(4.0).alias("exit_cost"))
        out = outcomes.path_payoff(acts, path, STEP, LIFE, GUARD, 6 * HOUR, MARKS, adverse, adverse, block=2 * HOUR)
        return out.select(*[F.round(F.col(c) + TIE, 5).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])

    return query


def _payoff_sql(adverse: bool) -> str:
    asked = {"pr": GUARD, "fx": LIFE} | {f"m_{n}": o for n, o in MARKS.items()}
    start = f"(t + {STEP - 1}) // {STEP} * {STEP}" if adverse else f"t + {GUARD}"
    chain, joins = "ac", ""
    for n, o in asked.items():
        joins += f" LEFT JOIN pa {n} ON {n}.symbol = ac.symbol AND {n}.t = (SELECT max(p.t) FROM pa p WHERE p.symbol = ac.symbol AND p.t + {STEP} <= ac.t + {o})"
    known = " AND ".join(f"coalesce(ac.t + {o} - {n}.t - {STEP} <= {6 * HOUR}, false)" for n, o in asked.items())
    met = ("min_bid", "max_ask") if adverse else ("close_bid", "close_ask")
    marks = ", ".join(f"round(CASE WHEN valid THEN side * (m_{n} / entry - 1) * 10000 END + 1e-9::DOUBLE, 5) AS markout_{n}" for n in MARKS)
    return (
        V
        + f""", pa AS (SELECT symbol, event_ms // {STEP} * {STEP} AS t, min(bid) AS min_bid, max(bid) AS max_bid, arg_max(bid, (event_ms, update_id)) AS close_bid, min(ask) AS min_ask, max(ask) AS max_ask, arg_max(ask, (event_ms, update_id)) AS close_ask FROM v_quotes GROUP BY 1, 2),
ac0 AS (SELECT a.id, a.symbol, a.t, side, price AS entry, (800 + a.id % 5 * 400)::DOUBLE AS d FROM v_actions a JOIN v_trades t ON t.id = a.id),
ac AS (SELECT *, entry * (1 - side * d / 10000) AS stop, entry * (1 + side * d * 1.5::DOUBLE / 10000) AS take, {start} AS a, t + {LIFE - STEP} AS z FROM ac0),
kn AS (SELECT {chain}.*, {known} AND ac.t + {LIFE} <= (ac.t // 86400000 + 1) * 86400000 AND coalesce(fx.t >= ac.t + {GUARD}, false) AS valid, CASE WHEN side = 1 THEN fx.close_bid ELSE fx.close_ask END AS fixed, {', '.join(f'CASE WHEN side = 1 THEN m_{n}.close_bid ELSE m_{n}.close_ask END AS m_{n}' for n in MARKS)} FROM ac{joins}),
ht AS (SELECT kn.id, pa.t AS ht, pa.t < kn.t + {GUARD} AS early, CASE WHEN side = 1 THEN min_bid <= stop ELSE max_ask >= stop END AS stopped, CASE WHEN side = 1 THEN max_bid >= take ELSE min_ask <= take END AS taken, CASE WHEN side = 1 THEN min_bid ELSE max_ask END AS worst, CASE WHEN side = 1 THEN {met[0]} ELSE {met[1]} END AS met
  FROM kn JOIN pa ON pa.symbol = kn.symbol AND pa.t BETWEEN a AND z WHERE valid AND (CASE WHEN side = 1 THEN min_bid <= stop ELSE max_ask >= stop END OR (pa.t >= kn.t + {GUARD} AND CASE WHEN side = 1 THEN max_bid >= take ELSE min_ask <= take END)) QUALIFY row_number() OVER (PARTITION BY kn.id ORDER BY pa.t) = 1),
oc AS (SELECT kn.*, ht, CASE WHEN ht IS NULL THEN 'horizon' WHEN early THEN 'gap_stop' WHEN stopped AND taken THEN 'ambiguous_stop' WHEN stopped THEN 'stop' ELSE 'take' END AS outcome, CASE WHEN ht IS NULL THEN fixed WHEN early THEN worst WHEN side = 1 THEN least(CASE WHEN stopped THEN stop ELSE take END, met) ELSE greatest(CASE WHEN stopped THEN stop ELSE take END, met) END AS price FROM kn LEFT JOIN ht ON ht.id = kn.id)
SELECT id, symbol, t, side, valid, CASE WHEN valid THEN outcome END AS outcome, CASE WHEN valid THEN coalesce(ht + {STEP}, t + {LIFE}) END AS exit_t, round(CASE WHEN valid THEN side * (price / entry - 1) * 10000 - 2 - 4 * price / entry END + 1e-9::DOUBLE, 5) AS net, {marks} FROM oc"""
    )


LOOKBACKS, THRESHOLDS, DELAYS, HOLDS, QUANTITY, RATE, GRID_STEP, STALE, WAIT, LEAST = [2 * HOUR, 6 * HOUR], [200.0, 1500.0], [HOUR // 2, HOUR], [HOUR, 4 * HOUR], 2.0, 0.02, HOUR, 12 * HOUR, 6 * HOUR, 5


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even trades lead, odd ones are the second series; a market is a day; tokens are priced from 0.25 to 0.5."""
    t, q = views.trades(spark, sf_dir), views.quotes(spark, sf_dir)
    lead, second = (t.where(f"id % 2 = {i}").select("symbol", "t", "id", "price") for i in (0, 1))
    token = lambda side: F.concat("symbol", F.lit(f"-{side}"))
    markets = t.select("symbol", F.floor(F.col("t") / DAY).alias("market")).distinct().select("symbol", "market", (F.col("market") * DAY).alias("start"), ((F.col("market") + 1) * DAY).alias("end"), token("up").alias("up"), token("down").alias("down"))
    books = q.select(F.when(F.col("update_id") % 2 == 0, token("up")).otherwise(token("down")).alias("token"), F.col("event_ms").alias("t"), F.col("update_id").alias("id"), F.floor(F.col("event_ms") / (40 * HOUR)).alias("segment"), (F.round("bid") / 400).alias("bid"), ((F.round("bid") + 2) / 400).alias("ask"), "bid_qty", "ask_qty")
    return signalgrid.signal_grid_replay(lead, second, markets, books, LOOKBACKS, THRESHOLDS, DELAYS, HOLDS, QUANTITY, RATE, GRID_STEP, STALE, WAIT, LEAST)


def _grid_sql() -> str:
    def known(series: str, at: str) -> str:
        return f"(SELECT arg_max(struct_pack(price := s.price, t := s.t), (s.t, s.id)) FROM v_trades s WHERE s.symbol = pt.symbol AND s.id % 2 = {series} AND s.t <= {at})"

    cost = lambda p: f"CASE WHEN {QUANTITY} * {RATE} * ({p} * (1 - {p})) < 1e-5 THEN 0 ELSE ceil(round({QUANTITY} * {RATE} * ({p} * (1 - {p})) * 1e5, 6)) / 1e5 END"
    config = "symbol, lookback, threshold, mode, delay, hold"
    listed = lambda name, values: f"(VALUES {', '.join(f'({v})' for v in values)}) {name}({name})"
    book = lambda at: f"(SELECT arg_min(bk, (bk.t, bk.id)) FROM bk WHERE bk.token = x.token AND bk.t >= {at} AND bk.t <= {at} + {WAIT})"
    return (
        V.replace("WITH", "WITH RECURSIVE", 1)
        + f""", pt0 AS (SELECT symbol, t // {GRID_STEP} AS s, min(t)::BIGINT AS t FROM v_trades WHERE id % 2 = 0 GROUP BY 1, 2),
pt AS (SELECT symbol, t, lookback::BIGINT AS lookback FROM pt0, {listed('lookback', LOOKBACKS)}),
sg0 AS (SELECT symbol, t, lookback, {known('0', 'pt.t')} AS a, {known('1', 'pt.t')} AS b, {known('0', 'pt.t - lookback')} AS c, {known('1', 'pt.t - lookback')} AS d FROM pt),
sg AS (SELECT symbol, t, lookback, (ln(a.price / c.price) + ln(b.price / d.price)) * 5000 AS score FROM sg0 WHERE t - a.t <= {STALE} AND t - b.t <= {STALE} AND t - lookback - c.t <= {STALE} AND t - lookback - d.t <= {STALE}),
bk AS (SELECT symbol || CASE WHEN update_id % 2 = 0 THEN '-up' ELSE '-down' END AS token, event_ms AS t, update_id AS id, event_ms // {40 * HOUR} AS segment, round(bid) / 400 AS bid, (round(bid) + 2) / 400 AS ask, bid_qty, ask_qty FROM v_quotes),
x AS (SELECT sg.*, mode, delay::BIGINT AS delay, symbol || CASE WHEN (score > 0) = (mode = 'momentum') THEN '-up' ELSE '-down' END AS token FROM sg, (VALUES ('momentum'), ('reversion')) mode(mode), {listed('delay', DELAYS)}),
en AS (SELECT x.*, {book('x.t + x.delay')} AS i FROM x),
x2 AS (SELECT en.*, hold::BIGINT AS hold FROM en, {listed('hold', HOLDS)}),
ex AS (SELECT x.*, {book('x.i.t + x.hold + x.delay')} AS o FROM x2 x),
pr AS (SELECT {config.replace('threshold', 'threshold::DOUBLE AS threshold')}, t // {DAY} AS market, t, CASE WHEN i.segment = o.segment AND o.t < (t // {DAY} + 1) * {DAY} AND i.ask_qty >= {QUANTITY} AND o.bid_qty >= {QUANTITY} THEN o.t END AS until, {QUANTITY} * (o.bid - i.ask) AS gross, {cost('i.ask')} + {cost('o.bid')} AS fees
  FROM ex, {listed('threshold', THRESHOLDS)} WHERE abs(score) >= threshold),
nu AS (SELECT *, row_number() OVER (PARTITION BY {config} ORDER BY t) AS n FROM pr),
wk AS (SELECT *, coalesce(until, -1) AS busy, true AS kept FROM nu WHERE n = 1
  UNION ALL SELECT nu.*, CASE WHEN nu.t >= wk.busy AND nu.until IS NOT NULL THEN nu.until ELSE wk.busy END, nu.t >= wk.busy FROM wk JOIN nu ON {' AND '.join(f'nu.{c} = wk.{c}' for c in config.split(', '))} AND nu.n = wk.n + 1),
tk AS (SELECT *, until IS NOT NULL AS trade, gross - fees AS net FROM wk WHERE kept),
eq AS (SELECT {config}, t, sum(net) OVER (PARTITION BY {config} ORDER BY t) AS equity FROM tk WHERE trade),
dr AS (SELECT {config}, greatest(0, max(fall)) AS drawdown FROM (SELECT {config}, greatest(0, max(equity) OVER (PARTITION BY {config} ORDER BY t)) - equity AS fall FROM eq) GROUP BY ALL),
re AS (SELECT {config}, count(*) AS eligible, count(*) FILTER (trade) AS trades, count(DISTINCT market) FILTER (trade) AS markets, coalesce(sum(gross) FILTER (trade), 0) AS gross, coalesce(sum(fees) FILTER (trade), 0) AS fees, coalesce(sum(net) FILTER (trade), 0) AS net, coalesce(avg(net) FILTER (trade), 0) AS mean_net, coalesce(avg((net > 0)::INT) FILTER (trade), 0) AS win_rate FROM tk GROUP BY ALL)
SELECT re.symbol, re.lookback, re.threshold, re.mode, re.delay, re.hold, eligible, trades, markets, {', '.join(f'round({c}, 6) AS {c}' for c in ('gross', 'fees', 'net', 'mean_net', 'win_rate'))}, round(coalesce(drawdown, 0), 6) AS drawdown,
  row_number() OVER (PARTITION BY re.symbol ORDER BY (trades >= {LEAST}) DESC, round(net, 9) DESC, round(mean_net, 9) DESC, trades DESC, re.threshold, re.lookback, re.mode, re.delay, re.hold) AS rank
FROM re LEFT JOIN dr ON {' AND '.join(f'dr.{c} = re.{c}' for c in config.split(', '))}"""
    )


QUERIES: dict[str, tuple[Query, str]] = {
    "T12_depth_stress_examples": (stress, _stress_sql()),
    "T05_horizon_path": (horizon, _horizon_sql()),
    "T05_horizon_exclusions": (exclusions, EXCLUSIONS_SQL),
    "T09_path_payoff_base": (payoff(False), _payoff_sql(False)),
    "T09_path_payoff_stress": (payoff(True), _payoff_sql(True)),
    "E63_signal_grid_replay": (grid, _grid_sql()),
}
