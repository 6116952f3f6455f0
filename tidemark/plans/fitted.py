"""Queries of fits, policies, envelopes and turnover, with SQL where one pass or a recursion can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import envelope, fits, policies, turnover
from tidemark.plans.base import DENSE, TIE, Query, V, dense
from tidemark.sources import views

PENALTIES = [0.001, 0.01, 0.1, 1.0, 10.0]
BINS, REPLICATES = 10, 60
LEAST, PRECISION = 20, 0.505
OLDEST = 6
MODES = [(True, 900.0), (True, 2500.0), (False, 900.0), (False, 2500.0)]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by supplier: quantity and discount against the price, with the tax beside them."""
    x = views.read(spark, sf_dir, "lineitem")
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("condition"), F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"),
    )


def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.penalty_scores(lines(spark, sf_dir), ["quantity", "discount"], "price", "condition", PENALTIES)


#: Two features, so that the system of three unknowns has a closed form: after standardising anew the intercept falls out.
M04_SQL = f"""
WITH l AS (SELECT l_suppkey AS k, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem),
c0 AS (SELECT k, avg(a) AS ma, avg(a * a) AS qa, avg(b) AS mb, avg(b * b) AS qb FROM l GROUP BY 1),
m AS (SELECT avg(ma) AS ma, sqrt(avg(qa) - avg(ma) ** 2) AS sa, avg(mb) AS mb, sqrt(avg(qb) - avg(mb) ** 2) AS sb FROM c0),
z AS (SELECT k, greatest(-5, least(5, (a - ma) / sa)) AS a, greatest(-5, least(5, (b - mb) / sb)) AS b, y FROM l, m),
g AS (SELECT k, avg(a) AS a, avg(b) AS b, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb, avg(y) AS y, avg(a * y) AS ay, avg(b * y) AS by_, avg(y * y) AS yy FROM z GROUP BY 1),
t AS (SELECT count(*) AS n, sum(a) AS a, sum(b) AS b, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(y) AS y, sum(ay) AS ay, sum(by_) AS by_ FROM g),
o AS (SELECT g.*, (t.a - g.a) / (n - 1) AS oa, (t.b - g.b) / (n - 1) AS ob, (t.aa - g.aa) / (n - 1) AS oaa, (t.ab - g.ab) / (n - 1) AS oab, (t.bb - g.bb) / (n - 1) AS obb, (t.y - g.y) / (n - 1) AS oy, (t.ay - g.ay) / (n - 1) AS oay, (t.by_ - g.by_) / (n - 1) AS oby FROM g, t),
s AS (SELECT *, sqrt(oaa - oa * oa) AS ua, sqrt(obb - ob * ob) AS ub FROM o),
r AS (SELECT *, (oab - oa * ob) / (ua * ub) AS rho, (oay - oa * oy) / ua AS ca, (oby - ob * oy) / ub AS cb FROM s),
e AS (SELECT r.*, penalty, ((1 + penalty) * ca - rho * cb) / ((1 + penalty) ** 2 - rho * rho) / ua AS wa, ((1 + penalty) * cb - rho * ca) / ((1 + penalty) ** 2 - rho * rho) / ub AS wb FROM r, (VALUES {', '.join(f'({p}::DOUBLE)' for p in PENALTIES)}) v(penalty)),
f AS (SELECT *, oy - wa * oa - wb * ob AS w0 FROM e),
x AS (SELECT penalty, yy - 2 * (w0 * y + wa * ay + wb * by_) + w0 * w0 + 2 * w0 * (wa * a + wb * b) + wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb AS error FROM f),
q AS (SELECT penalty, avg(error) AS score FROM x GROUP BY 1)
SELECT penalty, round(score, 6) AS score, penalty = (SELECT penalty FROM q ORDER BY score, penalty DESC LIMIT 1) AS chosen FROM q"""


def offset_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line was returned, on top of a prior from its tax."""
    rows = lines(spark, sf_dir).withColumn("prior", F.log((0.2 + F.col("tax")) / (0.8 - F.col("tax"))))
    model = fits.fit_offset_logistic(rows, ["quantity", "discount", "price"], "returned", 0.01, offset="prior")
    return model.predict(rows, "prior").select("id", "fitted")


def quantile_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower fifth of prices, by quantity and discount, with how much of them lies below."""
    rows = lines(spark, sf_dir)
    low = fits.linear(rows, fits.quantile_head(rows, ["quantity", "discount"], "price", 0.2), "low")
    return fits.quantile_scores(low, "price", "low", 0.2)


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.take_skip_policy(closed(spark, sf_dir), LEAST, PRECISION)


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return a.select("id", F.col("t").alias("opened"), F.col("end").alias("closed"), (F.col("score") + 2.45).alias("strength"), (F.col("net") / 100).alias("ret"), F.col("net").alias("pnl"))


_STATS = "count(*) AS n, coalesce(sum((pnl > 0)::INT), 0) AS wins, coalesce(sum(ret), 0) AS ret, coalesce(sum(pnl), 0) AS pnl, coalesce(sum(greatest(-pnl, 0)), 0) AS lost, coalesce(sum(greatest(pnl, 0)), 0) AS won"
SPLIT = (
    V
    + f""", s AS (SELECT id, t AS opened, "end" AS closed, score + 2.45::DOUBLE AS strength, net / 100 AS ret, net AS pnl FROM v_actions),
z AS (SELECT count(*) AS n FROM s), o AS (SELECT opened, row_number() OVER (ORDER BY opened) - 1 AS i FROM s),
st AS (SELECT opened AS validation_start FROM o, z WHERE i = n - greatest({LEAST}, floor(n * 0.3::DOUBLE))),
p AS (SELECT s.*, validation_start, CASE WHEN opened >= validation_start THEN 'validation' WHEN closed < validation_start THEN 'calibration' ELSE 'purged' END AS part FROM s, st),
c AS (SELECT round(greatest(strength, 0), 12) AS r, min(greatest(strength, 0)) AS threshold, {_STATS} FROM p WHERE part = 'calibration' GROUP BY 1),
tb AS (SELECT threshold, sum(n) OVER u AS n, sum(wins) OVER u AS wins, sum(ret) OVER u AS ret, sum(pnl) OVER u AS pnl, sum(lost) OVER () - sum(lost) OVER u AS avoided, sum(won) OVER () - sum(won) OVER u AS missed FROM c WINDOW u AS (ORDER BY threshold DESC))"""
)
POLICY_SQL = (
    SPLIT
    + f""", b AS (SELECT threshold AS take, n, wins / n AS precision, ret / n AS mean, pnl FROM tb WHERE n >= {LEAST} AND wins / n >= {PRECISION} AND ret / n > 0 AND pnl > 0 ORDER BY round(pnl + avoided - missed, 9) DESC, round(wins / n, 12) DESC, round(ret / n, 12) DESC, n, threshold LIMIT 1),
n AS (SELECT count(*) AS samples, count(*) FILTER (part = 'calibration') AS calibration, count(*) FILTER (part = 'purged') AS purged, count(*) FILTER (part = 'validation') AS validation, max(validation_start) AS validation_start FROM p),
h AS (SELECT n.*, b.take, greatest(0, b.take * 0.5::DOUBLE) AS floor, b.n AS bn, b.precision, b.mean, b.pnl AS bpnl FROM n LEFT JOIN b ON true),
v AS (SELECT CASE WHEN take IS NULL THEN 'skip' WHEN strength >= take THEN 'take' WHEN strength >= floor THEN 'down' ELSE 'skip' END AS g, ret, p.pnl FROM p, h WHERE part = 'validation'),
k AS (SELECT {', '.join(f"coalesce(max(CASE WHEN g = '{g}' THEN {c} END), 0) AS {g}_{c}" for g in ('take', 'down', 'skip') for c in ('n', 'wins', 'ret', 'pnl', 'lost', 'won'))} FROM (SELECT g, {_STATS} FROM v GROUP BY 1)),
w AS (SELECT *, CASE WHEN take_n > 0 THEN take_wins / take_n ELSE 0 END AS tp, CASE WHEN take_n > 0 THEN take_ret / take_n ELSE 0 END AS tm, calibration < {LEAST} OR validation < {LEAST} OR samples < {2 * LEAST} AS few FROM h, k),
x AS (SELECT *, CASE WHEN few THEN 'insufficient_chronological_split' WHEN take IS NULL THEN 'no_profitable_precision_threshold' WHEN take_n < {LEAST} THEN 'take_validation_samples_insufficient' WHEN tp < {PRECISION} THEN 'take_validation_precision_below_target'
  WHEN tm <= 0 THEN 'take_validation_expectancy_not_positive' WHEN take_pnl <= 0 THEN 'take_validation_pnl_not_positive' END AS reason FROM w),
y AS (SELECT *, reason IS NULL AND down_n >= {LEAST} AND down_ret > 0 AND down_pnl > 0 AS ok FROM x)
SELECT CASE WHEN few THEN 'insufficient' WHEN reason IS NULL THEN 'trained' ELSE 'observe_only' END AS status, reason, samples, calibration, purged, validation, validation_start, round(take, 6) AS take_threshold, round(CASE WHEN ok THEN floor ELSE take END, 6) AS downsize_threshold,
  bn::BIGINT AS calibration_take, round(precision, 6) AS calibration_precision, round(mean, 6) AS calibration_mean, round(bpnl, 6) AS calibration_pnl, take_n::BIGINT AS take_count, round(tp, 6) AS take_precision, round(tm, 6) AS take_mean, round(take_pnl, 6) AS take_pnl,
  CASE WHEN ok THEN down_n ELSE 0 END::BIGINT AS downsize_count, (skip_n + CASE WHEN ok THEN 0 ELSE down_n END)::BIGINT AS skip_count, round(skip_lost + CASE WHEN ok THEN 0 ELSE down_lost END, 6) AS skipped_loss_avoided, round(skip_won + CASE WHEN ok THEN 0 ELSE down_won END, 6) AS skipped_profit_missed FROM y"""
)


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by condition: days, 97 of them in turn, placed from 0."""
    return views.predictions(spark, sf_dir).withColumn("condition", F.col("day") % 97)


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.fit_envelope(conditions(spark, sf_dir), "condition", "p", "y", BINS, REPLICATES, order="condition")


E50_BAND = (
    V
    + f""", r AS (SELECT day % 97 AS k, greatest(0, least({BINS - 1}, floor(p * {BINS})))::INT AS bin, y FROM v_predictions), z AS (SELECT k, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT r.k, bin, count(*) / any_value(n) AS w, sum(y) / any_value(n) AS pos FROM r JOIN z ON z.k = r.k GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM z),
d AS (SELECT rep, ('0x' || substr(md5(rep::VARCHAR || '|' || k::VARCHAR), 1, 8))::BIGINT % n.n AS k FROM z, n, generate_series(1, {REPLICATES}) g(rep)),
a AS (SELECT rep, bin, sum(w) AS w, sum(pos) AS pos FROM d JOIN c ON c.k = d.k GROUP BY 1, 2 UNION ALL SELECT 0, bin, sum(w), sum(pos) FROM c GROUP BY 2),
s AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY bin) AS i, sum(w) OVER u AS cw, sum(pos) OVER u AS cp, count(*) OVER (PARTITION BY rep) AS m FROM a WINDOW u AS (PARTITION BY rep ORDER BY bin)),
pt AS (SELECT rep, i, cw, cp FROM s UNION ALL SELECT DISTINCT rep, 0, 0, 0 FROM s),
l AS (SELECT p.rep, p.i, max((p.cp - q.cp) / (p.cw - q.cw)) AS low FROM pt p JOIN pt q ON q.rep = p.rep AND q.i < p.i GROUP BY 1, 2),
h AS (SELECT p.rep, p.i, min((q.cp - p.cp) / (q.cw - p.cw)) AS high FROM pt p JOIN pt q ON q.rep = p.rep AND q.i > p.i GROUP BY 1, 2),
b AS (SELECT s.rep, s.i, s.cw, s.cp, s.bin FROM s LEFT JOIN l ON l.rep = s.rep AND l.i = s.i LEFT JOIN h ON h.rep = s.rep AND h.i = s.i WHERE s.i = s.m OR low <= high + 1e-12),
pool AS (SELECT rep, (cp - coalesce(lag(cp) OVER u, 0)) / (cw - coalesce(lag(cw) OVER u, 0)) AS v, coalesce(lag(i) OVER u, 0) + 1 AS fi, bin AS zb FROM b WINDOW u AS (PARTITION BY rep ORDER BY i)),
k AS (SELECT pool.rep, v, ((s.bin + 0.5::DOUBLE) / {BINS} + (zb + 0.5::DOUBLE) / {BINS}) / 2 AS x FROM pool JOIN s ON s.rep = pool.rep AND s.i = fi),
gr AS (SELECT rep, bin, (bin + 0.5::DOUBLE) / {BINS} AS x FROM (SELECT DISTINCT rep FROM k), generate_series(0, {BINS - 1}) t(bin)),
lo AS (SELECT gr.*, k.x AS x0, k.v AS v0 FROM gr ASOF LEFT JOIN k ON k.rep = gr.rep AND gr.x + 1e-12 >= k.x),
hi AS (SELECT lo.*, k.x AS x1, k.v AS v1 FROM lo ASOF LEFT JOIN k ON k.rep = lo.rep AND lo.x + 1e-12 < k.x),
f AS (SELECT rep, bin, greatest(1e-6, least(1 - 1e-6, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (x - x0) / (x1 - x0) END)) AS v FROM hi),
q AS (SELECT bin, quantile_cont(v, 0.05::DOUBLE) AS lo, quantile_cont(v, 0.95::DOUBLE) AS hi FROM f WHERE rep > 0 GROUP BY 1),
env AS (SELECT f.bin, (f.bin + 0.5::DOUBLE) / {BINS} AS middle, v AS calibrated, least(lo, v) AS lower, greatest(hi, v) AS upper, (SELECT count(*) FROM c WHERE c.bin = f.bin) AS support FROM f JOIN q ON q.bin = f.bin WHERE rep = 0)"""
)


def turnover_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum of hourly bars as forecast of the next hour's return, under each mode and cost."""
    bars = dense(spark, sf_dir).withColumn("c", F.col("close"))
    before = bars.select("symbol", (F.col("open_time") + 3_600_000).alias("open_time"), F.col("c").alias("before"))
    after = bars.select("symbol", (F.col("open_time") - 3_600_000).alias("open_time"), F.col("c").alias("after"))
    j = bars.select("symbol", "open_time", "c").join(before, ["symbol", "open_time"], "left").join(after, ["symbol", "open_time"], "left")
    modes = F.array(*[F.struct(F.lit(m).alias("long_only"), F.lit(c).alias("cost")) for m, c in MODES])
    rows = j.select("symbol", "open_time", F.coalesce(F.log(F.col("c") / F.col("before")) * 10_000, F.lit(0.0)).alias("forecast"), F.coalesce(F.log(F.col("after") / F.col("c")) * 10_000, F.lit(0.0)).alias("target"), F.explode(modes).alias("m"))
    return rows.select("symbol", "open_time", "forecast", "target", "m.long_only", "m.cost")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnover.stateful_turnover(turnover_rows(spark, sf_dir).withColumn("fee", F.col("cost")), ["symbol", "long_only", "cost"], "open_time", "forecast", "target", "fee", "long_only", OLDEST, stretch=100 * 3_600_000).drop("fee")


HELD = (
    DENSE.replace("WITH v_trades", "WITH RECURSIVE v_trades", 1)
    + f""", j AS (SELECT symbol, open_time, coalesce(ln(close / lag(close) OVER w) * 10000, 0) AS forecast, coalesce(ln(lead(close) OVER w / close) * 10000, 0) AS target, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
x AS (SELECT j.*, long_only, cost, CASE WHEN long_only THEN (forecast > 0)::INT ELSE sign(forecast)::INT END AS want FROM j, (VALUES {', '.join(f'({str(m).lower()}, {c}::DOUBLE)' for m, c in MODES)}) v(long_only, cost)),
go(symbol, long_only, cost, i, was, was_age, pos, age, reason) AS (
  SELECT DISTINCT symbol, long_only, cost, 0::BIGINT, 0, 0, 0, 0, 0 FROM x
  UNION ALL
  SELECT symbol, long_only, cost, i, was, was_age, pos, CASE WHEN pos = 0 THEN 0 WHEN pos = was THEN was_age + 1 ELSE 1 END, reason FROM (
    SELECT g.symbol, g.long_only, g.cost, x.i, g.pos AS was, g.age AS was_age,
      CASE WHEN g.pos <> 0 AND g.age >= {OLDEST} THEN 0 WHEN g.pos <> want AND abs(forecast) > 2 * g.cost * abs(want - g.pos) THEN want ELSE g.pos END AS pos,
      CASE WHEN g.pos <> 0 AND g.age >= {OLDEST} THEN 4 WHEN g.pos <> want AND abs(forecast) > 2 * g.cost * abs(want - g.pos) THEN CASE WHEN g.pos = 0 THEN 1 WHEN want = 0 THEN 2 ELSE 3 END ELSE 0 END AS reason
    FROM go g JOIN x ON x.symbol = g.symbol AND x.long_only = g.long_only AND x.cost = g.cost AND x.i = g.i + 1)),
y AS (SELECT x.symbol, x.open_time, x.long_only, x.cost, forecast, target, pos AS position, age, reason, abs(pos - was) + CASE WHEN x.i = n THEN abs(pos) ELSE 0 END AS units,
    CASE WHEN reason > 1 THEN was_age WHEN x.i = n AND pos <> 0 THEN age END AS held, pos * target - x.cost * (abs(pos - was) + CASE WHEN x.i = n THEN abs(pos) ELSE 0 END) AS net
  FROM go g JOIN x ON x.symbol = g.symbol AND x.long_only = g.long_only AND x.cost = g.cost AND x.i = g.i)"""
)

#: Fits in rounds; tests compare them with exact solutions.
UNCHECKED: dict[str, Query] = {"M05_offset_logistic": offset_logistic, "M08_quantile_head": quantile_head}

QUERIES: dict[str, tuple[Query, str]] = {
    "M04_penalty_scores": (penalties, M04_SQL),
    "M10_threshold_table": (
        lambda s, d: policies.threshold_table(policies.chronological_split(closed(s, d), LEAST, 0.3).where("part = 'calibration'")).select("threshold", F.col("n").cast("long").alias("n"), "pnl", "avoided", "missed", (F.col("precision") + TIE).alias("precision"), (F.col("mean") + TIE).alias("mean")),
        SPLIT + " SELECT round(threshold, 6) AS threshold, n::BIGINT AS n, round(pnl, 6) AS pnl, round(avoided, 6) AS avoided, round(missed, 6) AS missed, round(wins / n + 1e-9::DOUBLE, 6) AS precision, round(ret / n + 1e-9::DOUBLE, 6) AS mean FROM tb",
    ),
    "M10_take_skip_policy": (policy, POLICY_SQL),
    "E50_probability_envelope": (band, E50_BAND + " SELECT bin, round(middle, 6) AS middle, round(calibrated, 6) AS calibrated, round(lower, 6) AS lower, round(upper, 6) AS upper, support FROM env"),
    "E50_apply_envelope": (
        lambda s, d: envelope.apply_envelope(conditions(s, d), band(s, d), "p", BINS, 30).select("id", "calibrated", "lower", "upper", "abstains"),
        E50_BAND
        + f" SELECT id, round(calibrated, 6) AS calibrated, round(lower, 6) AS lower, round(upper, 6) AS upper, calibrated IS NULL AS abstains FROM v_predictions LEFT JOIN env ON support >= 30 AND bin = greatest(0, least({BINS - 1}, floor(p * {BINS})))::INT",
    ),
    "E25_stateful_turnover": (held, HELD + " SELECT symbol, open_time, long_only, cost, round(forecast, 6) AS forecast, round(target, 6) AS target, position::INT AS position, age::INT AS age, units::DOUBLE AS units, reason::INT AS reason, held::INT AS held, round(net, 6) AS net FROM y"),
    "E25_turnover_metrics": (
        lambda s, d: turnover.turnover_metrics(held(s, d), ["symbol", "long_only", "cost"]),
        HELD
        + """ SELECT symbol, long_only, cost, count(*) AS rows, round(sum(net), 6) AS net, sum(units)::DOUBLE AS units, count(*) FILTER (reason = 1) AS entries, count(*) FILTER (reason = 2) AS exits, count(*) FILTER (reason = 3) AS reversals, count(*) FILTER (reason = 4) AS expiries,
  round(avg(held), 6) AS mean_held, round(avg(abs(position)), 6) AS exposure FROM y GROUP BY 1, 2, 3""",
    ),
}
