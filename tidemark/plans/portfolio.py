"""Queries of direction, realised order, portfolio risk, grades and audit rollups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation, features, portfolio, quality
from tidemark.plans.base import BY, HOUR, Query, V, dense, hourly
from tidemark.plans.stats import FORECASTS, RETURNS, forecasts
from tidemark.sources import views

RUNS = ["R", "A", "N"]
RANK = "CASE symbol WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"
GATES = {"symbols": 3, "observations": 100, "effective_symbols": 4.0, "adjusted_symbols": 3.0, "cluster_weight": 0.9, "cvar": 0.02, "drawdown": 0.5}
CAP = 0.22


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    return f.select(F.when(F.abs("forecast") >= 5, F.col("forecast")).otherwise(0.0).alias("signal"), F.col("target").alias("outcome"), (1.0 + F.floor(F.col("open_time") / HOUR) % 5).alias("weight"))


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades by run, with results in whole hundredths, so that sums are exact."""
    c = views.closed_trades(spark, sf_dir)
    return c.select("id", F.col("symbol").alias("run"), "entry", "exit", F.round(F.col("pnl") * 100).cast("long").alias("pnl"), (F.col("exit") - F.col("entry")).alias("__d")).withColumn("adverse", (F.col("__d") * 50_000 + F.col("id") % 1000).cast("long")).drop("__d")


def _rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.observations(spark, sf_dir)
    return o.groupBy("source").agg(
        F.count("*").alias("samples"), F.avg(F.abs("score")).alias("mean_abs"), F.avg(F.get_json_object("payload", "$.k").cast("double") / 100).alias("mean_confidence"),
        F.count_if(F.col("kind") == "view").alias("raw_records"), F.count_if(F.col("kind") == "absent").alias("component_records"), F.count_if(F.col("kind") == "purchase").alias("outcomes"),
        F.avg(F.when(F.col("kind") == "purchase", (F.col("score") > 0.1).cast("double"))).alias("directional_accuracy"),
    )


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.coverage_report(hourly(spark, sf_dir), HOUR)
    coverage = F.when(F.col("coverage") < 0.5, "fail").when(F.col("coverage") < 0.95, "warn").otherwise("ok")
    gap = F.when(F.col("largest_gap") > 24 * HOUR, "fail").when(F.col("gaps") > 0, "warn").otherwise("ok")
    listed = F.array(F.struct(F.lit("coverage").alias("check"), coverage.alias("status")), F.struct(F.lit("gap").alias("check"), gap.alias("status")), F.struct(F.lit("rows").alias("check"), F.when(F.col("bars") < 24, "fail").otherwise("ok").alias("status")))
    return c.select("symbol", F.inline(listed))


QUERIES: dict[str, tuple[Query, str]] = {
    "E10_direction_metrics": (
        lambda s, d: portfolio.direction_metrics(_signals(s, d)),
        FORECASTS
        + """, s AS (SELECT CASE WHEN abs(forecast) >= 5 THEN forecast ELSE 0 END AS signal, target AS outcome, (1 + open_time // 3600000 % 5)::DOUBLE AS w FROM g WHERE target <> 0),
c AS (SELECT signal, sum(w) FILTER (outcome > 0) AS wp, sum(w) FILTER (outcome < 0) AS wn, count(*) FILTER (outcome > 0) AS p, count(*) FILTER (outcome < 0) AS n FROM s GROUP BY 1),
b AS (SELECT coalesce(wp, 0) AS wp, coalesce(wn, 0) AS wn, p, n, coalesce(sum(wn) OVER r, 0) AS wb, coalesce(sum(n) OVER r, 0) AS nb FROM c WINDOW r AS (ORDER BY signal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT sum(wp * (wb + wn / 2)) / (sum(wp) * sum(wn)) AS weighted_auc, sum(p * (nb + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM b),
k AS (SELECT corr(x, y) AS rc FROM (SELECT rank() OVER (ORDER BY signal) + (count(*) OVER (PARTITION BY signal) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY outcome) + (count(*) OVER (PARTITION BY outcome) - 1) / 2.0::DOUBLE AS y FROM s)),
m AS (SELECT count(*) AS rows, count(*) FILTER (outcome > 0) AS ups, count(*) FILTER (outcome < 0) AS downs, count(*) FILTER (signal = 0) AS unrouted, sum(w) FILTER (signal * outcome > 0) / sum(w) FILTER (signal <> 0) AS wa, avg((signal * outcome > 0)::INT::DOUBLE) FILTER (signal <> 0) AS acc FROM s)
SELECT rows, ups, downs, unrouted, round(wa, 6) AS weighted_accuracy, round(acc, 6) AS accuracy, round(weighted_auc, 6) AS weighted_auc, round(auc, 6) AS auc, round(rc, 6) AS rank_correlation FROM m, a, k""",
    ),
    "E31_conservative_drawdown": (
        lambda s, d: portfolio.conservative_drawdown(_closed(s, d), RUNS),
        V
        + f""", c AS (SELECT {RANK} AS r, id, entry, exit, round(pnl * 100)::BIGINT AS pnl, (exit - entry) * 50000 + id % 1000 AS adverse FROM v_closed),
e AS (SELECT r, exit AS t, 0 AS kind, id, pnl AS gain, CASE WHEN exit > entry THEN -adverse ELSE 0 END AS o FROM c UNION ALL SELECT r, entry, 1, id, 0, adverse FROM c WHERE exit > entry),
w AS (SELECT *, sum(gain) OVER (ORDER BY r, t, kind, id) AS g, sum(o) OVER (PARTITION BY r ORDER BY t, kind, id) AS a FROM e), p AS (SELECT *, greatest(0, max(g) OVER (ORDER BY r, t, kind, id)) AS peak FROM w)
SELECT max(peak - g)::BIGINT AS realized_drawdown, max(peak - g + greatest(0, a))::BIGINT AS conservative_drawdown FROM p""",
    ),
    "E32_realization_order": (
        lambda s, d: portfolio.realization_order(_closed(s, d).select("id", "run", "exit"), RUNS),
        V + f"SELECT id, symbol AS run, exit, ({RANK})::INT AS run_rank, row_number() OVER (ORDER BY {RANK}, exit, id) AS place FROM v_closed",
    ),
    "E37_portfolio_risk": (
        lambda s, d: portfolio.portfolio_risk(features.simple_returns(dense(s, d)), CAP, 0.05, GATES),
        RETURNS.replace("WITH", "WITH RECURSIVE", 1)
        + f""", x AS (SELECT symbol, open_time, r FROM d WHERE r IS NOT NULL), al AS (SELECT * FROM x WHERE open_time IN (SELECT open_time FROM x GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM x))),
i AS (SELECT symbol, 1 / greatest(stddev_pop(r), 1e-9) AS v FROM al GROUP BY 1), oo AS (SELECT *, row_number() OVER (ORDER BY v DESC, symbol) - 1 AS i, sum(v) OVER (ORDER BY v DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, least(1, {CAP}::DOUBLE * count(*) OVER ()) AS budget FROM i),
ff AS (SELECT min(i) AS k FROM oo WHERE (budget - i * {CAP}::DOUBLE) * v / rest <= {CAP}::DOUBLE + 1e-12), gg AS (SELECT k, budget - k * {CAP}::DOUBLE AS l, rest AS r FROM ff JOIN oo ON oo.i = ff.k),
wt AS (SELECT symbol, CASE WHEN i < k THEN {CAP}::DOUBLE ELSE l * v / r END AS weight FROM oo, gg), sh AS (SELECT *, weight / sum(weight) OVER () AS share FROM wt),
pr AS (SELECT a.symbol, b.symbol AS other, coalesce(corr(a.r, b.r), 0) AS c FROM al a JOIN al b ON a.open_time = b.open_time AND a.symbol < b.symbol GROUP BY 1, 2),
jn AS (SELECT greatest(0, max(c)) AS mx, sum(c * a.share * b.share) / sum(a.share * b.share) AS mean, sum(2 * greatest(c, 0) * a.share * b.share) AS j FROM pr JOIN sh a ON a.symbol = pr.symbol JOIN sh b ON b.symbol = pr.other),
ln AS (SELECT symbol, other FROM pr WHERE c >= 0.05 UNION ALL SELECT other, symbol FROM pr WHERE c >= 0.05), rc AS (SELECT symbol, symbol AS seen FROM sh UNION SELECT rc.symbol, ln.other FROM rc JOIN ln ON ln.symbol = rc.seen),
cl AS (SELECT count(*) AS clusters, max(w) AS mw FROM (SELECT cluster, sum(weight) AS w FROM (SELECT symbol, min(seen) AS cluster FROM rc GROUP BY 1) q JOIN wt ON wt.symbol = q.symbol GROUP BY 1)),
pa AS (SELECT open_time, sum(weight * r) AS r FROM al JOIN wt ON wt.symbol = al.symbol GROUP BY 1), va AS (SELECT count(*) AS n, greatest(0, quantile_disc(-r, 0.95)) AS v FROM pa), cv AS (SELECT greatest(0, avg(-r)) AS c FROM pa, va WHERE -r >= v),
eq AS (SELECT open_time, sum(ln(1 + r)) OVER (ORDER BY open_time) AS e FROM pa), dd AS (SELECT max(1 - exp(e - peak)) AS d FROM (SELECT e, greatest(0, max(e) OVER (ORDER BY open_time)) AS peak FROM eq)),
al1 AS (SELECT count(*) AS symbols, sum(weight) AS deployed, 1 / sum(share ** 2) AS eff, sum(share ** 2) AS own FROM sh),
al2 AS (SELECT *, 1 / (own + j) AS adj FROM al1, jn, cl, va, cv, dd),
al3 AS (SELECT *, concat_ws(',', CASE WHEN symbols + 1e-3 < 3 THEN 'symbols' END, CASE WHEN n + 1e-3 < 100 THEN 'observations' END, CASE WHEN eff + 1e-3 < 4 THEN 'effective_symbols' END, CASE WHEN adj + 1e-3 < 3 THEN 'adjusted_symbols' END,
  CASE WHEN mw > 0.9 THEN 'cluster_weight' END, CASE WHEN c > 0.02 THEN 'cvar' END, CASE WHEN d > 0.5 THEN 'drawdown' END) AS failed FROM al2)
SELECT symbols, round(deployed, 6) AS deployed, round(eff, 6) AS effective_symbols, round(mx, 6) AS max_correlation, round(mean, 6) AS mean_correlation, clusters, round(mw, 6) AS max_cluster_weight, n AS observations, round(v, 6) AS var, round(c, 6) AS cvar, round(d, 6) AS drawdown,
  round(adj, 6) AS adjusted_symbols, failed, failed = '' AS accepted FROM al3""",
    ),
    "E56_grade_sources": (
        lambda s, d: portfolio.grade_sources(_rollups(s, d)),
        V
        + """, r AS (SELECT source, count(*) AS samples, avg(abs(score)) AS ma, avg(CAST(json_extract_string(payload, '$.k') AS DOUBLE) / 100) AS mc, count(*) FILTER (kind = 'view') AS raw, count(*) FILTER (kind = 'absent') AS comp, count(*) FILTER (kind = 'purchase') AS outcomes,
  avg((score > 0.1)::INT::DOUBLE) FILTER (kind = 'purchase') AS da FROM v_obs GROUP BY 1)
SELECT source, samples, round(ma, 6) AS mean_abs, round(mc, 6) AS mean_confidence, raw AS raw_records, comp AS component_records, outcomes, round(da, 6) AS directional_accuracy,
  greatest(0, least(10, round_even(1.5::DOUBLE + least(3, ln(samples + 1) * 1.15::DOUBLE) + 3 * greatest(0, least(1, mc)) + 2 * greatest(0, least(1, ma)) + CASE WHEN raw > 0 AND comp > 0 THEN 1 WHEN raw > 0 OR comp > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN da IS NULL THEN 0 ELSE (da - 0.5::DOUBLE) * least(4, 1 + ln(outcomes + 1)) END, 0)::INT)) AS grade FROM r""",
    ),
    "Q16_operator_audit": (
        lambda s, d: portfolio.audit_rollup(_checks(s, d), "symbol"),
        V
        + f""", g AS (SELECT symbol, open_time, open_time - lag(open_time) OVER {BY} AS gap FROM v_bars), c AS (SELECT symbol, count(*) AS bars, count(*) FILTER (gap > 5400000) AS gaps, coalesce(max(gap), 0) AS lg, round(count(*) / ((max(open_time) - min(open_time)) / 3600000.0::DOUBLE + 1), 6) AS cov FROM g GROUP BY 1),
k AS (SELECT symbol, 'coverage' AS name, CASE WHEN cov < 0.5 THEN 2 WHEN cov < 0.95 THEN 1 ELSE 0 END AS l FROM c UNION ALL SELECT symbol, 'gap', CASE WHEN lg > 86400000 THEN 2 WHEN gaps > 0 THEN 1 ELSE 0 END FROM c UNION ALL SELECT symbol, 'rows', CASE WHEN bars < 24 THEN 2 ELSE 0 END FROM c)
SELECT symbol, count(*) FILTER (l = 0) AS ok, count(*) FILTER (l = 1) AS warn, count(*) FILTER (l = 2) AS fail, coalesce(string_agg((CASE l WHEN 1 THEN 'warn:' ELSE 'fail:' END) || name, ',' ORDER BY (CASE l WHEN 1 THEN 'warn:' ELSE 'fail:' END) || name) FILTER (l > 0), '') AS issues,
  CASE max(l) WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'fail' END AS status FROM k GROUP BY 1""",
    ),
    "E66_benchmark_panel": (
        lambda s, d: _panel(s, d),
        FORECASTS
        + """, w AS (SELECT symbol, CASE WHEN open_time + 3600000 <= 1705276800000 THEN 'early' ELSE 'late' END AS "window", forecast, target FROM g)
SELECT "window", symbol, count(*) AS n, round(avg(abs(forecast - target)), 6) AS mae, round(avg(abs(target)), 6) AS walk_mae, round(corr(forecast, target), 6) AS ic, round(avg((sign(forecast) = sign(target))::INT::DOUBLE), 6) AS direction FROM w GROUP BY 1, 2""",
    ),
}


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast metrics by symbol over windows of candles chosen by the time they close."""
    f = forecasts(spark, sf_dir)
    windows = [("early", F.col("open_time") + HOUR <= 1_705_276_800_000), ("late", F.col("open_time") + HOUR > 1_705_276_800_000)]
    named = f.withColumn("window", F.when(windows[0][1], windows[0][0]).when(windows[1][1], windows[1][0])).where("window is not null")
    return evaluation.forecast_metrics(named.withColumn("symbol", F.concat_ws("/", "window", "symbol"))).where("symbol is not null").select(F.split_part("symbol", F.lit("/"), F.lit(1)).alias("window"), F.split_part("symbol", F.lit("/"), F.lit(2)).alias("symbol"), "n", "mae", "walk_mae", "ic", "direction")
