"""Queries of evaluation, statistics and portfolio measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation, features, ranks
from tidemark.plans.base import BY, DENSE, TIE, Query, V, dense
from tidemark.sources import views

DAILY = V + ", d AS (SELECT symbol, exit, sum(pnl) AS pnl FROM v_closed GROUP BY 1, 2)"
RETURNS = DENSE + f", d AS (SELECT *, close / lag(close) OVER {BY} - 1 AS r FROM dense)"


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last return turned round, as a forecast of the next."""
    bars = dense(spark, sf_dir)
    past = features.simple_returns(bars).select("symbol", "open_time", (-100 * F.col("r")).alias("forecast"))
    return past.join(features.next_return(bars), ["symbol", "open_time"]).where("forecast is not null and target is not null")


FORECASTS = DENSE + f", f AS (SELECT symbol, open_time, -100 * (close / lag(close) OVER {BY} - 1) AS forecast, ln(lead(open, 2) OVER {BY} / lead(open, 1) OVER {BY}) * 10000 AS target FROM dense), g AS (SELECT * FROM f WHERE forecast IS NOT NULL AND target IS NOT NULL)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = features.simple_returns(dense(spark, sf_dir)).select("symbol", "open_time", F.when(F.col("r") > 0, 2).when(F.col("r") < 0, 0).otherwise(1).alias("post"), "r").where("r is not null")
    before = r.select("symbol", (F.col("open_time") + 3_600_000).alias("open_time"), F.col("post").alias("pre"))
    return r.join(before, ["symbol", "open_time"])


QUERIES: dict[str, tuple[Query, str]] = {
    "E02_regression_metrics": (
        lambda s, d: evaluation.regression_metrics(forecasts(s, d), "target", "forecast"),
        FORECASTS + " SELECT count(*) AS n, round(avg((forecast - target) ** 2), 6) AS mse, round(sqrt(avg((forecast - target) ** 2)), 6) AS rmse, round(avg(abs(forecast - target)), 6) AS mae, round(corr(target, forecast), 6) AS pearson, round(avg((sign(target) = sign(forecast))::INT::DOUBLE), 6) AS sign_accuracy FROM g",
    ),
    "E03_average_rank": (
        lambda s, d: ranks.average_rank(views.predictions(s, d).select("id", "p"), "p").select("id", "rank"),
        V + "SELECT id, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rank FROM v_predictions",
    ),
    "E04_spearman": (
        lambda s, d: ranks.spearman(views.trades(s, d), "price", "qty"),
        V + ", r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0::DOUBLE AS b FROM v_trades) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r",
    ),
    "E06_average_precision": (
        lambda s, d: ranks.average_precision(views.predictions(s, d)),
        V
        + """, c AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM v_predictions GROUP BY 1), r AS (SELECT pos, sum(pos) OVER w / sum(n) OVER w AS precision FROM c WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(pos * precision) / sum(pos), 6) AS average_precision FROM r""",
    ),
    "E12_ranked_outcomes": (
        lambda s, d: evaluation.ranked_outcomes(views.trades(s, d).select("symbol", "id", (F.col("price") - 345).alias("signal"), (F.col("qty") * 2 - 50).alias("net")), "signal", "net", "symbol", [10, 50]),
        V + ", r AS (SELECT symbol, qty * 2 - 50 AS net, row_number() OVER (PARTITION BY symbol ORDER BY abs(price - 345) DESC, id) AS n FROM v_trades) SELECT symbol, k, count(*) AS n, round(avg(net), 6) AS mean, round(median(net), 6) AS median FROM r, (VALUES (10), (50)) v(k) WHERE r.n <= k GROUP BY 1, 2",
    ),
    "E17_paired_permutation": (
        lambda s, d: evaluation.paired_permutation(views.predictions(s, d).withColumn("base", F.lit(0.25)).withColumn("loss", (F.col("p") - F.col("y")) ** 2), "day", "base", "loss", 200),
        V
        + """, d AS (SELECT day, sum(0.25::DOUBLE - (p - y) ** 2) AS d FROM v_predictions GROUP BY 1),
s AS (SELECT rep, sum(CASE WHEN ('0x' || substr(md5(day::VARCHAR || '|' || rep::VARCHAR), 1, 2))::INT < 128 THEN d ELSE -d END) AS s FROM d, generate_series(1, 200) g(rep) GROUP BY 1), o AS (SELECT sum(d) AS o FROM d)
SELECT round(any_value(o), 6) AS observed, round((count(*) FILTER (s >= o) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM s, o""",
    ),
    "E18_bh_qvalues": (
        lambda s, d: evaluation.bh_qvalues(views.predictions(s, d).groupBy((F.col("day") % 3).alias("family"), F.col("day").alias("test")).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("p")), "family"),
        V
        + """, t AS (SELECT day % 3 AS family, day AS test, avg((p - y) ** 2) AS p FROM v_predictions GROUP BY 1, 2), r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, test) AS raw FROM t)
SELECT family, test, round(p, 6) AS p, round(least(1, min(raw) OVER (PARTITION BY family ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""",
    ),
    "E26_portfolio_trace": (
        lambda s, d: evaluation.portfolio_trace(views.closed_trades(s, d)),
        DAILY + " SELECT symbol, exit, round(pnl, 6) AS net, round(sum(pnl) OVER (PARTITION BY symbol ORDER BY exit), 6) AS equity, round(sum(pnl) OVER (PARTITION BY exit), 6) AS day_net FROM d",
    ),
    "E28_ensemble_score": (
        lambda s, d: evaluation.ensemble_score(views.predictions(s, d).select(F.col("day").alias("event"), "p")).withColumn("mean", F.col("mean") + TIE),
        V + "SELECT day AS event, count(*) AS members, bool_and(p > 0.5) AS unanimous, round(avg(p) + 1e-9, 6) AS mean, round(min(p), 6) AS worst, avg(p) > 0.5 AS long FROM v_predictions GROUP BY 1",
    ),
    "E33_var_cvar": (
        lambda s, d: evaluation.var_cvar(views.closed_trades(s, d)),
        DAILY + ", v AS (SELECT symbol, quantile_disc(-pnl, 0.95) AS v FROM d GROUP BY 1) SELECT d.symbol, round(any_value(v), 6) AS var, round(avg(-pnl), 6) AS cvar FROM d JOIN v ON v.symbol = d.symbol WHERE -pnl >= v GROUP BY 1",
    ),
    "E34_correlation_matrix": (
        lambda s, d: evaluation.correlation_matrix(features.simple_returns(dense(s, d))),
        RETURNS + " SELECT a.symbol, b.symbol AS other, count(*) AS n, round(corr(a.r, b.r), 6) AS corr FROM d a JOIN d b ON a.open_time = b.open_time AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2",
    ),
    "E36_inverse_volatility": (lambda s, d: evaluation.inverse_volatility(views.closed_trades(s, d)), DAILY + ", i AS (SELECT symbol, 1 / stddev_pop(pnl) AS i FROM d GROUP BY 1) SELECT symbol, round(i / sum(i) OVER (), 6) AS weight FROM i"),
    "E41_path_quality": (
        lambda s, d: evaluation.path_quality(views.closed_trades(s, d)),
        DAILY
        + """, r AS (SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY exit) AS run FROM d), l AS (SELECT symbol, max(n) AS n FROM (SELECT symbol, run, count(*) FILTER (pnl < 0) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT symbol, sum(greatest(pnl, 0)) AS gain, -sum(least(pnl, 0)) AS loss, count(*) AS days, max(pnl) AS best FROM d GROUP BY 1)
SELECT g.symbol, round(CASE WHEN loss > 0 THEN least(999, gain / loss) ELSE 999 END, 6) AS profit_factor, round((gain - loss) / days, 6) AS expectancy, l.n AS longest_losses, round(CASE WHEN gain > 0 THEN greatest(best, 0) / gain END, 6) AS best_share FROM g JOIN l ON l.symbol = g.symbol""",
    ),
    "E43_windowed_robustness": (
        lambda s, d: evaluation.windowed_robustness(views.closed_trades(s, d), 8),
        V + ', e AS (SELECT min(exit) AS a, max(exit) AS b FROM v_closed) SELECT ((exit - a) * 8 // (b - a + 1))::INT AS "window", count(*) AS n, round(sum(pnl), 6) AS net, round(avg((pnl > 0)::INT::DOUBLE), 6) AS win_rate, sum(pnl) > 0 AS accepted FROM v_closed, e GROUP BY 1',
    ),
    "E46_forecast_metrics": (
        lambda s, d: evaluation.forecast_metrics(forecasts(s, d)),
        FORECASTS + " SELECT symbol, count(*) AS n, round(avg(abs(forecast - target)), 6) AS mae, round(avg(abs(target)), 6) AS walk_mae, round(corr(forecast, target), 6) AS ic, round(avg((sign(forecast) = sign(target))::INT::DOUBLE), 6) AS direction FROM g GROUP BY ROLLUP (symbol)",
    ),
    "E47_forecast_scale": (
        lambda s, d: evaluation.forecast_scale(forecasts(s, d), 1_705_276_800_000),
        FORECASTS
        + """, c AS (SELECT symbol, greatest(0, least(1, sum(forecast * target) / sum(forecast ** 2))) AS scale FROM g WHERE open_time < 1705276800000 GROUP BY 1)
SELECT g.symbol, round(any_value(scale), 6) AS scale, round(avg((scale * forecast - target) ** 2), 6) AS scaled_mse, round(avg(target ** 2), 6) AS zero_mse FROM g JOIN c ON c.symbol = g.symbol WHERE open_time >= 1705276800000 GROUP BY 1""",
    ),
    "E51_transition_matrix": (
        lambda s, d: evaluation.transition_matrix(states(s, d), 3),
        RETURNS
        + f""", s AS (SELECT symbol, open_time, CASE WHEN r > 0 THEN 2 WHEN r < 0 THEN 0 ELSE 1 END AS post FROM d WHERE r IS NOT NULL), p AS (SELECT lag(post) OVER {BY} AS pre, post FROM s),
c AS (SELECT a.i AS pre, b.i AS post, (SELECT count(*) FROM p WHERE p.pre = a.i AND p.post = b.i) AS n FROM generate_series(0, 2) a(i), generate_series(0, 2) b(i)) SELECT pre::INT AS pre, post::INT AS post, n, round((n + 1) / (sum(n) OVER (PARTITION BY pre) + 3), 6) AS chance FROM c""",
    ),
    "E54_condition_mean": (lambda s, d: evaluation.condition_mean(views.predictions(s, d), "day", "p"), V + "SELECT round(avg(m), 6) AS mean, count(*) AS conditions FROM (SELECT day, avg(p) AS m FROM v_predictions GROUP BY 1)"),
    "E59_universe_rank": (
        lambda s, d: evaluation.universe_rank(views.trades(s, d).groupBy("symbol").agg(F.count("*").alias("trades"), F.sum(F.col("price") * F.col("qty")).alias("quote_volume")), 100, 0.95, 20),
        V
        + """, r AS (SELECT symbol, count(*) AS n, sum(price * qty) AS q FROM v_trades GROUP BY 1), w AS (SELECT symbol, q / max(q) OVER () AS score, concat_ws(',', CASE WHEN n < 100 THEN 'few_trades' END, CASE WHEN q < 0.95::DOUBLE * max(q) OVER () THEN 'thin' END) AS reasons FROM r)
SELECT symbol, round(score, 6) AS score, reasons, reasons = '' AS eligible FROM w ORDER BY score DESC, symbol LIMIT 20""",
    ),
}
