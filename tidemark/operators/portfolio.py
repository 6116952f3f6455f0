"""Direction of signals, order and drawdown of realised results, portfolio risk, grades of sources and of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, panels, ranks, regimes

#: Days of a bucket in which running sums over trades are taken.
BUCKET_DAYS = 30


def direction_metrics(rows: DataFrame) -> DataFrame:
    """How a signal's sign and order tell the sign of an outcome, over rows of (signal, outcome, weight).

    Rows without a finite signal or outcome, or with an outcome of zero, are left out; a signal of zero is not routed.
    Areas come from one row for each score.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("signal", "outcome")]
    used = regimes.cut(rows.where(finite[0] & finite[1] & (F.col("outcome") != 0)).select("signal", "outcome", "weight", (F.col("outcome") > 0).cast("int").alias("y")))
    routed = F.col("signal") != 0
    right = (F.col("signal") > 0) == (F.col("outcome") > 0)
    sums = used.agg(
        F.count("*").alias("rows"), F.count_if(F.col("y") == 1).alias("ups"), F.count_if(F.col("y") == 0).alias("downs"), F.count_if(~routed).alias("unrouted"),
        (F.sum(F.when(routed & right, F.col("weight"))) / F.sum(F.when(routed, F.col("weight")))).alias("weighted_accuracy"), F.avg(F.when(routed, right.cast("double"))).alias("accuracy"),
    )

    def auc(weight: Column, name: str) -> DataFrame:
        cells = used.groupBy(F.col("signal").alias("p")).agg(F.sum(weight * F.col("y")).alias("pos"), F.sum(weight * (1 - F.col("y"))).alias("neg"))
        below = ranks.running_below(cells, "p", ["neg"])
        return below.agg((F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias(name))

    ic = ranks.spearman(used, "signal", "outcome").select(F.col("spearman").alias("rank_correlation"))
    out = sums
    for one in (auc(F.col("weight"), "weighted_auc"), auc(F.lit(1.0), "auc"), ic):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def _ranked(trades: DataFrame, runs: list[str]) -> DataFrame:
    """Trades with their run's place among the expected runs; one of another run is an error."""
    place = F.array_position(F.array(*map(F.lit, runs)), F.col("run"))
    known = F.when(place > 0, (place - 1).cast("int")).otherwise(F.raise_error(F.lit("a trade of a run that is not expected")).cast("int"))
    return trades.withColumn("run_rank", known)


def realization_order(trades: DataFrame, runs: list[str]) -> DataFrame:
    """Trades (id, run, exit) with their place by (run's rank, exit, id), from 1.

    The place inside a run is a running count by time buckets; what earlier runs hold is one row for each run.
    """
    rows = _ranked(trades, runs).withColumn("__one", F.lit(1.0))
    inside = asof.running_sum(rows, "run_rank", "exit", "id", "__one", "__n", BUCKET_DAYS).drop("__one")
    sizes = rows.groupBy("run_rank").agg(F.count("*").alias("__size"))
    before = sizes.select("run_rank", F.coalesce(F.sum("__size").over(Window.orderBy("run_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(before), "run_rank").withColumn("place", F.col("__n").cast("long") + F.col("__before")).drop("__n", "__before")


def conservative_drawdown(trades: DataFrame, runs: list[str]) -> DataFrame:
    """Largest fall from the realised peak with the adverse bounds of all open trades on top, as one row.

    Trades are (id, run, entry, exit, pnl, adverse); an interval is [entry, exit), so exits come before entries of the
    same time. Realised results go on from run to run, open bounds do not. Sums and peaks run inside buckets of time;
    what comes before a bucket is one row for each (run, bucket).
    """
    exits = F.struct(F.col("exit").alias("t"), F.lit(0).alias("kind"), F.col("pnl").alias("gain"), F.when(F.col("exit") > F.col("entry"), -F.col("adverse")).otherwise(0 * F.col("adverse")).alias("open"))
    entries = F.struct(F.col("entry").alias("t"), F.lit(1).alias("kind"), (0 * F.col("pnl")).alias("gain"), F.col("adverse").alias("open"))
    events = _ranked(trades, runs).select("run_rank", "id", F.explode(F.array_compact(F.array(exits, F.when(F.col("exit") > F.col("entry"), entries)))).alias("e")).select("run_rank", "id", "e.*")
    events = events.withColumn("b", F.floor(F.col("t") / BUCKET_DAYS))
    w = Window.partitionBy("run_rank", "b").orderBy("t", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    inner = events.withColumns({"g": F.sum("gain").over(w), "o": F.sum("open").over(w)})
    inner = inner.withColumn("high", F.max("g").over(w))
    totals = inner.groupBy("run_rank", "b").agg(F.sum("gain").alias("gain_all"), F.sum("open").alias("open_all"), F.max("high").alias("most"))
    past = Window.orderBy("run_rank", "b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"g0": F.coalesce(F.sum("gain_all").over(past), F.lit(0)), "o0": F.coalesce(F.sum("open_all").over(Window.partitionBy("run_rank").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    totals = totals.withColumn("peak0", F.greatest(F.coalesce(F.max(F.col("g0") + F.col("most")).over(past), F.lit(0)), F.lit(0)))
    both = inner.join(totals.select("run_rank", "b", "g0", "o0", "peak0"), ["run_rank", "b"])
    peak = F.greatest("peak0", F.col("g0") + F.col("high"), F.lit(0))
    fall = peak - (F.col("g0") + F.col("g"))
    return both.agg(F.max(fall).alias("realized_drawdown"), F.max(fall + F.greatest(F.col("o0") + F.col("o"), F.lit(0))).alias("conservative_drawdown"))


def portfolio_risk(returns: DataFrame, cap: float, cluster_at: float, gates: dict[str, float]) -> DataFrame:
    """Risk of inverse-volatility weights (none above ``cap``) over returns (symbol, open_time, r), as one row.

    Only times that every symbol has count. Symbols are a small dimension: pairs of them are rows here, returns never are.
    ``gates`` bounds symbols, observations, effective_symbols, adjusted_symbols from below and cluster_weight, cvar,
    drawdown from above; those that fail are listed.
    """
    aligned = regimes.cut(asof.common_timestamps(regimes.cut(returns.where("r is not null").select("symbol", "open_time", "r"))))
    inverse = aligned.groupBy("symbol").agg((1 / F.greatest(F.stddev_pop("r"), F.lit(1e-9))).alias("inverse"))
    weights = regimes.cut(panels.capped_weights(inverse, cap))
    share = weights.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
    other = aligned.select(F.col("symbol").alias("other"), "open_time", F.col("r").alias("s"))
    pairs = aligned.join(other, "open_time").where("symbol < other").groupBy("symbol", "other").agg(F.coalesce(F.corr("r", "s"), F.lit(0.0)).alias("corr"))
    pairs = regimes.cut(pairs)
    right = share.select(F.col("symbol").alias("other"), F.col("share").alias("other_share"))
    mass = F.col("share") * F.col("other_share")
    joint = pairs.join(share.select("symbol", "share"), "symbol").join(right, "other").agg(F.greatest(F.max("corr"), F.lit(0.0)).alias("max_correlation"), F.coalesce(F.sum(F.col("corr") * mass) / F.sum(mass), F.lit(0.0)).alias("mean_correlation"), F.coalesce(F.sum(2 * F.greatest("corr", F.lit(0.0)) * mass), F.lit(0.0)).alias("__joint"))
    alone = share.agg(F.count("*").alias("symbols"), F.sum("weight").alias("deployed"), (1 / F.sum(F.col("share") ** 2)).alias("effective_symbols"), F.sum(F.col("share") ** 2).alias("__alone"))
    clusters = regimes.correlation_clusters(pairs, share.select("symbol"), cluster_at).join(weights, "symbol").groupBy("cluster").agg(F.sum("weight").alias("w")).agg(F.count("*").alias("clusters"), F.max("w").alias("max_cluster_weight"))
    path = regimes.cut(aligned.join(weights, "symbol").groupBy("open_time").agg(F.sum(F.col("weight") * F.col("r")).alias("r")))
    tail = path.agg(F.count("*").alias("observations"), F.greatest(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY -r)"), F.lit(0.0)).alias("var"))
    beyond = path.crossJoin(F.broadcast(tail.select("var"))).where(-F.col("r") >= F.col("var")).agg(F.greatest(F.avg(-F.col("r")), F.lit(0.0)).alias("cvar"))
    growth = path.select(F.lit("all").alias("symbol"), "open_time", F.lit(0).alias("id"), F.log(1 + F.col("r")).alias("g"))
    equity = asof.running_sum(growth, "symbol", "open_time", "id", "g", "equity", 4096 * 3_600_000)
    fall = _deepest(equity)
    out = alone
    for one in (joint, clusters, tail, beyond, fall):
        out = out.crossJoin(F.broadcast(one))  # one row each
    out = out.withColumn("adjusted_symbols", 1 / (F.col("__alone") + F.col("__joint"))).drop("__alone", "__joint")
    low = [F.when(F.col(c) + 1e-3 < gates[c], c) for c in ("symbols", "observations", "effective_symbols", "adjusted_symbols")]
    high = [F.when(F.col(c) > gates[k], k) for k, c in (("cluster_weight", "max_cluster_weight"), ("cvar", "cvar"), ("drawdown", "drawdown"))]
    return out.withColumn("failed", F.concat_ws(",", *low, *high)).withColumn("accepted", F.col("failed") == "")


def _deepest(equity: DataFrame, bucket: int = 4096 * 3_600_000) -> DataFrame:
    """Largest relative fall of exp(equity) from its peak so far, peaks carried over buckets of time."""
    rows = equity.withColumn("b", F.floor(F.col("open_time") / bucket))
    high = F.max("equity").over(Window.partitionBy("b").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0))
    tops = rows.groupBy("b").agg(F.max("equity").alias("most"))
    tops = tops.select("b", F.greatest(F.coalesce(F.max("most").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0)).alias("peak0"))
    return rows.withColumn("high", high).join(F.broadcast(tops), "b").agg(F.max(1 - F.exp(F.col("equity") - F.greatest("high", "peak0"))).alias("drawdown"))


def grade_sources(rollups: DataFrame) -> DataFrame:
    """A grade from 0 to 10 for each source's rollup: samples, confidence, actionability, evidence and outcomes."""

    def unit(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))

    volume = F.least(F.lit(3.0), F.log(F.col("samples") + 1.0) * 1.15)
    evidence = F.when((F.col("raw_records") > 0) & (F.col("component_records") > 0), 1.0).when((F.col("raw_records") > 0) | (F.col("component_records") > 0), 0.4).otherwise(0.0)
    outcome = F.coalesce((unit("directional_accuracy") - 0.5) * F.least(F.lit(4.0), 1 + F.log(F.col("outcomes") + 1.0)), F.lit(0.0))
    outcome = F.when(F.col("directional_accuracy").isNull(), 0.0).otherwise(outcome)
    grade = F.bround(1.5 + volume + 3 * unit("mean_confidence") + 2 * unit("mean_abs") + evidence + outcome)
    return rollups.withColumn("grade", F.greatest(F.lit(0), F.least(F.lit(10), grade.cast("int"))))


def audit_rollup(checks: DataFrame, by: str) -> DataFrame:
    """Checks (by, check, status) rolled up to the worst of ok, warn and fail, with those that are not ok by name."""
    level = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    rows = checks.withColumn("__level", level)
    out = rows.groupBy(by).agg(F.max("__level").alias("__worst"), *[F.count_if(F.col("__level") == k).alias(n) for k, n in enumerate(("ok", "warn", "fail"))], F.array_join(F.array_sort(F.collect_list(F.when(F.col("__level") > 0, F.concat_ws(":", "status", "check")))), ",").alias("issues"))
    return out.withColumn("status", F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.col("__worst") + 1)).drop("__worst")
