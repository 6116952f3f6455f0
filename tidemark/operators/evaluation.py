"""Evaluation and portfolio statistics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranks


def binary_metrics(df: DataFrame) -> DataFrame:
    """Losses, accuracy, Matthews correlation (0 where a class or call is missing) and average precision, as one row."""
    y, p = F.col("y"), F.col("p")
    call = (p >= 0.5).cast("int")
    a, b, c, d = (F.count_if((call == i) & (y == j)).cast("double") for i, j in ((1, 1), (1, 0), (0, 1), (0, 0)))
    spread = F.sqrt((a + b) * (a + c) * (d + b) * (d + c))
    sums = df.agg(F.count("*").alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((p - y) ** 2).alias("brier"), F.avg((call == y).cast("double")).alias("accuracy"), F.avg(y.cast("double")).alias("prevalence"), F.when(spread > 0, (a * d - b * c) / spread).otherwise(0.0).alias("mcc"))
    return sums.crossJoin(F.broadcast(ranks.average_precision(df)))  # one row each


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    cells = df.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg(F.col("y").cast("double")).alias("y"))
    return cells.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def confusion(df: DataFrame) -> DataFrame:
    hot = F.col("p") >= 0.5
    c = df.agg(F.count_if(hot & (F.col("y") == 1)).alias("tp"), F.count_if(hot & (F.col("y") == 0)).alias("fp"), F.count_if(~hot & (F.col("y") == 0)).alias("tn"), F.count_if(~hot & (F.col("y") == 1)).alias("fn"))
    return c.withColumn("balanced_accuracy", (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2)


def daily_metric(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def replay_metrics(trades: DataFrame) -> DataFrame:
    """Count, net, median, share of winners, gains over losses and days of each symbol's results.

    Sums run by day first, so that days are counted without sets; medians come from a narrow range of values.
    """
    gain = F.col("pnl") > 0
    days = trades.groupBy("symbol", "exit").agg(
        F.count("*").alias("n"), F.count("pnl").alias("told"), F.sum("pnl").alias("net"), F.count_if(gain).alias("won"),
        F.sum(F.least("pnl", F.lit(0.0))).alias("lost"), F.sum(F.greatest("pnl", F.lit(0.0))).alias("gained"),
    )
    loss = -F.sum("lost")
    sums = days.groupBy("symbol").agg(
        F.sum("n").alias("trades"), F.sum("net").alias("net"), (F.sum("won") / F.sum("told")).alias("positive_rate"),
        F.when(loss > 0, F.sum("gained") / loss).alias("profit_factor"), F.count("exit").alias("active_days"),
    )
    middle = ranks.medians(trades, "symbol", "pnl")
    return sums.join(middle, F.col("symbol").eqNullSafe(F.col("__key")), "left").select("symbol", "trades", "net", "median", "positive_rate", "profit_factor", "active_days")


def drawdown(trades: DataFrame) -> DataFrame:
    """Largest fall of cumulative daily profit from its peak, for each symbol."""
    daily = trades.groupBy("symbol", "exit").agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("symbol").orderBy("exit").rowsBetween(Window.unboundedPreceding, 0)
    e = daily.withColumn("equity", F.sum("pnl").over(w))
    return e.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0.0))).groupBy("symbol").agg(F.max(F.col("peak") - F.col("equity")).alias("drawdown"))


def concurrent_exposure(trades: DataFrame) -> DataFrame:
    """Most trades open at once for each symbol, over [entry, exit); exits go before entries of the same day."""
    steps = trades.select("symbol", F.explode(F.array(F.struct(F.col("entry").alias("day"), F.lit(1).alias("d")), F.struct(F.col("exit").alias("day"), F.lit(-1).alias("d")))).alias("s"))
    daily = steps.groupBy("symbol", F.col("s.day").alias("day")).agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("open", F.sum("d").over(w)).groupBy("symbol").agg(F.max("open").cast("long").alias("most_open"))


def source_rollups(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source", "kind").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.abs("score")).alias("mean_abs"), F.avg(F.get_json_object("payload", "$.k").cast("double")).alias("mean_k"))


def latest_per_key(obs: DataFrame) -> DataFrame:
    """The newest observation of each (source, kind), by one aggregate."""
    return obs.groupBy("source", "kind").agg(F.max(F.struct("observed_at", "id", "score")).alias("m")).select("source", "kind", "m.observed_at", "m.id", "m.score")


def recent(obs: DataFrame, n: int) -> DataFrame:
    """The newest n observations (a top-k report)."""
    return obs.orderBy(F.desc("observed_at"), F.desc("id")).limit(n).select("id", "observed_at", "source", "kind")


def day_weights(df: DataFrame) -> DataFrame:
    """Rows weighted so that every day counts the same."""
    return df.select("id", (F.lit(1.0) / F.count("*").over(Window.partitionBy("day"))).alias("weight"))


def equal_windows(df: DataFrame, n: int) -> DataFrame:
    """n chronological windows of days, as even as whole days allow, and the rows of each."""
    days = df.groupBy("day").agg(F.count("*").alias("rows"), F.avg("y").alias("rate"))
    w = (F.floor((F.row_number().over(Window.orderBy("day")) - 1) * n / F.count("*").over(Window.partitionBy())) + 1).cast("int")
    return days.withColumn("window", w).groupBy("window").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("rows").alias("n"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.agg(F.count("*").alias("n"), F.avg(e**2).alias("mse"), F.sqrt(F.avg(e**2)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.corr(y, p).alias("pearson"), F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("sign_accuracy"))


def ranked_outcomes(df: DataFrame, signal: str, net: str, by: str, ks: list[int]) -> DataFrame:
    """Mean and median outcome of the k strongest signals of each group, for each k (top-k reports)."""
    top = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.abs(signal)), "id"))
    rows = df.withColumn("__n", top).where(F.col("__n") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("__n <= k")
    return rows.groupBy(by, "k").agg(F.count("*").alias("n"), F.avg(net).alias("mean"), F.median(net).alias("median"))


def hashed_flip(*parts: str) -> Column:
    """1 or -1, from the digest of the parts: the same on every run and machine."""
    return F.when(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in parts])), 1, 2), 16, 10).cast("int") < 128, 1).otherwise(-1)


def paired_permutation(df: DataFrame, day: str, a: str, b: str, replicates: int) -> DataFrame:
    """One-sided p of mean(a - b) under sign flips of whole days; a replicate sums one row for each day."""
    days = df.groupBy(day).agg(F.sum(F.col(a) - F.col(b)).alias("d"))
    flips = days.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    sums = flips.groupBy("rep").agg(F.sum(F.when(F.col("rep") == 0, F.col("d")).otherwise(F.col("d") * hashed_flip(day, "rep"))).alias("s"))
    seen = sums.where("rep = 0").select(F.col("s").alias("observed"))
    return sums.where("rep > 0").crossJoin(F.broadcast(seen)).agg(F.first("observed").alias("observed"), ((F.count_if(F.col("s") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"))


def bh_qvalues(tests: DataFrame, family: str) -> DataFrame:
    """Benjamini-Hochberg values inside each family of tests (one row for each test)."""
    up = Window.partitionBy(family).orderBy("p", "test")
    raw = tests.withColumn("__q", F.col("p") * F.count("*").over(Window.partitionBy(family)) / F.row_number().over(up))
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("__q").over(up.rowsBetween(0, Window.unboundedFollowing)))).drop("__q")


def portfolio_trace(trades: DataFrame) -> DataFrame:
    """Daily net by symbol with its running sum and share of the day."""
    daily = trades.groupBy("symbol", "exit").agg(F.sum("pnl").alias("net"))
    run = F.sum("net").over(Window.partitionBy("symbol").orderBy("exit").rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumns({"equity": run, "day_net": F.sum("net").over(Window.partitionBy("exit"))})


def ensemble_score(votes: DataFrame) -> DataFrame:
    """Unanimity, mean and worst-case strength over the members' votes on each event."""
    return votes.groupBy("event").agg(F.count("*").alias("members"), F.bool_and(F.col("p") > 0.5).alias("unanimous"), F.avg("p").alias("mean"), F.min("p").alias("worst"), (F.avg("p") > 0.5).alias("long"))


def var_cvar(trades: DataFrame, level: float = 0.95) -> DataFrame:
    """Nearest-rank loss quantile of daily results and the mean of losses from there on."""
    daily = trades.groupBy("symbol", "exit").agg((-F.sum("pnl")).alias("loss"))
    # days are summed once: sums that run again in another order may fall short of the quantile taken from them
    w = Window.partitionBy("symbol")
    placed = daily.where("symbol is not null and loss is not null").select("symbol", "loss", F.count("*").over(w.orderBy("loss")).alias("__upto"), F.count("*").over(w).alias("__n"))
    return placed.where(F.col("__upto") >= level * F.col("__n")).groupBy("symbol").agg(F.min("loss").alias("var"), F.avg("loss").alias("cvar"))


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """Correlation of each pair of symbols over the times both have."""
    r = returns.where("r is not null").select("symbol", "open_time", "r")
    other = r.select(F.col("symbol").alias("other"), "open_time", F.col("r").alias("s"))
    return r.join(other, "open_time").where("symbol < other").groupBy("symbol", "other").agg(F.count("*").alias("n"), F.corr("r", "s").alias("corr"))


def inverse_volatility(trades: DataFrame) -> DataFrame:
    """Weights in proportion to one over the deviation of daily results."""
    daily = trades.groupBy("symbol", "exit").agg(F.sum("pnl").alias("pnl"))
    inverse = daily.groupBy("symbol").agg((1 / F.stddev_pop("pnl")).alias("inverse"))
    return inverse.select("symbol", (F.col("inverse") / F.sum("inverse").over(Window.partitionBy())).alias("weight"))


def path_quality(trades: DataFrame) -> DataFrame:
    """Profit factor (at most 999), expectancy, longest run of losing days and the largest day's share of the gains."""
    daily = trades.groupBy("symbol", "exit").agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("symbol").orderBy("exit")
    rows = daily.withColumn("__run", F.sum(F.when(F.col("pnl") >= 0, 1).otherwise(0)).over(w))
    runs = rows.groupBy("symbol", "__run").agg(F.count_if(F.col("pnl") < 0).alias("losses"), F.sum(F.greatest("pnl", F.lit(0.0))).alias("gain"), F.sum(F.least("pnl", F.lit(0.0))).alias("loss"), F.max("pnl").alias("best"), F.count("*").alias("days"))
    gain, loss = F.sum("gain"), -F.sum("loss")
    return runs.groupBy("symbol").agg(F.when(loss > 0, F.least(F.lit(999.0), gain / loss)).otherwise(999.0).alias("profit_factor"), ((gain - loss) / F.sum("days")).alias("expectancy"), F.max("losses").alias("longest_losses"), F.when(gain > 0, F.greatest(F.max("best"), F.lit(0.0)) / gain).alias("best_share"))


def forecast_metrics(df: DataFrame) -> DataFrame:
    """Error against the random walk, correlation and direction of forecasts, for each symbol and overall (one rollup)."""
    return df.rollup("symbol").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("forecast") - F.col("target"))).alias("mae"), F.avg(F.abs("target")).alias("walk_mae"), F.corr("forecast", "target").alias("ic"), F.avg((F.signum("forecast") == F.signum("target")).cast("double")).alias("direction"))


def forecast_scale(df: DataFrame, cut: int) -> DataFrame:
    """Least squares through the origin before the cut, held in [0, 1]; squared error of both forecasts after it."""
    fit = df.where(F.col("open_time") < cut).groupBy("symbol").agg((F.sum(F.col("forecast") * F.col("target")) / F.sum(F.col("forecast") ** 2)).alias("raw")).select("symbol", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "raw")).alias("scale"))
    late = df.where(F.col("open_time") >= cut).join(F.broadcast(fit), "symbol")
    return late.groupBy("symbol").agg(F.first("scale").alias("scale"), F.avg((F.col("scale") * F.col("forecast") - F.col("target")) ** 2).alias("scaled_mse"), F.avg(F.col("target") ** 2).alias("zero_mse"))


def transition_matrix(states: DataFrame, n: int, prior: float = 1.0) -> DataFrame:
    """Smoothed chance of each later state given the earlier one, for all n * n pairs."""
    seen = states.groupBy("pre", "post").agg(F.count("*").alias("n"))
    spine = states.sparkSession.range(n * n).select((F.floor(F.col("id") / n)).cast("int").alias("pre"), (F.col("id") % n).cast("int").alias("post"))
    full = spine.join(seen, ["pre", "post"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("chance", (F.col("n") + prior) / (F.sum("n").over(Window.partitionBy("pre")) + prior * n))


def condition_mean(df: DataFrame, condition: str, value: str) -> DataFrame:
    """Mean of the conditions' means."""
    return df.groupBy(condition).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"), F.count("*").alias("conditions"))


def universe_rank(rows: DataFrame, least_trades: int, share: float, k: int) -> DataFrame:
    """Symbols by liquidity (quote volume against the largest), with the reasons that rule one out (a top-k report)."""
    top = rows.agg(F.max("quote_volume").alias("top"))
    r = rows.crossJoin(F.broadcast(top))
    reasons = F.concat_ws(",", F.when(F.col("trades") < least_trades, "few_trades"), F.when(F.col("quote_volume") < share * F.col("top"), "thin"))
    return r.select("symbol", (F.col("quote_volume") / F.col("top")).alias("score"), reasons.alias("reasons"), (reasons == "").alias("eligible")).orderBy(F.desc("score"), "symbol").limit(k)


def windowed_robustness(trades: DataFrame, n: int) -> DataFrame:
    """Net, win rate and acceptance in each of n equal spans of exit days."""
    ends = trades.agg(F.min("exit").alias("__a"), F.max("exit").alias("__b"))
    span = F.floor((F.col("exit") - F.col("__a")) * n / (F.col("__b") - F.col("__a") + 1)).cast("int").alias("window")
    return trades.crossJoin(F.broadcast(ends)).groupBy(span).agg(F.count("*").alias("n"), F.sum("pnl").alias("net"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), (F.sum("pnl") > 0).alias("accepted"))


def routed_cost(fee_bps: float) -> list[Column]:
    """Spread, spread with both fees, delay, and the share of rows cheaper than a basis point beyond the fees."""
    spread = (F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2) * 10_000
    total = spread + 2 * fee_bps
    return [F.avg(spread).alias("spread_cost"), F.avg(total).alias("total_cost"), F.avg(F.col("event_ms") - F.col("txn_ms")).alias("mean_delay"), F.avg((total < 2 * fee_bps + 1).cast("double")).alias("cheap_rate")]
