"""Feature sets over dense bars, books and several symbols at once, spaced events, refit splits and capped weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, replay
from tidemark.operators.features import KEYS, by_time, chunked, frame, full, own


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(other)


def tape_features(bars: DataFrame, n: int) -> DataFrame:
    """Flow, price and activity of the last n bars: shares, gap to VWAP, range, drift, surprise, shift and correlation."""
    rows = chunked(bars, 2 * n + 1)
    r = F.coalesce(F.col("close") / F.lag("close").over(by_time()) - 1, F.lit(0.0))
    flow = ratio(2 * F.col("buy_volume") - F.col("volume"), F.col("volume"))
    rows = rows.withColumns({"__r": r, "__f": flow, "__drift": F.col("close") / F.col("open") - 1, "__range": (F.col("high") - F.col("low")) / F.col("close"), "__none": (F.col("trade_count") == 0).cast("double")})
    w, half, before = frame(n), frame(n // 2), by_time().rowsBetween(-(2 * n - 1), -n)
    vwap = ratio(F.sum("quote_volume").over(w), F.sum("volume").over(w), 1.0)
    vx, vy = F.var_pop("__f").over(w), F.var_pop("__r").over(w)
    out = {
        "buy_share": ratio(F.sum("buy_volume").over(w), F.sum("volume").over(w), 0.5),
        "imbalance": ratio(F.sum(2 * F.col("buy_volume") - F.col("volume")).over(w), F.sum("volume").over(w)),
        "surprise": F.tanh(F.log((1 + F.sum("quote_volume").over(w)) / (1 + F.sum("quote_volume").over(before)))),
        "vwap_gap": ratio(F.col("close") - vwap, vwap),
        "range": F.avg("__range").over(w),
        "drift": F.avg("__drift").over(w),
        "silent": F.avg("__none").over(w),
        "shift": F.avg("__f").over(half) - F.avg("__f").over(by_time().rowsBetween(-(n - 1), -(n // 2))),
        "flow_corr": F.when(vx * vy > 1e-18, F.covar_pop("__f", "__r").over(w) / F.sqrt(vx * vy)).otherwise(0.0),
    }
    ready = F.count("close").over(frame(2 * n)) == 2 * n
    return own(rows.select(*KEYS, *[F.when(ready, v).alias(k) for k, v in out.items()]))


def panel_features(bars: DataFrame, lags: tuple[int, ...], n: int) -> DataFrame:
    """Lagged log returns, deviation, downside deviation, volume ratio and z-score, beside the cross-section of each time."""
    rows = chunked(bars, max(*lags, n) + 1).withColumn("__r", F.log(F.col("close") / F.lag("close").over(by_time())))
    w = frame(n)
    spread = F.stddev_pop("close").over(w)
    cols = {f"return_{k}": F.log(F.col("close") / F.lag("close", k).over(by_time())) for k in lags} | {
        "volatility": full(F.sqrt(F.avg(F.col("__r") ** 2).over(w)), "__r", n),
        "semivolatility": full(F.sqrt(F.avg(F.least("__r", F.lit(0.0)) ** 2).over(w)), "__r", n),
        "volume_ratio": full(ratio(F.col("volume"), F.avg("volume").over(w)), "__r", n),
        "z": full(F.when(spread > 1e-9, (F.col("close") - F.avg("close").over(w)) / spread).otherwise(0.0), "__r", n),
    }
    own_rows = own(rows.select(*KEYS, "__r", *[v.alias(k) for k, v in cols.items()]))
    others = own_rows.groupBy("open_time").agg(F.stddev_pop("__r").alias("dispersion"), F.abs(F.avg(F.signum("__r"))).alias("agreement"), F.avg("__r").alias("__mean"))
    return own_rows.join(others, "open_time").withColumn("residual", F.col("__r") - F.col("__mean")).drop("__r", "__mean")


def premium_features(spine: DataFrame, n: int, coverage: float) -> DataFrame:
    """Mean, deviation, z-score and positive share over the values observed in the last n steps, if enough were; and age.

    ``spine`` is dense, with ``value`` null where nothing was observed.
    """
    w = frame(n)
    seen = F.count("value").over(w)
    ready = (seen >= F.ceil(F.lit(coverage * n))) & (F.count("open_time").over(w) == n)
    mean, spread = F.avg("value").over(w), F.stddev_pop("value").over(w)
    rows = chunked(spine, n)
    return own(
        rows.select(
            *KEYS,
            F.when(ready, mean).alias("mean"),
            F.when(ready, spread).alias("deviation"),
            F.when(ready & F.col("value").isNotNull(), F.when(spread > 1e-9, (F.col("value") - mean) / spread).otherwise(0.0)).alias("z"),
            F.when(ready, F.avg((F.col("value") > 0).cast("double")).over(w)).alias("positive"),
            (seen / n).alias("observed"),
            (F.col("open_time") - F.max(F.when(F.col("value").isNotNull(), F.col("open_time"))).over(w)).alias("age"),
        )
    )


def leader_features(bars: DataFrame, leader: str) -> DataFrame:
    """Mean, dispersion and agreement of returns and flows at each time, and the leader's (for itself: the others' mean)."""
    rows = own(chunked(bars, 1).select(*KEYS, (10_000 * F.log(F.col("close") / F.lag("close").over(by_time()))).alias("r"), ratio(2 * F.col("buy_volume") - F.col("volume"), F.col("volume")).alias("f"))).where("r is not null")
    rest, first = F.col("symbol") != leader, F.col("symbol") == leader
    at = rows.groupBy("open_time").agg(
        F.avg("r").alias("return_mean"), F.stddev_pop("r").alias("return_dispersion"), F.abs(F.avg(F.signum("r"))).alias("agreement"), F.avg("f").alias("flow_mean"), F.stddev_pop("f").alias("flow_dispersion"),
        F.max(F.when(first, F.col("r"))).alias("__r"), F.max(F.when(first, F.col("f"))).alias("__f"), F.avg(F.when(rest, F.col("r"))).alias("__or"), F.avg(F.when(rest, F.col("f"))).alias("__of"),
    )
    both = rows.join(at, "open_time")
    return both.select("symbol", "open_time", "return_mean", "return_dispersion", "agreement", "flow_mean", "flow_dispersion", F.when(first, F.col("__or")).otherwise(F.col("__r")).alias("leader_return"), F.when(first, F.col("__of")).otherwise(F.col("__f")).alias("leader_flow"))


def flow_history(trades: DataFrame, bars: DataFrame, step: int, n: int) -> DataFrame:
    """Return, variance, log volume, signed share and concentration of notional over the last n dense bars."""
    quote = F.col("price") * F.col("qty")
    cells = trades.groupBy("symbol", (F.floor(F.col("t") / step) * step).alias("open_time")).agg(F.sum(quote).alias("q"), F.sum(quote**2).alias("qq"), F.sum(F.when(F.col("buyer_is_maker"), -quote).otherwise(quote)).alias("sq"))
    rows = chunked(bars.select("symbol", "open_time", "close").join(cells, ["symbol", "open_time"], "left").fillna(0.0, ["q", "qq", "sq"]), n + 1)
    rows = rows.withColumn("__r", F.log(F.col("close") / F.lag("close").over(by_time())))
    w = frame(n)
    q = F.sum("q").over(w)
    return own(rows.select(*KEYS, full(F.sum("__r").over(w), "__r", n).alias("log_return"), full(F.sum(F.col("__r") ** 2).over(w), "__r", n).alias("variance"), full(F.log1p(q), "__r", n).alias("log_volume"), full(ratio(F.sum("sq").over(w), q), "__r", n).alias("signed_share"), full(ratio(F.sum("qq").over(w), q * q), "__r", n).alias("concentration")))


def depth_stress(books: DataFrame, near: int, far: int) -> DataFrame:
    """Thinness, absolute imbalance and far-to-near concentration of a book: larger means more stress."""

    def sums(side: str, n: int, value) -> Column:
        return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda acc, x: acc + value(x))

    def notional(x):
        return x["price"] * x["qty"]

    close, wide = (sums("bids", n, notional) + sums("asks", n, notional) for n in (near, far))
    bid, ask = (sums(s, near, lambda x: x["qty"]) for s in ("bids", "asks"))
    return books.select("update_id", (-F.log1p(close)).alias("thinness"), F.abs(ratio(bid - ask, bid + ask)).alias("imbalance"), (F.log1p(wide) - F.log1p(close)).alias("concentration"))


def spaced_events(rows: DataFrame, spacing: int) -> DataFrame:
    """The first row of each symbol, then each next one at least ``spacing`` after the last taken.

    A row that far behind its predecessor is taken whatever came before, so each such burst is chosen from by itself.
    """
    near = asof.neighbour(rows, "symbol", "t", "id", ["t"], "p_")
    starts = near.withColumn("__new", F.coalesce(F.col("t") - F.col("p_t") >= spacing, F.lit(True)).cast("double")).drop("p_t")
    bursts = asof.running_sum(starts, "symbol", "t", "id", "__new", "__burst").drop("__new").withColumn("__end", F.col("t") + spacing)
    return replay.greedy(bursts, "__end", ("symbol", "__burst"), daily=False).drop("__burst", "__end")


def shock_events(rows: DataFrame, level: float, least: float, train_until: int, spacing: int) -> DataFrame:
    """Rows whose ratio reaches its symbol's nearest-rank training quantile and a floor, spaced out."""
    cuts = rows.where(F.col("t") < train_until).groupBy("symbol").agg(F.expr(f"percentile_disc({level}) WITHIN GROUP (ORDER BY ratio)").alias("__cut"))
    strong = rows.join(cuts, "symbol").where((F.col("ratio") >= F.col("__cut")) & (F.col("ratio") >= least)).drop("__cut")
    return spaced_events(strong, spacing)


def walk_forward(rows: DataFrame, train: int, gap: int, least: int) -> DataFrame:
    """For each day, the rows of the ``train`` days that end ``gap`` before it and have left by then; days with too few go.

    Each row is dealt to the days it trains, so a day is one group-by key and nothing is joined by range.
    """
    days = F.sequence(F.col("day") + gap + 1, F.col("day") + gap + train)
    dealt = rows.withColumn("eval_day", F.explode(days)).where(F.col("exit") < F.col("eval_day"))
    fit = dealt.groupBy("eval_day").agg(F.count("*").alias("train_rows"), F.avg("y").alias("train_rate"))
    seen = rows.groupBy(F.col("day").alias("eval_day")).agg(F.count("*").alias("eval_rows"), F.avg("y").alias("eval_rate"))
    return seen.join(fit, "eval_day").where(F.col("train_rows") >= least)


def monthly_refit(rows: DataFrame, months: int) -> DataFrame:
    """Training rows (of the months before) and evaluation rows of each month; months are counted from year 0."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
    at = rows.withColumn("__m", F.year(date) * 12 + F.month(date) - 1).withColumn("month", F.explode(F.sequence("__m", F.col("__m") + months)))
    cells = at.groupBy("month").agg(F.count_if(F.col("__m") < F.col("month")).alias("train_rows"), F.count_if(F.col("__m") == F.col("month")).alias("eval_rows"))
    return cells.where("train_rows > 0 and eval_rows > 0")


def calendar_windows(rows: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Experiment windows of whole days that fit between the first and last day."""
    ends = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).where(F.col("b") - F.col("a") + 1 >= train + test)
    start = F.explode(F.sequence(F.col("a"), F.col("b") + 1 - train - test, F.lit(step).cast("long")))
    return ends.select(start.alias("train_from")).select("train_from", (F.col("train_from") + train).alias("test_from"), (F.col("train_from") + train + test).alias("test_until"))


def capped_weights(inverse: DataFrame, cap: float) -> DataFrame:
    """Weights in proportion to ``inverse`` with none above ``cap``; what is cut goes to the others in proportion.

    With the largest first, the capped ones are a prefix: its end is the first row whose share of the rest fits.
    """
    w = Window.orderBy(F.desc("inverse"), "symbol")
    every = Window.partitionBy()
    budget = F.least(F.lit(1.0), cap * F.count("*").over(every))
    rows = inverse.select("symbol", "inverse", (F.row_number().over(w) - 1).alias("__i"), F.sum("inverse").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("__rest"), budget.alias("__budget"))
    rows = rows.withColumn("__left", F.col("__budget") - F.col("__i") * cap)
    first = F.min(F.when(F.col("__left") * F.col("inverse") / F.col("__rest") <= cap + 1e-12, F.struct("__i", "__left", "__rest"))).over(every)
    weight = F.when(first.isNull() | (F.col("__i") < first["__i"]), F.lit(cap)).otherwise(first["__left"] * F.col("inverse") / first["__rest"])
    return rows.withColumn("weight", F.greatest(F.lit(0.0), weight)).select("symbol", "weight")


def meta_samples(trades: DataFrame, rows: DataFrame) -> DataFrame:
    """Closed trades with the feature row of their opening time, whether they paid, and how strong the signal was."""
    return trades.join(rows, ["symbol", "t"]).withColumns({"paid": F.col("net") > 0, "strength": F.abs("score")})


def action_label(rows: DataFrame, cost: float) -> DataFrame:
    """What became of each action: unavailable, not filled, stuck without an exit, or a round trip with its utility."""
    state = F.when(~F.col("available"), "unavailable").when(F.col("fill_t").isNull(), "no_fill").when(F.col("exit_t").isNull(), "failed_exit").otherwise("round_trip")
    utility = F.when(state == "round_trip", F.col("net") - cost).when(state == "failed_exit", F.lit(-cost)).when(state == "no_fill", F.lit(0.0))
    return rows.select("id", state.alias("state"), utility.alias("utility"))
