"""Outcome labels over dense bars, and the order in which they may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import KEYS, by_time, chunked, own, realised_volatility


def lookahead_label(bars: DataFrame, k: int, threshold: float, warm_up: int) -> DataFrame:
    """Whether the close k bars on is up by the threshold; the first ``warm_up`` bars of a symbol and those without a future go."""
    rows = chunked(bars, warm_up, k)
    ahead = F.lead("close", k).over(by_time()) / F.col("close") - 1
    out = own(rows.select(*KEYS, F.lag("close", warm_up).over(by_time()).alias("warm"), ahead.alias("future")))
    return out.where("warm is not null and future is not null").select("symbol", "open_time", "future", (F.col("future") >= threshold).cast("int").alias("label"))


def vwap_target(bars: DataFrame, delay: int, horizon: int) -> DataFrame:
    """Log ratio in basis points of the mean traded prices at entry and exit; null unless both bars traded."""
    vwap = F.when(F.col("volume") > 0, F.col("quote_volume") / F.col("volume"))
    rows = chunked(bars, 0, delay + horizon).withColumn("v", vwap)
    value = F.log(F.lead("v", delay + horizon).over(by_time()) / F.lead("v", delay).over(by_time())) * 10_000
    return own(rows.select(*KEYS, value.alias("target")))


def cross_spread(quotes: DataFrame, cost_bps: float) -> DataFrame:
    """Basis points of buying at the ask and selling at the later bid, and the reverse, before and after costs on both sides."""
    long = (F.col("exit_bid") / F.col("ask") - 1) * 10_000
    short = (1 - F.col("exit_ask") / F.col("bid")) * 10_000
    return quotes.withColumns({"long_gross": long, "short_gross": short, "long_net": long - 2 * cost_bps, "short_net": short - 2 * cost_bps})


def adaptive_distances(bars: DataFrame, n: int, horizon: int, stop: tuple[float, float, float], take: tuple[float, float, float]) -> DataFrame:
    """Bars with ``stop`` and ``take``: a multiple of the last n returns' deviation times the root of the horizon, between a least and a most.

    ``stop`` and ``take`` are (multiple, least, most), as shares of the price; bars without a full frame are left out.
    """
    known = bars.join(realised_volatility(bars, n), ["symbol", "open_time"]).where("volatility is not null")
    sigma = F.col("volatility") * float(horizon) ** 0.5

    def held(spec: tuple[float, float, float]) -> Column:
        return F.greatest(F.lit(spec[1]), F.least(F.lit(spec[2]), spec[0] * sigma))

    return known.withColumns({"stop": held(stop), "take": held(take)}).drop("volatility")


def triple_barrier(bars: DataFrame, horizon: int, stop: float | str, take: float | str | None) -> DataFrame:
    """Long outcome in basis points of entry at the next open over the ``horizon`` bars from there.

    The first bar that touches a barrier decides; where it touches both, the stop counts and the row is ambiguous. A
    stop fills at the worse of its price and the bar's open. Without a touch the exit is the open after the horizon.
    Distances are shares of the entry price, or the names of columns that hold them.
    """
    named = [d for d in (stop, take) if isinstance(d, str)]
    path = F.collect_list(F.struct("open", "high", "low", "open_time")).over(by_time().rowsBetween(1, horizon + 1))
    rows = own(chunked(bars, 0, horizon + 1).select(*KEYS, *named, path.alias("path"))).where(F.size("path") == horizon + 1)
    rows = rows.withColumn("entry", F.col("path")[0]["open"])
    stop_at = F.col("entry") * (1 - (F.col(stop) if isinstance(stop, str) else stop))
    take_at = F.col("entry") * (1 + (F.col(take) if isinstance(take, str) else take)) if take is not None else F.lit(float("inf"))
    touched = F.filter(F.slice("path", 1, horizon), lambda x: (x["low"] <= stop_at) | (x["high"] >= take_at))
    rows = rows.withColumn("hit", F.get(touched, F.lit(0))).withColumn("stopped", F.col("hit.low") <= stop_at)
    price = F.when(F.col("hit").isNull(), F.element_at("path", -1)["open"]).when(F.col("stopped"), F.least(stop_at, F.col("hit.open"))).otherwise(take_at)
    kind = F.when(F.col("hit").isNull(), "timeout").when(F.col("stopped"), "stop").otherwise("take")
    both = F.coalesce(F.col("stopped") & (F.col("hit.high") >= take_at), F.lit(False))
    return rows.select("symbol", "open_time", kind.alias("outcome"), both.alias("ambiguous"), F.coalesce(F.col("hit.open_time"), F.element_at("path", -1)["open_time"]).alias("exit_time"), ((price / F.col("entry") - 1) * 10_000).alias("payoff"))


def funding_episodes(events: DataFrame, threshold: float) -> DataFrame:
    """Runs of events of one sign at or beyond the threshold: first and last time, length and sum. One row per event and 8 hours goes in."""
    w = Window.partitionBy("symbol").orderBy("t")
    sign = F.when(F.col("rate") >= threshold, 1).when(F.col("rate") <= -threshold, -1).otherwise(0)
    rows = events.withColumn("sign", sign).withColumn("new", (F.col("sign") != F.coalesce(F.lag("sign").over(w), F.lit(9))).cast("int"))
    runs = rows.withColumn("run", F.sum("new").over(w)).where("sign != 0")
    return runs.groupBy("symbol", "run").agg(F.first("sign").alias("sign"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("events"), F.sum("rate").alias("total")).drop("run")


def assign_roles(df: DataFrame, t: str, exit_t: str, roles: list[tuple[str, int, int]]) -> DataFrame:
    """The role whose [start, end) holds both the row and the end of its label; other rows go. The roles are literals, not a join."""
    role = F.coalesce(*[F.when((F.col(t) >= a) & (F.col(exit_t) < b), F.lit(name)) for name, a, b in roles])
    return df.withColumn("role", role).where("role is not null")


def expanding_folds(df: DataFrame, t: str, exit_t: str, cuts: list[int], width: int) -> DataFrame:
    """Each row once for each fold: training before the cut if its label ended by then, evaluation in the width after it."""
    fold = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(c).alias("cut")) for i, c in enumerate(cuts)]))
    rows = df.withColumn("__f", fold).select(*df.columns, "__f.fold", "__f.cut")
    part = F.when(F.col(exit_t) < F.col("cut"), "train").when((F.col(t) >= F.col("cut")) & (F.col(exit_t) < F.col("cut") + width), "evaluate")
    return rows.withColumn("part", part).where("part is not null").drop("cut")


def inside_day(df: DataFrame, t: str, before: int, after: int, day_ms: int = 86_400_000) -> DataFrame:
    """Rows whose warm-up and lifecycle stay inside their UTC day."""
    into = F.pmod(F.col(t), F.lit(day_ms))
    return df.where((into >= before) & (into + after < day_ms))


def day_chunks(df: DataFrame, t: str, day_ms: int = 86_400_000) -> DataFrame:
    """Every UTC day from the first to the last, with its bounds."""
    ends = df.agg(F.floor(F.min(t) / day_ms).alias("a"), F.floor(F.max(t) / day_ms).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).select("day", (F.col("day") * day_ms).alias("start"), ((F.col("day") + 1) * day_ms).alias("end"))


def recency_weights(df: DataFrame, t: str, half_life: float) -> DataFrame:
    """2 ^ (-age / half life) against the newest row, scaled to mean 1. The two totals are one row each."""
    newest = df.agg(F.max(t).alias("__newest"))
    raw = F.pow(F.lit(2.0), -(F.col("__newest") - F.col(t)) / half_life)
    rows = df.crossJoin(F.broadcast(newest)).withColumn("__raw", raw).drop("__newest")
    mean = rows.agg(F.avg("__raw").alias("__mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("__raw") / F.col("__mean")).drop("__raw", "__mean")


def successive_halving(results: DataFrame, candidate: str, score: str, least: int, keep: float) -> DataFrame:
    """Candidates with enough results, ranked by mean score, and whether they are among the best share kept."""
    means = results.groupBy(candidate).agg(F.avg(score).alias("score"), F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), candidate))  # one row for each candidate
    return means.withColumn("rank", rank).withColumn("kept", F.col("rank") <= F.ceil(F.count("*").over(Window.partitionBy()) * keep))


def impact_cost(notional: Column, liquidity: Column, spread_bps: Column, impact_bps: float) -> Column:
    """Half the spread and a square-root impact of the share of liquidity taken, in basis points."""
    return spread_bps / 2 + F.when(liquidity > 0, impact_bps * F.sqrt(notional / liquidity)).otherwise(F.lit(impact_bps))
