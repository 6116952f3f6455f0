"""Every configuration of a grid of signals replayed on books: look-back, threshold, mode, delay and hold.

Signals, entries and exits are time joins over exploded grids; only the rule of one position at a time is a walk, over
one market of one configuration, since a position ends before its market does.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_forward, asof_join
from tidemark.operators.features import fee
from tidemark.operators.outcomes import known_at
from tidemark.operators.regimes import cut

GRID = ["lookback", "mode", "delay", "hold"]
CONFIG = ["threshold", *GRID]


def first_points(points: DataFrame, step: int) -> DataFrame:
    """The first point by (t, id) of each symbol and step."""
    told = points.where("symbol IS NOT NULL AND t IS NOT NULL")
    return told.groupBy("symbol", F.floor(F.col("t") / step).alias("__s")).agg(F.min(F.struct("t", "id")).alias("__p")).select("symbol", "__p.t")


def peak_loss(rows: DataFrame, by: list[str], part: str, value: str) -> DataFrame:
    """Deepest fall of the running total below its peak (which begins at 0), rows by time, from one row a part; parts follow one another in time.

    Inside a part falls are a window; across parts what came before is its total and peak.
    """
    run = Window.partitionBy(*by, part).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("__r", F.sum(value).over(run)).withColumn("__fall", F.max("__r").over(run) - F.col("__r"))
    parts = inside.groupBy(*by, part).agg(F.min("t").alias("__t"), F.sum(value).alias("__total"), F.max("__r").alias("__high"), F.min("__r").alias("__low"), F.max("__fall").alias("__fall"))
    before = Window.partitionBy(*by).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0.0)))
    placed = placed.withColumn("__peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("__base") + F.col("__high")).over(before), F.lit(0.0))))
    return placed.groupBy(*by).agg(F.greatest(F.lit(0.0), F.max(F.greatest(F.col("__fall"), F.col("__peak") - F.col("__base") - F.col("__low")))).alias("drawdown"))


def signals(lead: DataFrame, second: DataFrame, lookbacks: list[int], step: int, stale: int) -> DataFrame:
    """At the first point of the lead in each step, the mean of both series' log returns over each look-back, in basis points.

    A signal is left out where a price at either end of either series is missing or older than ``stale``.
    """
    offsets = {"now": 0} | {f"b{k}": -k for k in lookbacks}
    points = first_points(lead, step)
    both = known_at(known_at(points, lead, "symbol", "t", offsets, "t", "id").withColumnsRenamed({n: f"x_{n}" for n in offsets}), second, "symbol", "t", offsets, "t", "id")
    fresh = lambda s, n, o: F.col("t") + o - F.col(f"{s}{n}.t") <= stale
    told = []
    for k in lookbacks:
        sane = fresh("x_", "now", 0) & fresh("", "now", 0) & fresh("x_", f"b{k}", -k) & fresh("", f"b{k}", -k)
        score = (F.log(F.col("x_now.price") / F.col(f"x_b{k}.price")) + F.log(F.col("now.price") / F.col(f"b{k}.price"))) * 5_000
        told.append(F.struct(F.lit(k).cast("long").alias("lookback"), F.when(sane, score).alias("score")))
    return both.withColumn("__s", F.explode(F.array(*told))).select("symbol", "t", "__s.lookback", "__s.score").where("score IS NOT NULL")


def priced(found: DataFrame, markets: DataFrame, books: DataFrame, delays: list[int], holds: list[int], quantity: float, rate: float, wait: int) -> DataFrame:
    """Signals inside a market under both modes, every delay and hold, with what buying the token and selling it again made.

    ``markets`` (symbol, market, start, end, up, down) do not overlap; ``books`` have token, t, id, segment, bid, ask and
    quantities. The token of the direction (momentum), or the other (reversion), is bought at the first book at or after
    the delay and sold at the first one after delay and hold, each within ``wait``. ``until`` is null where no trade comes
    of it: a book is missing or thin, the exit is in another segment or not before the market's end.
    """
    inside = asof_join(found, markets, "symbol", "t", "start", "start", "__").where("t < __end")
    ways = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(d).cast("long").alias("delay")) for m in ("momentum", "reversion") for d in delays]))
    rows = inside.withColumn("__w", ways).select("symbol", F.col("__market").alias("market"), F.col("__end").alias("end"), "t", "lookback", "score", "__w.mode", "__w.delay", "__up", "__down")
    rows = rows.withColumn("token", F.when((F.col("score") > 0) == (F.col("mode") == "momentum"), F.col("__up")).otherwise(F.col("__down"))).drop("__up", "__down")
    entry = asof_forward(rows.withColumn("__target", F.col("t") + F.col("delay")), books, "token", "__target", "t", "id", "in_", max_age=wait)
    entry = entry.drop("__target", "in_bid", "in_bid_qty", "in_id").withColumn("hold", F.explode(F.array(*[F.lit(h).cast("long") for h in holds])))
    out = asof_forward(entry.withColumn("__target", F.col("in_t") + F.col("hold") + F.col("delay")), books, "token", "__target", "t", "id", "out_", max_age=wait)
    sane = (F.col("in_segment") == F.col("out_segment")) & (F.col("out_t") < F.col("end")) & (F.col("in_ask_qty") >= quantity) & (F.col("out_bid_qty") >= quantity)
    size = F.lit(quantity)
    fees = fee(F.col("in_ask"), size, rate) + fee(F.col("out_bid"), size, rate)
    return out.select("symbol", "market", "t", "score", *GRID, F.when(sane, F.col("out_t")).alias("until"), (size * (F.col("out_bid") - F.col("in_ask"))).alias("gross"), fees.alias("fees"))


def walk(group: pa.Table) -> pa.Table:
    """The signals of one market of one configuration that no open position shuts out, and which of them are trades."""
    group = group.sort_by([("t", "ascending")])
    t, until = group.column("t").to_numpy(), group.column("until")
    trades, ends = until.is_valid().to_numpy(), until.fill_null(0).to_numpy()
    keep, busy = [], -(1 << 62)
    for i in range(len(t)):
        if t[i] >= busy:
            keep.append(i)
            busy = ends[i] if trades[i] else busy
    return group.take(pa.array(keep, pa.int64()))


def grid_trades(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Priced signals under each threshold that they reach, one position at a time in each symbol's market."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda x: x <= F.abs("score"))
    told = rows.withColumn("threshold", F.explode(reached)).select("symbol", "market", "t", *CONFIG, "until", "gross", "fees")
    return told.groupBy("symbol", "market", *CONFIG).applyInArrow(walk, told.schema)


def grid_results(taken: DataFrame, least: int) -> DataFrame:
    """One row a configuration and symbol with its counts and sums, best first: enough trades, then net, mean and number of trades."""
    by = ["symbol", *CONFIG]
    net, trade = F.col("gross") - F.col("fees"), F.col("until").isNotNull()
    rows = taken.withColumn("net", F.when(trade, net))
    sums = rows.groupBy(*by, "market").agg(
        F.count("*").alias("eligible"), F.count("net").alias("trades"), F.sum(F.when(trade, F.col("gross"))).alias("gross"), F.sum(F.when(trade, F.col("fees"))).alias("fees"), F.sum("net").alias("net"), F.count_if(F.col("net") > 0).alias("wins")
    )
    total = sums.groupBy(*by).agg(F.sum("eligible").alias("eligible"), F.sum("trades").alias("trades"), F.count_if(F.col("trades") > 0).alias("markets"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("gross", "fees", "net")], F.sum("wins").alias("wins"))
    falls = peak_loss(rows.where("net IS NOT NULL"), by, "market", "net")
    share = lambda c: F.when(F.col("trades") > 0, F.col(c) / F.col("trades")).otherwise(0.0)
    out = total.join(falls, by, "left").select(*by, "eligible", "trades", "markets", "gross", "fees", "net", share("net").alias("mean_net"), share("wins").alias("win_rate"), F.coalesce("drawdown", F.lit(0.0)).alias("drawdown"))
    # one row a configuration of a symbol, as many as the grid has
    best = Window.partitionBy("symbol").orderBy((F.col("trades") >= least).desc(), F.round("net", 9).desc(), F.round("mean_net", 9).desc(), F.col("trades").desc(), *CONFIG)
    return out.withColumn("rank", F.row_number().over(best))


def signal_grid_replay(
    lead: DataFrame, second: DataFrame, markets: DataFrame, books: DataFrame, lookbacks: list[int], thresholds: list[float], delays: list[int], holds: list[int], quantity: float, rate: float, step: int, stale: int, wait: int, least: int
) -> DataFrame:
    """The whole grid from prices to ranked configurations; those without a signal inside a market have no row."""
    found = cut(signals(lead, second, lookbacks, step, stale))
    rows = cut(priced(found, markets, books, delays, holds, quantity, rate, wait))
    return grid_results(cut(grid_trades(rows, thresholds)), least)
