"""Two outcomes of one market quoted apart: paired states, episodes in which both cost less than they pay, survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof

#: What counts as extreme and as a strong favourite, and when late: fixed values.
EXTREMES = ((0.01, 0.05), (0.95, 0.99))
FAVOURITE = (0.95, 0.99)
LATE_MS = (5_000, 60_000)
_SIDE = ("id", "ask", "buy", "sell", "wall")


def _one_of(low: float, high: float) -> Column:
    return F.coalesce(F.col("up_ask").between(low, high), F.lit(False)) | F.coalesce(F.col("down_ask").between(low, high), F.lit(False))


def paired_quotes(quotes: DataFrame, segments: DataFrame, skew: int) -> DataFrame:
    """The state of both outcomes at each time that one of them is quoted, where they were received within ``skew``.

    ``quotes``: (key, outcome 'up' or 'down', t, wall, id, ask, buy, sell): receipt by a steady clock and by the wall, best
    ask, cost of buying and value of selling one share after fees, null where the book is too thin. ``segments``: (key,
    seg_start, seg_end, market_end, delay). Of quotes of one outcome at one time the last by id counts; states outside of their
    segment's walls are left out.
    """
    known = quotes.where("key is not null and t is not null")
    own = F.struct(F.col("t").alias("at"), *_SIDE)
    lanes = known.groupBy("key", "t").agg(*[F.max_by(F.when(F.col("outcome") == side, own), F.when(F.col("outcome") == side, F.col("id"))).alias(side) for side in ("up", "down")])
    states = asof.last_known(lanes, "key", "t", ["up", "down"])
    flat = states.select("key", "t", *[F.col(side)[c].alias(f"{side}_{c}") for side in ("up", "down") for c in ("at", *_SIDE)])
    met = flat.where(F.abs(F.col("up_at") - F.col("down_at")) <= skew).withColumn("wall", F.greatest("up_wall", "down_wall"))
    inside = met.join(segments, "key").where("wall >= seg_start and wall <= seg_end")
    return inside.select(
        "key", "t", "wall", "seg_end", "market_end", "delay", "up_ask", "down_ask", "up_buy", "down_buy",
        (F.col("up_buy") + F.col("down_buy")).alias("set_cost"), (F.col("up_sell") + F.col("down_sell")).alias("split_value"),
    )


def candidate_counts(states: DataFrame, market: Column) -> DataFrame:
    """How many states, and of how many markets, show each kind of opportunity."""
    left = F.col("market_end") - F.col("wall")
    extreme = _one_of(*EXTREMES[0]) | _one_of(*EXTREMES[1])
    kinds = {
        "extreme_settlement_value": extreme,
        "late_strong_favourite": left.between(*LATE_MS) & _one_of(*FAVOURITE),
        "complete_set_after_fee": F.col("set_cost") < 1,
        "split_sell_after_fee": F.col("split_value") > 1,
    }
    shown = F.array_compact(F.array(*[F.when(c, name) for name, c in kinds.items()]))
    seen = states.select(market.alias("market"), F.explode(shown).alias("kind")).groupBy("kind", "market").agg(F.count("*").alias("n"))
    counts = seen.groupBy("kind").agg(F.sum("n").alias("states"), F.count("*").alias("markets"))
    every = states.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(counts, "kind", "left").fillna(0)


def episode_survivors(states: DataFrame, segments: DataFrame) -> DataFrame:
    """For each segment the episodes of a set that costs under 1, and how many still do after one delay and when the two
    sides are bought one delay after the other, with the best cost of each."""
    cheap = states.withColumn("active", F.coalesce(F.col("set_cost") < 1, F.lit(False)))
    rising = asof.neighbour(cheap, "key", "t", "t", ["active"], "p_").where(F.col("active") & ~F.coalesce("p_active", F.lit(False)))
    held = states.select("key", F.col("t").alias("at"), "up_buy", "down_buy", "set_cost")
    starts = rising.select("key", "t", "wall", "seg_end", "market_end", "delay", "set_cost")
    for name, times in (("one", 1), ("two", 2)):
        late = starts.withColumn("__then", F.col("t") + times * F.col("delay"))
        starts = asof.asof_join(late, held, "key", "__then", "at", "at", f"{name}_").drop("__then")
        wall = F.col("wall") + times * F.col("delay")
        live = (wall <= F.col("seg_end")) & (wall < F.col("market_end"))
        starts = starts.withColumns({f"{name}_{c}": F.when(live, F.col(f"{name}_{c}")) for c in ("up_buy", "down_buy", "set_cost")})
    one_by_one = F.least(F.col("one_up_buy") + F.col("two_down_buy"), F.col("one_down_buy") + F.col("two_up_buy"))
    told = starts.withColumn("sequential", one_by_one).groupBy("key").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("one_set_cost") < 1).alias("delay_survivors"), F.count_if(F.col("sequential") < 1).alias("sequential_survivors"),
        F.min("set_cost").alias("best_cost"), F.min("one_set_cost").alias("best_delay_cost"), F.min("sequential").alias("best_sequential_cost"),
    )
    return segments.select("key").join(told, "key", "left").fillna(0, ["episodes", "delay_survivors", "sequential_survivors"])
