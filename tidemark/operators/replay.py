"""Greedy selection of decisions that do not overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nonoverlap_select(df: DataFrame, hold_ms: int) -> DataFrame:
    """Per symbol and UTC day, the first event and then each next one at or after the end of the last chosen.

    The rule starts anew each day, so a group is one day of one symbol.
    """

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by([("t", "ascending"), ("id", "ascending")])
        t = group.column("t").to_numpy()
        picked, at = [], 0
        while at < len(t):
            picked.append(at)
            at = max(at + 1, int(np.searchsorted(t, t[at] + hold_ms, side="left")))
        return group.take(pa.array(picked, pa.int64())).select(["symbol", "id", "t"])

    rows = df.select("symbol", "id", "t", F.floor(F.col("t") / 86_400_000).alias("day"))
    return rows.groupBy("symbol", "day").applyInArrow(choose, "symbol string, id long, t long")


DAY_MS = 86_400_000


def greedy(df: DataFrame, end: str, by: tuple[str, ...] = ("symbol",), daily: bool = True) -> DataFrame:
    """Per key and UTC day, the first row by (t, id), then each next one at or after the end of the last chosen.

    A group is one day of one key, or one key where the rule does not start anew each day; rows keep their columns.
    """
    schema = df.schema

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by([("t", "ascending"), ("id", "ascending")])
        t, ends = group.column("t").to_numpy(), group.column(end).to_numpy()
        picked, at = [], 0
        while at < len(t):
            picked.append(at)
            at = max(at + 1, int(np.searchsorted(t, ends[at], side="left")))
        return group.take(pa.array(picked, pa.int64())).select(schema.names)

    day = F.floor(F.col("t") / DAY_MS) if daily else F.lit(0)
    return df.withColumn("__day", day).groupBy(*by, "__day").applyInArrow(choose, schema)


def same_day(df: DataFrame, end: str) -> DataFrame:
    return df.where(F.floor(F.col("t") / DAY_MS) == F.floor(F.col(end) / DAY_MS))


def action_trace(actions: DataFrame, threshold: float) -> DataFrame:
    """One position at a time among actions whose score on their side reaches the threshold and that end the same day."""
    strong = F.col("score") * F.col("side") >= threshold
    return greedy(same_day(actions, "end").where(strong), "end")


def fixed_ledger(actions: DataFrame, events: str, threshold: float, cost: float) -> DataFrame:
    """The best action of each event that pays plainly and under stress, one at a time until both have ended."""
    paying = actions.where((F.col("net") >= threshold) & (F.col("net") - cost > 0)).withColumn("until", F.greatest("end", "stress_end"))
    rest = F.struct(*[F.col(c) for c in paying.columns if c not in ("symbol", events)])
    best = paying.groupBy("symbol", events).agg(F.max_by(rest, F.struct("net", "id")).alias("__b")).select("symbol", events, "__b.*")
    return greedy(same_day(best, "until"), "until").withColumn("stress_net", F.col("net") - cost)


def paired_stress(chosen: DataFrame, cost: float) -> DataFrame:
    """The chosen actions priced anew under stress, and how many start before the one before has ended under stress.

    Actions end on the day they start on, stressed ones soon after; so neighbours are sought by symbol and day.
    """
    w = Window.partitionBy("symbol", F.floor(F.col("t") / DAY_MS)).orderBy("t", "id")
    rows = chosen.withColumn("overlap", F.coalesce(F.lag("stress_end").over(w) > F.col("t"), F.lit(False)))
    return rows.groupBy("symbol").agg(F.count("*").alias("trades"), F.sum("net").alias("net"), F.sum(F.col("net") - cost).alias("stress_net"), F.count_if("overlap").alias("overlaps"))


def select_threshold(actions: DataFrame, quantiles: list[float], least_trades: int) -> DataFrame:
    """Each score quantile as a threshold, replayed; the best net of those with enough trades is marked, if it gains."""
    score = F.col("score") * F.col("side")
    cuts = actions.agg(F.percentile(score, quantiles).alias("__q")).select(F.posexplode("__q").alias("level", "threshold"))
    rows = same_day(actions, "end").crossJoin(F.broadcast(cuts)).where(score >= F.col("threshold"))
    done = greedy(rows, "end", ("symbol", "level")).groupBy("level", "threshold").agg(F.count("*").alias("trades"), F.sum("net").alias("net"))
    first = F.row_number().over(Window.orderBy((F.col("trades") >= least_trades).desc(), F.desc("net"), "level"))
    return done.withColumn("chosen", (first == 1) & (F.col("trades") >= least_trades) & (F.col("net") > 0))
