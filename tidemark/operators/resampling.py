"""Bootstraps and placebo tests whose draws come from digests: the same on every run, machine and partitioning.

Replicates are rows, so they spread over tasks; each replicate meets one row for each unit drawn (a day, a block).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """A whole number below 2^32 from the digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def positions(days: DataFrame, by: str) -> DataFrame:
    """One row a day: place from 0, count of days, sum of values before it."""
    w = Window.partitionBy(by).orderBy("day")
    return days.select(by, "value", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(by)).alias("n"), F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))


def interval(means: DataFrame, by: str, confidence: float) -> DataFrame:
    """Quantiles of the replicates' means, and how many lie above 0."""
    tail = (1 - confidence) / 2
    return means.groupBy(by).agg(F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"), F.avg((F.col("mean") > 0).cast("double")).alias("positive"), F.count("*").alias("replicates"))


def block_bootstrap(days: DataFrame, by: str, replicates: int, confidence: float = 0.9) -> DataFrame:
    """Mean of moving blocks of about sqrt(n) days, the rest of n in a shorter last block, as differences of sums before."""
    at = positions(days, by)
    sizes = at.groupBy(by).agg(F.first("n").alias("n"), F.sum("value").alias("total")).withColumn("length", F.greatest(F.lit(1), F.least("n", F.bround(F.sqrt("n")))).cast("long"))
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("length")).cast("int") - 1)))
    draws = draws.withColumn("size", F.least("length", F.col("n") - F.col("block") * F.col("length")))
    draws = draws.withColumn("from", digest(F.col(by), F.col("rep"), F.col("block")) % (F.col("n") - F.col("size") + 1)).withColumn("to", F.col("from") + F.col("size"))
    sums = at.select(by, F.col("i").cast("long").alias("i"), "before")
    ends = draws.join(sums.withColumnsRenamed({"i": "from", "before": "low"}), [by, "from"]).join(sums.withColumnsRenamed({"i": "to", "before": "high"}), [by, "to"], "left")
    means = ends.groupBy(by, "rep").agg((F.sum(F.coalesce("high", "total") - F.col("low")) / F.first("n")).alias("mean"))
    return interval(means, by, confidence)


def day_bootstrap(days: DataFrame, by: str, replicates: int, confidence: float = 0.9) -> DataFrame:
    """Mean of n days drawn with replacement."""
    at = positions(days, by).select(by, F.col("i").cast("long").alias("i"), "n", "value")
    drawn = at.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select(by, "rep", (digest(F.col(by), F.col("rep"), F.col("i")) % F.col("n")).alias("i"))
    means = drawn.groupBy(by, "rep", "i").agg(F.count("*").alias("times")).join(at, [by, "i"]).groupBy(by, "rep").agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("mean"))
    return interval(means, by, confidence)


def stationary_bootstrap(days: DataFrame, by: str, replicates: int, mean_block: int, confidence: float = 0.9) -> DataFrame:
    """Blocks of geometric length: each step starts anew with chance 1 / mean_block, else takes the next day round the end."""
    at = positions(days, by).select(by, F.col("i").cast("long").alias("i"), "n", "value")
    steps = at.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select(by, "rep", F.col("i").alias("step"), "n")
    fresh = (F.col("step") == 0) | (digest(F.lit("new"), F.col(by), F.col("rep"), F.col("step")) < int(2**32 / mean_block))
    start = F.when(fresh, F.struct(F.col("step").alias("step"), (digest(F.col(by), F.col("rep"), F.col("step")) % F.col("n")).alias("day")))
    last = F.last(start, ignorenulls=True).over(Window.partitionBy(by, "rep").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    drawn = steps.withColumn("__s", last).select(by, "rep", ((F.col("__s.day") + F.col("step") - F.col("__s.step")) % F.col("n")).alias("i"))
    means = drawn.join(at, [by, "i"]).groupBy(by, "rep").agg(F.avg("value").alias("mean"))
    return interval(means, by, confidence)


def lcg_lower_mean(days: DataFrame, by: str, replicates: int, confidence: float) -> DataFrame:
    """Lower bound of the mean when the k-th draw of a replicate follows a linear congruential generator seeded with it.

    The state after k steps is a^k * seed + c * (a^k - 1) / (a - 1) modulo 2^32, so every draw is found by itself.
    """
    a, c, m = 1664525, 1013904223, 2**32

    @F.pandas_udf("struct<mul: long, add: long>")
    def jump(k: pd.Series) -> pd.DataFrame:
        powers = [pow(a, int(i) + 1, (a - 1) * m) for i in k]
        return pd.DataFrame({"mul": [p % m for p in powers], "add": [c * ((p - 1) // (a - 1)) % m for p in powers]})

    at = positions(days, by).select(by, F.col("i").cast("long").alias("i"), "n", "value")
    jumps = at.select(by, "n", jump("i").alias("__j")).select(by, "n", "__j.*").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = jumps.select(by, "rep", (F.pmod(F.pmod(F.col("mul") * F.col("rep"), F.lit(m)) + F.col("add"), F.lit(m)) % F.col("n")).alias("i"))
    means = drawn.join(at, [by, "i"]).groupBy(by, "rep").agg(F.avg("value").alias("mean"))
    return means.groupBy(by).agg(F.percentile("mean", 1 - confidence).alias("lower"), F.count("*").alias("replicates"))


def placebo_exceedance(df: DataFrame, day: str, signal: str, hit: str, replicates: int) -> DataFrame:
    """How often signals dealt out anew inside each day separate outcomes as well as the real ones.

    The statistic is the days' mean of (signal where the outcome is 1) - (signal where it is 0), rows weighted alike; gaps within
    1e-9 of the real one count as equal to it, since sums run in any order.
    """
    own = F.sort_array(F.collect_list(F.struct("id", F.col(signal).alias("s"), F.col(hit).alias("h"))))
    days = df.where(F.col(day).isNotNull()).groupBy(day).agg(own.alias("__own")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    order = lambda x: F.when(F.col("rep") == 0, "").otherwise(F.md5(F.concat_ws("|", F.col("rep").cast("string"), x["id"].cast("string"))))
    # only a day's rows are shuffled, and once: its replicates are made and summed one after the other where the day is
    mixed = F.sort_array(F.transform("__own", lambda x: F.struct(order(x).alias("o"), x["id"].alias("id"), x["s"].alias("s"))))
    dealt = days.select("rep", F.inline(F.zip_with(mixed, "__own", lambda x, y: F.struct(x["s"].alias("__s"), y["h"].alias("__h")))))
    gap = dealt.groupBy("rep").agg((F.avg(F.when(F.col("__h") == 1, F.col("__s"))) - F.avg(F.when(F.col("__h") == 0, F.col("__s")))).alias("gap"))
    real = gap.where("rep = 0").select(F.col("gap").alias("observed"))
    return gap.where("rep > 0").crossJoin(F.broadcast(real)).agg(F.first("observed").alias("observed"), ((F.count_if(F.col("gap") >= F.col("observed") - 1e-9) + 1) / (F.count("*") + 1)).alias("p"))


def overfit_probability(scores: DataFrame, folds: int) -> DataFrame:
    """Share of the half splits of folds whose winner inside ranks below the middle outside (rows: trial, fold, score).

    The splits are the subsets of half the folds, so few; the table of trials by splits is all that is grouped.
    """
    split = F.explode(F.filter(F.sequence(F.lit(0), F.lit(2**folds - 1)), lambda m: F.bit_count(m) == folds // 2))
    rows = scores.withColumn("split", split)
    inside = F.expr("(shiftright(split, cast(fold as int)) & 1) = 1")
    trials = rows.groupBy("split", "trial").agg(F.avg(F.when(inside, F.col("score"))).alias("inner"), F.avg(F.when(~inside, F.col("score"))).alias("outer"))
    w = Window.partitionBy("split")
    ties = F.count("*").over(Window.partitionBy("split", "outer"))
    placed = trials.select("split", F.row_number().over(w.orderBy(F.desc("inner"), F.desc("trial"))).alias("best"), ((F.rank().over(w.orderBy("outer")) - 1 + (ties - 1) / 2 + 1) / (F.count("*").over(w) + 1)).alias("place"))
    return placed.where("best = 1").agg(F.count("*").alias("splits"), F.avg((F.col("place") < 0.5).cast("double")).alias("probability"), F.avg("place").alias("mean_place"))


def binomial(sizes: DataFrame, by: str, n: str, chance: float) -> DataFrame:
    """Probabilities of k successes for each group's n, for the k within 40 deviations of the mean (others weigh nothing).

    Logs are summed from one k to the next and scaled to 1 over the group, so nothing under- or overflows.
    """
    reach = F.sqrt(F.col(n) * chance * (1 - chance)) * 40 + 1
    ks = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col(n) * chance - reach)), F.least(F.col(n).cast("long"), F.ceil(F.col(n) * chance + reach)))
    rows = sizes.withColumn("k", F.explode(ks))
    w = Window.partitionBy(by)
    step = F.when(F.col("k") == F.min("k").over(w), 0.0).otherwise(F.log((F.col(n) - F.col("k") + 1) / F.col("k")) + F.log(F.lit(chance / (1 - chance))))
    logs = rows.withColumn("__step", step).withColumn("__log", F.sum("__step").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    raw = logs.withColumn("__raw", F.exp(F.col("__log") - F.max("__log").over(w)))
    return raw.withColumn("chance", F.col("__raw") / F.sum("__raw").over(w)).drop("__step", "__log", "__raw")


def upper_quantile(df: DataFrame, by: str, value: str, quantile: float, confidence: float) -> DataFrame:
    """The order statistic that bounds a tail quantile with confidence; groups too small for it are left out."""
    cells = df.groupBy(by, value).agg(F.count("*").alias("__c")).withColumn("__upto", F.sum("__c").over(Window.partitionBy(by).orderBy(value)))
    sizes = cells.groupBy(by).agg(F.sum("__c").alias("__n"))
    upto = binomial(sizes, by, "__n", quantile).withColumn("__p", F.sum("chance").over(Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    rank = upto.where((F.col("__p") >= confidence) & (F.col("k") < F.col("__n"))).groupBy(by).agg((F.min("k") + 1).alias("rank"))
    return cells.join(rank, by).where(F.col("__upto") >= F.col("rank")).groupBy(by).agg(F.first("rank").alias("rank"), F.min(value).alias("bound"))


def edge_report(days: DataFrame, by: str, least_days: int, most_p: float) -> DataFrame:
    """Mean, median and share of winning days, a sign test, the return over downside deviation and the checks that fail."""
    downside = F.sqrt(F.avg(F.least("value", F.lit(0.0)) ** 2))
    s = days.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("wins"), F.sum("value").alias("net"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), downside.alias("__d"))
    s = s.withColumn("downside_ratio", F.when(F.col("__d") > 0, F.col("mean") / F.col("__d")).otherwise(F.when(F.col("mean") > 0, 999.0).otherwise(0.0))).drop("__d")
    tails = binomial(s.select(by, "n", "wins"), by, "n", 0.5).where("k >= wins").groupBy(by).agg(F.least(F.lit(1.0), F.sum("chance")).alias("sign_p"))
    out = s.join(tails, by, "left").withColumn("sign_p", F.coalesce("sign_p", F.lit(0.0)))
    failed = F.concat_ws(",", F.when(F.col("net") <= 0, "net"), F.when(F.col("n") < least_days, "few_days"), F.when(F.col("sign_p") > most_p, "sign_test"), F.when(F.col("downside_ratio") < 0.05, "downside"))
    return out.withColumn("failed", failed).withColumn("accepted", F.col("failed") == "")
