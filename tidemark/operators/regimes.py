"""Market regimes of windows of bars, their summary, and clusters of symbols that move together."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """Have a checkpoint folder: the one spark.checkpoint.dir names; a temporary one only where Spark runs in this process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-shared-"))


def cut(df: DataFrame) -> DataFrame:
    """A narrow table that several aggregates read, computed once, by a reliable checkpoint."""
    ready(df.sparkSession)
    return df.checkpoint()


def classify_regime(bars: DataFrame, span: int) -> DataFrame:
    """A regime and its confidence for each (symbol, window of ``span`` ms), from the returns inside the window.

    Windows with fewer than three valid closes have insufficient data.
    """
    rows = bars.where("close > 0").withColumn("window", F.floor(F.col("open_time") / span) * span)
    w = Window.partitionBy("symbol", "window").orderBy("open_time")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("sign", F.when(F.col("r") != 0, F.signum("r")))
    rows = rows.withColumns({"past": F.lag("r").over(w), "turn": F.col("sign") != F.last("sign", ignorenulls=True).over(before), "later": F.row_number().over(Window.partitionBy("symbol", "window").orderBy(F.desc("open_time")))})
    pair = F.col("past").isNotNull() & F.col("r").isNotNull()
    x, y = F.when(pair, F.col("past")), F.when(pair, F.col("r"))
    mean, spread = F.avg(F.when(F.col("later") > 1, F.col("volume"))), F.stddev_samp(F.when(F.col("later") > 1, F.col("volume")))
    g = rows.groupBy("symbol", "window").agg(
        F.count("*").alias("n"), F.count("r").alias("k"), (F.max_by("close", "open_time") / F.min_by("close", "open_time") - 1).alias("trend_return"),
        F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("volatility"), F.avg(F.abs("r")).alias("mean_abs"), F.count("sign").alias("signs"),
        F.greatest(F.count_if(F.col("sign") > 0), F.count_if(F.col("sign") < 0)).alias("most"), F.count_if("turn").alias("turns"),
        F.when(F.sqrt(F.var_pop(x) * F.var_pop(y)) * F.count(x) > 1e-12, F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y))).otherwise(0.0).alias("auto"), F.count(x).alias("pairs"),
        F.when(F.count("*") >= 3, F.when(spread > 1e-12, (F.max_by("volume", "open_time") - mean) / spread).otherwise(0.0)).alias("volume_z"),
    )
    c = F.col
    enough = c("n") >= 3
    g = g.withColumns({k: F.when(enough, c(k)).otherwise(0.0) for k in ("trend_return", "volatility", "mean_abs")})
    g = g.withColumns({"consistency": F.when(enough & (c("signs") > 0), c("most") / c("signs")).otherwise(0.0), "reversals": F.when(enough & (c("signs") > 0), c("turns") / F.greatest(F.lit(1), c("signs") - 1)).otherwise(0.0), "auto": F.when(c("pairs") >= 2, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("auto")))).otherwise(0.0)})
    g = g.withColumns({"strength": F.abs("trend_return") / F.greatest(F.lit(1e-9), c("mean_abs") * F.sqrt("k"), c("volatility") * F.sqrt("k")), "floor": F.greatest(F.lit(0.0005), c("mean_abs") * 1.8)})
    chop = (c("volatility") >= c("floor")) & (c("reversals") >= 0.55)
    trend = (c("strength") >= 1.15) & (c("consistency") >= 0.55)
    flat = (c("reversals") >= 0.5) & (c("strength") < 0.85)
    serial = F.abs("auto") >= 0.35
    regime = F.when(~enough, "insufficient_data").when(chop, "volatile_chop").when(trend, F.when(c("trend_return") > 0, "trend_up").otherwise("trend_down")).when(flat, "range_bound").when(serial, "serial_correlation").otherwise("mixed")
    one = F.lit(1.0)
    sure = (
        F.when(~enough, 0.0)
        .when(chop, F.least(one, 0.45 + 0.35 * c("reversals") + 0.1 * F.least(F.lit(2.0), c("volatility") / c("floor"))))
        .when(trend, F.least(one, 0.4 + 0.175 * F.least(F.lit(2.0), c("strength")) + 0.25 * c("consistency")))
        .when(flat, F.least(one, 0.45 + 0.35 * c("reversals") + 0.2 * (1 - F.least(one, c("strength")))))
        .when(serial, F.least(one, 0.5 + 0.5 * F.abs("auto")))
        .otherwise(F.greatest(F.lit(0.2), F.least(F.lit(0.7), 0.35 + 0.2 * c("consistency") + 0.15 * F.least(one, c("strength")))))
    )
    return g.select("symbol", "window", "n", "trend_return", "volatility", "consistency", "reversals", "auto", "volume_z", regime.alias("regime"), sure.alias("confidence"))


def regime_summary(windows: DataFrame, pnl: str) -> DataFrame:
    """Windows, accepted share and results of each regime, its share of all windows, and whether it crowds out the rest."""
    g = windows.groupBy("regime").agg(F.count("*").alias("windows"), F.count_if(F.col(pnl) > 0).alias("accepted"), F.sum(pnl).alias("pnl"), F.min(pnl).alias("worst"), F.avg("confidence").alias("mean_confidence"))
    share = F.col("windows") / F.sum("windows").over(Window.partitionBy())
    return g.withColumns({"accepted_rate": F.col("accepted") / F.col("windows"), "share": share, "crowded": (share >= 0.75) & (F.sum("windows").over(Window.partitionBy()) >= 3)})


def correlation_clusters(pairs: DataFrame, symbols: DataFrame, threshold: float, max_rounds: int = 40) -> DataFrame:
    """Each symbol with the smallest one it reaches by pairs at or above the threshold.

    Labels pass over links until none changes; a round is one join of links with labels. Symbols are the rows here. Rounds
    double the reach of a label, so that many more than ``max_rounds`` would be needed only by an error; then it raises.
    """
    strong = pairs.where(F.col("corr") >= threshold).select("symbol", "other")
    ready(symbols.sparkSession)
    links = strong.unionByName(strong.select(F.col("other").alias("symbol"), F.col("symbol").alias("other"))).checkpoint()
    labels = symbols.select("symbol", F.col("symbol").alias("cluster")).checkpoint()
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("symbol", "other"), "other").groupBy("symbol").agg(F.min("cluster").alias("__near"))
        # a label also takes over the label of its label, so that chains halve in each round
        head = labels.select(F.col("symbol").alias("__near"), F.col("cluster").alias("__head"))
        near = near.join(head, "__near").select("symbol", F.least("__near", "__head").alias("__near"))
        new = labels.join(near, "symbol", "left").select("symbol", F.least("cluster", F.coalesce("__near", "cluster")).alias("cluster"), (F.col("__near") < F.col("cluster")).alias("__moved")).checkpoint()
        labels = new.drop("__moved")
        if new.where("__moved").isEmpty():
            return labels
    raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")


def rank_candidates(rows: DataFrame, least_trades: int, least_factor: float) -> DataFrame:
    """Candidates in order of score, those that a gate rejects last, with the reasons."""
    reasons = F.concat_ws(",", F.when(F.col("trades") < least_trades, "few_trades"), F.when(F.coalesce("profit_factor", F.lit(999.0)) < least_factor, "profit_factor"), F.when(F.col("net") <= 0, "net"))
    scored = rows.withColumns({"reasons": reasons, "score": F.col("positive_rate") * F.least(F.coalesce("profit_factor", F.lit(999.0)), F.lit(3.0))})
    place = F.row_number().over(Window.orderBy(F.col("reasons") != "", F.desc("score"), "symbol"))
    return scored.select("symbol", "trades", "score", "reasons", place.alias("place"))
