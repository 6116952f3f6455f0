"""Duplicates, sliding windows, sessions and idempotent appends on streams of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.ingest import append_observations


def timed(rows: DataFrame, delay: str, t: str = "t") -> DataFrame:
    return rows.withColumn("ts", F.timestamp_millis(t)).withWatermark("ts", delay)


def drop_repeats(rows: DataFrame, keys: list[str], delay: str = "10 seconds") -> DataFrame:
    """The first of rows with equal keys; state goes once the watermark has passed."""
    return timed(rows, delay).dropDuplicatesWithinWatermark(keys).drop("ts")


def conflicts(rows: DataFrame, keys: list[str], values: list[str], width: str = "1 minute", delay: str = "10 seconds") -> DataFrame:
    """Keys that came with different values inside a window, once the watermark has passed it."""
    mark = F.xxhash64(*values)
    seen = timed(rows, delay).groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.min(mark).alias("__a"), F.max(mark).alias("__b"))
    return seen.where("__a <> __b").select(*keys, F.unix_millis("w.start").alias("start"), "n")


def sliding_flow(trades: DataFrame, width: str, slide: str, delay: str = "10 seconds") -> DataFrame:
    """Quantity, notional and trades of each symbol over sliding windows."""
    w = timed(trades, delay).groupBy("symbol", F.window("ts", width, slide).alias("w"))
    return w.agg(F.sum("qty").alias("qty"), F.sum(F.col("price") * F.col("qty")).alias("notional"), F.count("*").alias("n")).select("symbol", F.unix_millis("w.end").alias("at"), "qty", "notional", "n")


def sessions(rows: DataFrame, gap: str, delay: str = "10 seconds") -> DataFrame:
    """Stretches of each symbol without a silence longer than the gap."""
    return timed(rows, delay).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).drop("w")


def observations_sink(spark: SparkSession, path: str):
    """A foreachBatch function that appends what the table at ``path`` lacks; a batch run twice adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        columns = ["id", "observed_at", "kind", "source", "score", "payload"]
        try:
            seen = spark.read.schema(batch.select(columns).schema).parquet(path)
            seen.limit(0).count()
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            seen = batch.select(columns).limit(0)
        append_observations(seen, batch.select(columns)).select(columns).write.mode("append").parquet(path)

    return write
