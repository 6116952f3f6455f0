"""Trade bars on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_trade_bars(trades: DataFrame, step: str = "1 second", delay: str = "250 milliseconds") -> DataFrame:
    """One row for each symbol and window, once the watermark has passed it. Reads id, first_id, last_id, symbol, t (ms), price, qty."""
    timed = trades.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", delay)
    order = F.struct("t", "id")
    bars = timed.groupBy("symbol", F.window("ts", step).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"), F.sum(F.col("last_id") - F.col("first_id") + 1).alias("trade_count")
    )
    return bars.select("symbol", F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "trade_count")
