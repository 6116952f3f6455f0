"""Lenient readers, upserts and idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KLINE = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "buy_base", "buy_quote"]


def normalize_epoch(t: Column) -> Column:
    """Milliseconds from milliseconds or microseconds; null where the number is too large to be either."""
    size = F.abs(t)
    return F.when(size >= F.lit(10**17), None).when(size >= F.lit(10**13), F.floor(t / 1000)).otherwise(t).cast("long")


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Candles from CSV; rows with under 7 columns or a bad number go, missing optional columns are 0."""
    raw = spark.read.csv(path, schema=", ".join(f"{c} string" for c in KLINE), mode="PERMISSIVE")
    need = [F.expr(f"try_cast({c} AS double)").alias(c) for c in KLINE[1:6]]
    times = [normalize_epoch(F.expr(f"try_cast({c} AS bigint)")).alias(c) for c in ("open_time", "close_time")]
    more = [F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0)).alias(c) for c in KLINE[7:]]
    return raw.select(*times, *need, *more).dropna(subset=[*KLINE[:7]])


def read_agg_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades from CSV; rows with a bad number, a negative id, no price or quantity, or a falling id range go."""
    raw = spark.read.csv(path, schema="id string, price string, qty string, first_id string, last_id string, t string, maker string, best string", mode="PERMISSIVE")
    longs = [F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("id", "first_id", "last_id")]
    rows = raw.select(*longs, *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("price", "qty")], normalize_epoch(F.expr("try_cast(t AS bigint)")).alias("t"), F.lower("maker").eqNullSafe("true").alias("buyer_is_maker"))
    return rows.dropna().where("id >= 0 AND price > 0 AND qty > 0 AND last_id >= first_id")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key; of one side's rows, the one latest by ``order``; incoming before existing."""
    both = existing.withColumn("__rank", F.lit(0)).unionByName(incoming.withColumn("__rank", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__rank"), F.desc(order))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__rank")


def append_observations(existing: DataFrame, incoming: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Incoming rows that are new by (kind, source, time, payload hash), each once.

    Of a payload over ``most_bytes`` a preview of so many characters stays, beside the hash of the whole.
    """
    keys = ["kind", "source", "observed_at", "payload_hash"]
    hashed = incoming.withColumn("payload_hash", F.sha2("payload", 256)).dropDuplicates(keys)
    new = hashed.join(existing.withColumn("payload_hash", F.sha2("payload", 256)).select(keys), keys, "left_anti")
    if most_bytes is None:
        return new
    large = F.coalesce(F.octet_length("payload") > most_bytes, F.lit(False))
    return new.withColumns({"truncated": large, "payload": F.when(large, F.substring("payload", 1, most_bytes)).otherwise(F.col("payload"))})
