"""Strict archive readers with audits, datasets under a content key, and ordered CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.sources.ingest import normalize_epoch

#: Columns of an archive of aggregated trades; spot archives have one more than futures ones.
TRADE = ["id", "price", "qty", "first_id", "last_id", "t", "buyer_is_maker"]
PREMIUM = ["open_time", "open", "high", "low", "close", "unused", "close_time"]


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(cells, file, line): the trimmed cells of each line, without empty ones at its end and without header lines.

    ``line`` rises with a line's place in its file.
    """
    lines = spark.read.text(path).select(F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"[\s,]+$", "").alias("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return lines.where("value <> ''").select(cells.alias("cells"), "file", "line").where(F.col("cells")[0].rlike("^[-+]?[0-9]"))


def trade_rows(spark: SparkSession, path: str, market: str) -> DataFrame:
    """Every data line of trade archives as typed columns, with ``problem``: the first rule that it breaks, or null."""
    n = 8 if market == "spot" else 7
    raw = _lines(spark, path)
    cell = [F.get("cells", F.lit(i)) for i in range(n)]
    typed = raw.select(
        "file", "line", F.size("cells").alias("columns"),
        *[cell[i].try_cast("bigint").alias(TRADE[i]) for i in (0, 3, 4)], *[cell[i].try_cast("double").alias(TRADE[i]) for i in (1, 2)],
        normalize_epoch(cell[5].try_cast("bigint")).alias("t"), F.lower(cell[6]).alias("maker"), (F.lower(cell[7]) if market == "spot" else F.lit("true")).alias("best"),
    )
    flags = F.col("maker").isin("true", "false", "1", "0") & F.col("best").isin("true", "false", "1", "0")
    numbers = F.col("id").isNotNull() & F.col("first_id").isNotNull() & F.col("last_id").isNotNull() & F.col("t").isNotNull() & _finite("price") & _finite("qty")
    bounds = (F.col("id") >= 0) & (F.col("first_id") >= 0) & (F.col("last_id") >= F.col("first_id")) & (F.col("price") > 0) & (F.col("qty") > 0) & (F.col("t") > 0)
    problem = F.when(F.col("columns") != n, "column count").when(~F.coalesce(numbers, F.lit(False)), "bad number").when(~F.coalesce(flags, F.lit(False)), "bad flag").when(~bounds, "value bounds")
    return typed.select(*TRADE[:6], F.col("maker").isin("true", "1").alias("buyer_is_maker"), "file", "line", problem.alias("problem"))


def audit_trades(rows: DataFrame, day_ms: int | None = None) -> DataFrame:
    """One row for each file: data rows, those that break a rule, times outside the day, ids and times that fall, gaps of ids.

    Each line is held against the one before it; they are met by stretches of lines, so that a file makes many tasks.
    """
    near = asof.neighbour(rows.where("problem is null"), "file", "line", "line", ["id", "t", "last_id"], "p_", bucket_ms=1 << 20)
    outside = F.lit(False) if day_ms is None else (F.col("t") < day_ms) | (F.col("t") >= day_ms + 86_400_000)
    good = near.groupBy("file").agg(
        F.count("*").alias("accepted"), F.count_if(outside).alias("outside_day"), F.count_if(F.col("id") == F.col("p_id")).alias("repeated_ids"), F.count_if(F.col("id") < F.col("p_id")).alias("id_regressions"), F.count_if(F.col("t") < F.col("p_t")).alias("time_regressions"),
        F.coalesce(F.sum(F.greatest(F.col("first_id") - F.col("p_last_id") - 1, F.lit(0))), F.lit(0)).alias("missing_ids"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )
    every = rows.groupBy("file").agg(F.count("*").alias("rows"), F.count("problem").alias("rejected"))
    return every.join(good, "file", "left").fillna(0, ["accepted", "outside_day", "repeated_ids", "id_regressions", "time_regressions", "missing_ids"])


def read_agg_trades_strict(spark: SparkSession, path: str, market: str = "spot", day_ms: int | None = None) -> DataFrame:
    """Trades of archives that keep every rule; the first line that breaks one, or lies outside the day, is an error."""
    rows = trade_rows(spark, path, market)
    late = F.lit(False) if day_ms is None else (F.col("t") < day_ms) | (F.col("t") >= day_ms + 86_400_000)
    fault = F.when(F.col("problem").isNotNull(), F.col("problem")).when(late, F.lit("outside the day"))
    return rows.where(F.when(fault.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("trade archive: "), fault)).cast("boolean"))).select(*TRADE)


def read_premium_index(spark: SparkSession, path: str, positive: bool = False) -> DataFrame:
    """Reference-price candles with ``problem``: the first rule broken, or null. ``positive`` is for mark prices.

    Times must rise strictly from line to line.
    """
    raw = _lines(spark, path)
    values = [F.get("cells", F.lit(i)).try_cast("double").alias(PREMIUM[i]) for i in range(1, 5)]
    times = [normalize_epoch(F.get("cells", F.lit(i)).try_cast("bigint")).alias(PREMIUM[i]) for i in (0, 6)]
    rows = raw.select("file", "line", F.size("cells").alias("columns"), *times, *values)
    near = asof.neighbour(rows, "file", "line", "line", ["open_time"], "p_", bucket_ms=1 << 20)
    finite = F.col("open_time").isNotNull() & F.col("close_time").isNotNull() & _finite("open") & _finite("high") & _finite("low") & _finite("close")
    sane = (F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "high", "close"))
    above = F.least("open", "high", "low", "close") > 0
    problem = F.when(F.col("columns") < 7, "column count").when(~F.coalesce(finite, F.lit(False)), "bad number").when(~above if positive else F.lit(False), "not positive").when(~sane, "price bounds").when(F.col("open_time") <= F.col("p_open_time"), "time does not rise")
    return near.select("open_time", "open", "high", "low", "close", "close_time", "file", problem.alias("problem"))


def save_dataset(df: DataFrame, root: str, key: str) -> str:
    """Write a table under its key; the manifest is written last, so that a table counts as there only when it is whole."""
    folder = f"{root}/{key}"
    df.write.mode("overwrite").parquet(f"{folder}/rows")
    held = df.sparkSession.read.parquet(f"{folder}/rows")
    mark = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).cast("string")
    held.agg(F.lit(key).alias("key"), F.count("*").alias("rows"), F.coalesce(mark, F.lit("0")).alias("digest")).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return folder


def load_dataset(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The table of a key, or None where it was never written whole; an error where its rows differ from the manifest."""
    folder = f"{root}/{key}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    said = spark.read.json(f"{folder}/manifest", schema="key string, rows long, digest string").first()
    rows = spark.read.parquet(f"{folder}/rows")
    mark = F.coalesce(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")).cast("string"), F.lit("0"))
    n, digest = rows.agg(F.count("*"), mark).first()
    if said is None or (said["key"], said["rows"], said["digest"]) != (key, n, digest):
        raise ValueError(f"the dataset {key} differs from its manifest")
    return rows


def slice_dataset(df: DataFrame, t: str, start: int, end: int) -> DataFrame:
    """The rows of a dataset in [start, end); on a partition column this prunes files."""
    return df.where((F.col(t) >= start) & (F.col(t) < end))


def write_observations_csv(df: DataFrame, path: str, order: list[str]) -> str:
    """CSV files in one order over all of them, and a digest of their lines that depends on the order.

    Rows are dealt out by ranges of the order; a file's digest is that of its lines, the whole one that of the files'.
    """
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").csv(path, header=False)
    marks = dealt.select(F.spark_partition_id().alias("part"), F.sha2(line, 256).alias("mark"), F.monotonically_increasing_id().alias("at"))
    step = Window.partitionBy("part").orderBy("at")
    chained = marks.withColumn("n", F.row_number().over(step)).groupBy("part").agg(F.sum(F.xxhash64("mark", "n").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("rows"))
    parts = chained.orderBy("part").collect()  # one row for each file
    return "|".join(f"{r['rows']}:{r['sum']}" for r in parts)
