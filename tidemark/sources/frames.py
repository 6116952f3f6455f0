"""Feed frames, content stores, retention, manifests and merges of verified archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frame key -> column; keys differ by case only, so they are read by name and not by a schema.
FRAME = {"e": "__e", "E": "__time", "s": "__s", "p": "__p", "q": "__q", "b": "__bid", "a": "__ask", "i": "__index", "r": "__rate", "o": "__order"}
#: Event name of a frame -> kind.
EVENTS = {"trade": "trade", "aggTrade": "trade", "bookTicker": "quote", "markPriceUpdate": "mark", "forceOrder": "liquidation"}


def decode_frames(frames: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Raw JSON frames as typed trades, best quotes, mark prices and liquidations; any other keeps its text and the reason."""
    rows = frames.select(*frames.columns, F.json_tuple(raw, *FRAME).alias(*FRAME.values()))
    p, q, bid, ask, index, rate = (F.expr(f"try_cast({c} AS double)") for c in ("__p", "__q", "__bid", "__ask", "__index", "__rate"))
    forced = {k: F.get_json_object("__order", f"$.{k}") for k in ("s", "S", "q", "p")}
    fp, fq = forced["p"].try_cast("double"), forced["q"].try_cast("double")
    kind = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])[F.col("__e")]
    sane = {"trade": (p > 0) & (q > 0), "quote": (bid > 0) & (ask >= bid), "mark": (p > 0) & (index > 0) & rate.isNotNull(), "liquidation": (fp > 0) & (fq > 0) & forced["S"].isin("BUY", "SELL")}
    good = F.coalesce(*[F.when(kind == k, F.coalesce(ok, F.lit(False))) for k, ok in sane.items()], F.lit(False))
    liquidation = kind == "liquidation"
    reason = F.when(good, None).when(kind.isNotNull(), "bad values").otherwise("unknown frame")
    typed = [
        F.when(good, kind).alias("kind"), F.coalesce(forced["s"], F.col("__s")).alias("symbol"), F.expr("try_cast(__time AS bigint)").alias("event_ms"), F.when(liquidation, fp).otherwise(p).alias("price"), F.when(liquidation, fq).otherwise(q).alias("qty"),
        bid.alias("bid"), ask.alias("ask"), index.alias("index_price"), rate.alias("funding_rate"), forced["S"].alias("side"), reason.alias("reason"),
    ]
    return rows.select(*frames.columns, *typed)


def content_store(df: DataFrame, payload: str) -> DataFrame:
    """Each different payload once, under its digest, with how often it came."""
    return df.where(F.col(payload).isNotNull()).groupBy(F.sha2(payload, 256).alias("payload_hash")).agg(F.any_value(payload).alias("payload"), F.count("*").alias("uses"))


def prune_retention(df: DataFrame, t: str, order: str, before: int, keep_latest: int | None = None) -> DataFrame:
    """Rows from ``before`` on and, if asked, of those only the newest (a top-k feature)."""
    kept = df.where(F.col(t) >= before)
    return kept if keep_latest is None else kept.orderBy(F.desc(t), F.desc(order)).limit(keep_latest)


def prune_periods(files: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Rows of the archives whose period (yyyy-MM or yyyy-MM-dd) overlaps [start, end]; as a partition column it prunes files."""
    monthly = F.length("period") == 7
    first = F.to_date(F.when(monthly, F.concat("period", F.lit("-01"))).otherwise(F.col("period")))
    after = F.when(monthly, F.add_months(first, 1)).otherwise(F.date_add(first, 1))
    return files.where((F.unix_millis(first.cast("timestamp")) <= end_ms) & (F.unix_millis(after.cast("timestamp")) > start_ms))


def ingest_manifest(rows: DataFrame, archive: str, t: str) -> DataFrame:
    """Rows, time span and a digest of each archive's rows that does not depend on their order, but on repeats."""
    mark = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c != archive]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(archive).agg(F.count("*").alias("rows_read"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"), F.sum(mark).cast("string").alias("digest"))


def checked_manifest(manifest: DataFrame, stated: DataFrame, archive: str) -> DataFrame:
    """The manifest with each archive's checksum status: verified, mismatch, or missing where none is stated."""
    said = stated.select(archive, F.col("digest").alias("__said"))
    status = F.when(F.col("__said").isNull(), "missing").when(F.col("__said") == F.col("digest"), "verified").otherwise("mismatch")
    return manifest.join(said, archive, "left").withColumn("checksum_status", status).drop("__said")


def merge_verified(target: DataFrame, source: DataFrame, manifest: DataFrame, archive: str, key: str | None = None) -> DataFrame:
    """The target with the source's verified archives that it lacks.

    With ``key``, a new row whose key the target holds already is an error: the job fails when it meets one.
    """
    verified = manifest.where(F.col("status") == "verified").select(archive)
    new = source.join(verified, archive, "left_semi").join(target.select(archive).distinct(), archive, "left_anti")
    if key is not None:
        held = target.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__held", F.lit(True))
        clash = F.raise_error(F.concat(F.lit(f"{key} of two archives: "), F.col(key).cast("string"))).cast("boolean")
        new = new.join(held, key, "left").where(F.when(F.col("__held"), clash).otherwise(F.lit(True))).select(*source.columns)
    return target.unionByName(new)


def merge_manifest(target: DataFrame, manifest: DataFrame, archive: str) -> DataFrame:
    """The target's manifest with the rows of the verified archives that it lacks, as they are."""
    new = manifest.where(F.col("status") == "verified").join(target.select(archive).distinct(), archive, "left_anti")
    return target.unionByName(new.select(*target.columns))


def funding_checks(events: DataFrame, least_ms: int, most_ms: int) -> DataFrame:
    """Events with the interval since the one before, and whether time rose by an allowed step."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("symbol").orderBy("t", "id"))
    return events.withColumn("interval", step).withColumn("valid", F.coalesce(step.between(least_ms, most_ms), F.lit(True)))


def top_of_book(quotes: DataFrame, now_ms: int, stale_ms: int, full_depth: float, widest_bps: float) -> DataFrame:
    """Newest quote of each symbol with spread, depth, a score in [0, 1] of 0.35 tightness and 0.65 depth, and staleness.

    A spread of ``widest_bps`` or more has no tightness; depth counts up to ``full_depth``.
    """
    last = quotes.groupBy("symbol").agg(F.max_by(F.struct("event_ms", "bid", "ask", "bid_qty", "ask_qty"), F.struct("event_ms", "update_id")).alias("q")).select("symbol", "q.*")
    mid: Column = (F.col("bid") + F.col("ask")) / 2
    spread = (F.col("ask") - F.col("bid")) / mid * 10_000
    depth = F.least(F.lit(1.0), (F.col("bid") * F.col("bid_qty") + F.col("ask") * F.col("ask_qty")) / full_depth)
    return last.select("symbol", "event_ms", spread.alias("spread_bps"), depth.alias("depth_score"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * (1 - F.least(F.lit(1.0), spread / max(0.1, widest_bps))) + 0.65 * depth)).alias("score"), (now_ms - F.col("event_ms") > stale_ms).alias("stale"))
