"""Whether windows of time were observed without a break: one connection a stream, begun before, no gap, nothing missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, intervals


def connection_starts(events: DataFrame) -> DataFrame:
    """(stream, connection, started): the first event of each connection."""
    return events.groupBy("stream", "connection").agg(F.min("t").alias("started"))


def gap_spans(gaps: DataFrame, starts: DataFrame) -> DataFrame:
    """Each gap (stream, connection, opened) until the stream's next connection starts; null where none does."""
    known = starts.where("started is not null").select("stream", "started", F.xxhash64("connection").alias("__o"))
    j = asof.asof_forward(gaps.withColumn("__after", F.col("opened") + 1), known, "stream", "__after", "started", "__o")
    return j.select(*gaps.columns, F.col("r_started").alias("resumed"))


def gap_reasons(windows: DataFrame, gaps: DataFrame, starts: DataFrame) -> DataFrame:
    """(window_id, reason): how many of a stream's gaps touch each window; a gap lasts until just before it is resumed."""
    spans = gap_spans(gaps, starts).select("stream", "opened", (F.col("resumed") - 1).alias("__last"))
    pairs = intervals.overlap_join(windows.select("window_id", "w_start", "w_end"), spans, [], ("w_start", "w_end"), ("opened", "__last"))
    return pairs.groupBy("window_id", "stream").agg(F.count("*").alias("n")).select("window_id", F.concat_ws(":", F.lit("stream_gap"), "stream", F.col("n").cast("string")).alias("reason"))


def _name(*parts: str | Column) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts], F.col("asset"), F.when(F.col("token") != "", F.col("token")))


def stream_evidence(windows: DataFrame, expected: DataFrame, events: DataFrame, starts: DataFrame, kinds: list[str]) -> DataFrame:
    """What each window has of each (stream, asset, token) that it needs: events by kind, connections, the first of them
    with its start, and the connection of the last event at or before the window's start.

    Events are counted by connection first, so that a busy stream is shared out before its windows meet.
    """
    slot = ["window_id", "stream", "asset", "token"]
    seen = intervals.contained_join(windows.select("window_id", "w_start", "w_end"), events.select("stream", "asset", "token", "kind", "connection", "t"), [], ("w_start", "w_end"), "t")
    by_connection = seen.groupBy(*slot, "connection").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("__n"))
    inside = by_connection.groupBy(*slot).agg(F.sum("__n").alias("n"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds], F.count("connection").alias("connections"), F.min("connection").alias("connection"))
    asked = expected.join(windows.select("window_id", "w_start"), "window_id").withColumn("__key", F.concat_ws("\x00", "stream", "asset", "token"))
    before = events.select(F.concat_ws("\x00", "stream", "asset", "token").alias("__key"), F.col("t").alias("at"), F.col("id").alias("__o"), "connection")
    based = asof.asof_join(asked, before, "__key", "w_start", "at", "__o", "b_").drop("__key", "b___o")
    full = based.join(inside, slot, "left").fillna(0, ["n", "connections", *[f"n_{k}" for k in kinds]])
    began = starts.select("stream", "connection", F.col("started").alias("connection_started"))
    return full.join(began, ["stream", "connection"], "left")


def evidence_reasons(evidence: DataFrame, kinds: list[str]) -> DataFrame:
    """(window_id, reason) of what each needed stream lacks."""
    missing = [F.when(F.array_contains("needs", k) & (F.col(f"n_{k}") == 0), _name("missing", F.col("stream"), k)) for k in kinds]
    reasons = F.array_compact(
        F.array(
            *missing,
            F.when(F.col("n") == 0, _name("missing_window", F.col("stream"))),
            F.when(F.col("connections") != 1, F.concat_ws(":", _name("segment_count", F.col("stream")), F.col("connections").cast("string"))),
            F.when(F.col("connection_started").isNull() | (F.col("connection_started") > F.col("w_start")), _name("segment_started_after_window", F.col("stream"))),
            F.when(F.col("baseline") & F.col("b_connection").isNull(), _name("missing_baseline", F.col("stream"))),
            F.when(F.col("baseline") & F.col("b_connection").isNotNull() & ~F.col("b_connection").eqNullSafe(F.col("connection")), _name("baseline_segment_mismatch", F.col("stream"))),
        )
    )
    return evidence.select("window_id", F.explode(reasons).alias("reason"))


def eligibility(windows: DataFrame, expected: DataFrame, events: DataFrame, gaps: DataFrame, snapshots: DataFrame, kinds: list[str], warmup: int) -> DataFrame:
    """Each window (window_id, w_start, w_end, event_start) with ``eligible`` and its sorted ``reasons``.

    ``expected`` lists what a window needs: (window_id, stream, asset, token, needs array of kinds, baseline boolean), token
    '' where a stream has none. ``events`` are (id, stream, asset, token, kind, connection, t); ``gaps`` (stream,
    connection, opened); ``snapshots`` (window_id, asset, observed). The run lasts from the first event to the last. Events
    without a time or a connection count for nothing; a window without a start has no evidence at all.
    """
    held = events.where("t is not null and connection is not null")
    starts = connection_starts(held)
    evidence = stream_evidence(windows, expected, held, starts, kinds)
    run = held.agg(F.min("t").alias("__a"), F.max("t").alias("__z"))
    bounds = windows.join(F.broadcast(run), F.lit(True))  # one row
    late_run = F.array_compact(F.array(F.when(F.col("__a") > F.col("w_start"), "run_started_after_window_start"), F.when(F.col("__z") < F.col("w_end"), "run_ended_before_window_end")))
    assets = expected.select("window_id", "asset").distinct().join(windows.select("window_id", "event_start"), "window_id").join(snapshots, ["window_id", "asset"], "left")
    late = assets.where(F.col("observed").isNull() | (F.col("observed") > F.col("event_start") + warmup)).select("window_id", F.concat(F.lit("late_or_missing_snapshot:"), "asset").alias("reason"))
    every = evidence_reasons(evidence, kinds).unionByName(gap_reasons(windows, gaps, starts)).unionByName(late).unionByName(bounds.select("window_id", F.explode(late_run).alias("reason")))
    told = every.groupBy("window_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    out = windows.join(told, "window_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    return out.withColumn("eligible", F.size("reasons") == 0)
