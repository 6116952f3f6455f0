"""Times to an event with right censoring: panels of intervals, rows at risk, hazards and survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_panel(rows: DataFrame, start: str, filled: str, edges: list[int], censored: str | None = None) -> DataFrame:
    """Each row with ``bucket``, the interval in which it ended (1 to k by delay up to each edge, 0 if in none), and
    ``watched``, how many intervals it was under watch for.

    A row that is not filled is watched through every interval that ends by ``censored`` (a time; null or no such column:
    through all). A fill after the row was censored, before its start, or beyond the last edge counts as none.
    """
    if list(edges) != sorted(set(edges)):
        raise ValueError("edges must rise")
    delay = F.col(filled) - F.col(start)
    stop = F.coalesce(F.col(censored) - F.col(start), F.lit(edges[-1])) if censored else F.lit(edges[-1])
    seen = delay.between(0, edges[-1]) & (delay <= stop)
    bucket: Column = F.lit(0)
    for i, edge in reversed(list(enumerate(edges, 1))):
        bucket = F.when(seen & (delay <= edge), i).otherwise(bucket)
    through = sum((F.when(stop >= edge, 1).otherwise(0) for edge in edges), F.lit(0))
    out = rows.withColumn("bucket", bucket)
    return out.withColumn("watched", F.when(F.col("bucket") > 0, F.col("bucket")).otherwise(through))


def risk_rows(panel: DataFrame) -> DataFrame:
    """One row for each interval in which a row was at risk, and whether it ended there: what hazard models learn from."""
    rows = panel.where("watched > 0").withColumn("interval", F.explode(F.sequence(F.lit(1), F.col("watched"))))
    return rows.withColumn("event", (F.col("bucket") == F.col("interval")).cast("int"))


def hazard_risk_set(panel: DataFrame, head: int) -> DataFrame:
    """Rows at risk in one interval, from 0, with the label whether they ended there; nothing is exploded."""
    return panel.where(F.col("watched") > head).withColumn("label", (F.col("bucket") == head + 1).cast("int"))


def hazards(panel: DataFrame, by: list[str]) -> DataFrame:
    """At risk, events, hazard and survival of each interval by group.

    Rows are counted by (group, bucket, watched) first, so the expansion sees a few rows a group, not all.
    """
    cells = panel.groupBy(*by, "bucket", "watched").agg(F.count("*").alias("__n"))
    at = risk_rows(cells).groupBy(*by, "interval").agg(F.sum("__n").alias("at_risk"), F.sum(F.col("__n") * F.col("event")).alias("events"))
    hazard = F.col("events") / F.col("at_risk")
    w = Window.partitionBy(*by).orderBy("interval")
    none_left = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(w) == 1
    stay = F.exp(F.sum(F.when(F.col("events") < F.col("at_risk"), F.log1p(-hazard))).over(w))
    return at.withColumn("hazard", hazard).withColumn("survival", F.when(none_left, 0.0).otherwise(stay))
