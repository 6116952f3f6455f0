"""Cleaning and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof


def coverage_report(bars: DataFrame, step: int) -> DataFrame:
    """Span, gaps over 1.5 steps, largest gap and share of expected bars for each symbol, with warnings and a status.

    Gaps and a coverage below 99.5 % fail; less than a year of history is a warning.
    """
    g = asof.neighbour(bars.select("symbol", "open_time"), "symbol", "open_time", "open_time", ["open_time"], "p_", bucket_ms=4096 * step).withColumn("gap", F.col("open_time") - F.col("p_open_time"))
    out = g.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"),
        F.count_if(F.col("gap") > 1.5 * step).alias("gaps"), F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"),
    )
    expected = (F.col("last_time") - F.col("first_time")) / step + 1
    out = out.withColumn("coverage", F.round(F.col("bars") / expected, 6))
    hard = F.concat_ws(",", F.when(F.col("gaps") > 0, "gaps"), F.when(F.col("coverage") < 0.995, "coverage"))
    short = F.when((F.col("last_time") > F.col("first_time")) & (F.col("last_time") - F.col("first_time") < 365 * 86_400_000), "under_a_year")
    out = out.withColumn("warnings", F.concat_ws(",", F.when(hard != "", hard), short))
    return out.withColumn("status", F.when(hard != "", "fail").when(F.col("warnings") != "", "warn").otherwise("ok"))


def id_sequence_audit(trades: DataFrame) -> DataFrame:
    """Duplicates, regressions in time and total gap of constituent ids for each symbol."""
    w = Window.partitionBy("symbol").orderBy("id")
    t = trades.select("symbol", "id", (F.col("id") == F.lag("id").over(w)).alias("dup"), (F.col("t") < F.lag("t").over(w)).alias("back"), (F.col("first_id") - F.lag("last_id").over(w) - 1).alias("gap"))
    return t.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("dup").alias("duplicates"), F.count_if("back").alias("time_regressions"), F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("missing_ids"))


def raw_evidence(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def dedupe_conflicts(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """For each key, its rows, different contents, and whether they conflict."""
    mark = F.sha2(F.to_json(F.struct(*values)), 256)
    out = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(mark).alias("contents"))
    return out.withColumn("conflict", F.col("contents") > 1)


def support_bounds(df: DataFrame, column: str, by: str, k: float = 1.5) -> DataFrame:
    """Quartiles (linear) and the fences k interquartile ranges beyond them."""
    q = df.groupBy(by).agg(F.min(column).alias("low"), F.percentile(column, 0.25).alias("q1"), F.percentile(column, 0.75).alias("q3"), F.max(column).alias("high"))
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower_fence", F.col("q1") - k * iqr).withColumn("upper_fence", F.col("q3") + k * iqr)


def clean_candles(rows: DataFrame, step: int, now_ms: int, order: str) -> DataFrame:
    """Valid, closed candles; of several for one time the last to come in, by one aggregate."""
    sane = (F.col("low") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") >= 0)
    kept = rows.where(sane & (F.col("open_time") + step <= now_ms))
    value = F.struct(*[c for c in rows.columns if c not in ("symbol", "open_time")])
    return kept.groupBy("symbol", "open_time").agg(F.max_by(value, order).alias("v")).select("symbol", "open_time", "v.*")


def series_profile(bars: DataFrame, step: int) -> DataFrame:
    """Rows, repeated times, gaps, times that fall in order of arrival, numbers that are not finite, bad prices or volumes
    and the rows of each source, by symbol. Rows without a symbol or a time count, but neither repeat nor leave a gap."""
    near = asof.neighbour(bars, "symbol", "open_time", "id", ["open_time"], "p_", bucket_ms=4096 * step).withColumn("gap", F.col("open_time") - F.col("p_open_time"))
    near = asof.neighbour(near, "symbol", "id", "id", ["open_time"], "q_", bucket_ms=1 << 20)
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0)
    numbers = ("open", "high", "low", "close", "volume")
    odd = F.array_max(F.array(*[F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)) for c in numbers]))
    # by source first: a symbol has few of them
    cells = near.groupBy("symbol", "source").agg(
        F.count_if(odd).alias("not_finite"), F.count("*").alias("n"), F.count_if(F.col("gap") == 0).alias("repeated"), F.count_if(F.col("gap") > step).alias("gaps"),
        F.count_if(F.col("open_time") < F.col("q_open_time")).alias("regressed"), F.count_if(bad).alias("bad_prices"), F.count_if(F.col("volume") < 0).alias("bad_volumes"),
    )
    counts = ("not_finite", "n", "repeated", "gaps", "regressed", "bad_prices", "bad_volumes")
    told = F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("source", F.lit("none")), F.col("n").cast("string"))))
    return cells.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in counts], F.array_join(told, ",").alias("sources"))


def completeness(rows: DataFrame, t: str, day_ms: int = 86_400_000) -> DataFrame:
    """Days expected, present and missing of each symbol between the first and last day of all."""
    days = rows.groupBy("symbol", F.floor(F.col(t) / day_ms).alias("day")).agg(F.lit(1).alias("here"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = days.select("symbol").distinct().crossJoin(F.broadcast(ends)).select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    joined = spine.join(days, ["symbol", "day"], "left")
    return joined.groupBy("symbol").agg(F.count("*").alias("expected"), F.count("here").alias("present"), F.count_if(F.col("here").isNull()).alias("missing"))


def quality_audit(rows: DataFrame, by: str, key: str, checks: dict[str, Column], examples: int = 3) -> DataFrame:
    """Accepted rows and failures of each check by stream, with the first failing keys as examples."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    marked = rows.select(by, key, failed.alias("failed"))
    counts = marked.groupBy(by).agg(F.count_if(F.size("failed") == 0).alias("accepted"), *[F.count_if(F.array_contains("failed", n)).alias(n) for n in checks])
    first = Window.partitionBy(by).orderBy(key)
    few = marked.where(F.size("failed") > 0).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= examples)
    shown = few.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("examples"))
    return counts.join(shown, by, "left")


def feed_coverage(rows: DataFrame, by: str, member: str) -> DataFrame:
    """Members expected (all that were ever seen), observed and absent for each group; members are a dimension of bounded size."""
    seen = rows.groupBy(by, member).agg(F.count("*").alias("n"))
    mine = seen.groupBy(by).agg(F.collect_set(member).alias("__mine"), F.count("*").alias("observed"), F.sum("n").alias("rows"))
    every = seen.agg(F.collect_set(member).alias("__every"))  # one row that holds the dimension
    both = mine.crossJoin(F.broadcast(every))
    return both.select(by, F.size("__every").cast("long").alias("expected"), "observed", F.array_join(F.array_sort(F.array_except("__every", "__mine")), ",").alias("absent"), "rows")


def reconcile(facts: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows counted against rows the manifest states, also where one side has none."""
    counted = facts.groupBy(*keys).agg(F.count("*").alias("counted"))
    both = counted.join(manifest.select(*keys, "stated"), keys, "full")
    return both.select(*keys, F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("stated", F.lit(0)).alias("stated"), F.equal_null("counted", "stated").alias("agrees"))


def age_audit(joined: DataFrame, most: int) -> DataFrame:
    """Rows with and without a value, quantiles of the age and how many break the limit."""
    age = F.col("age")
    return joined.groupBy("symbol").agg(F.count("*").alias("n"), F.count("age").alias("available"), F.min("age").alias("min_age"), F.percentile("age", 0.5).alias("p50_age"), F.percentile("age", 0.99).alias("p99_age"), F.max("age").alias("max_age"), F.count_if((age > most) | (age < 0)).alias("breaks"))


def before_cutoff(rows: DataFrame, t: str, at: int, strict: bool = False) -> DataFrame:
    """Rows before a frozen cutoff; those at or after it, or without a time, are rejected, with an error if ``strict``."""
    late = F.coalesce(F.col(t) >= at, F.lit(True))
    return rows.where(F.assert_true(~late, f"a row at or after the cutoff {at}").isNull()) if strict else rows.where(~late)


def partitions_by_cutoff(rows: DataFrame, t: str, at: int, part_ms: int = 86_400_000) -> DataFrame:
    """Each partition of time with its rows kept and rejected, and whether it is frozen, prospective or cut through."""
    late = F.col(t) >= at
    g = rows.groupBy(F.floor(F.col(t) / part_ms).alias("part")).agg(F.count_if(~late).alias("kept"), F.count_if(late).alias("rejected"))
    return g.withColumn("kind", F.when(F.col("rejected") == 0, "frozen").when(F.col("kept") == 0, "prospective").otherwise("cut"))


def support_apply(rows: DataFrame, bounds: DataFrame, features: list[str], outside: int, extreme: int) -> DataFrame:
    """Rows with how many features lie outside the training range and its outer fences, and whether the row abstains.

    ``bounds`` is one row of low, high, lower and upper for each feature, by name.
    """
    known = rows.crossJoin(F.broadcast(bounds))
    beyond = sum(((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high"))).cast("int") for c in features)
    far = sum(((F.col(c) < F.col(f"{c}_lower")) | (F.col(c) > F.col(f"{c}_upper"))).cast("int") for c in features)
    return known.select(*rows.columns, beyond.alias("outside"), far.alias("extreme")).withColumn("abstain", (F.col("outside") > outside) | (F.col("extreme") > extreme))


def support_fit(rows: DataFrame, features: list[str], k: float) -> DataFrame:
    """Range, quartiles (linear) and outer fences of each feature over training rows, as one row."""
    q = rows.agg(*[x for c in features for x in (F.min(c).alias(f"{c}_low"), F.percentile(c, 0.25).alias(f"{c}_q1"), F.percentile(c, 0.5).alias(f"{c}_median"), F.percentile(c, 0.75).alias(f"{c}_q3"), F.max(c).alias(f"{c}_high"))])
    for c in features:
        iqr = F.col(f"{c}_q3") - F.col(f"{c}_q1")
        q = q.withColumn(f"{c}_lower", F.least(F.col(f"{c}_low"), F.col(f"{c}_q1") - k * iqr)).withColumn(f"{c}_upper", F.greatest(F.col(f"{c}_high"), F.col(f"{c}_q3") + k * iqr))
    return q
