"""Point-in-time joins that scale with time, not with keys.

Rows are dealt out by (key, time bucket), so that few keys still make many tasks. Inside a bucket the latest right row
is a running last value; what a bucket starts with is the last right row of the nearest earlier bucket that has one, a
window over one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 6 * 3_600_000


def _bucket(t: Column, bucket_ms: int, row: Column) -> Column:
    """The time bucket of a row; rows without a time are dealt out by their content, far before all times."""
    return F.coalesce(F.floor(t / bucket_ms), F.lit(-(1 << 52)) - F.xxhash64(row).bitwiseAND(1023))


def _key(key: str | Column) -> Column:
    """A key as a struct, which is never null: no filter on it is inferred that one consumer of a shuffle has and the other lacks."""
    return F.struct((F.col(key) if isinstance(key, str) else key).alias("k"))


def _by_bucket(rows: DataFrame, *aggs: Column) -> DataFrame:
    """One row for each (key, bucket), from the very rows that the windows inside buckets see.

    Counting every column asks for the same columns as those windows do, so that both read one shuffle and what lies below
    it is computed once; counts are never negative.
    """
    others = [c for c in rows.columns if c not in ("__k", "__b")]
    counts = F.greatest(*[F.count(c) for c in others], F.lit(0)) if others else F.lit(0)
    return rows.groupBy("__k", "__b").agg(*aggs, counts.alias("__whole")).where("__whole >= 0").drop("__whole")


def _known(key: str, t: str) -> Column:
    return F.col(key).isNotNull() & F.col(t).isNotNull()


def asof_join(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, order: str, prefix: str = "r_", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Each left row with the latest right row at or before its time (ties by ``order``); null where there is none.

    A left row without key or time is kept and matches nothing; a right row without either is matched by nothing.
    """
    value = F.struct(*[F.col(c).alias(prefix + c) for c in right.columns if c != key])
    none = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    row = F.struct(*[F.col(c) for c in left.columns])
    gone = F.lit(None).cast(left.select(row.alias("v")).schema["v"].dataType)
    a = left.select(_key(key).alias("__k"), F.col(left_t).alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__o"), row.alias("__row"), none.alias("__v"))
    b = right.where(_known(key, right_t)).select(_key(key).alias("__k"), F.col(right_t).alias("__t"), F.lit(0).alias("__side"), F.col(order).cast("long").alias("__o"), gone.alias("__row"), value.alias("__v"))
    both = a.unionByName(b).withColumn("__b", _bucket(F.col("__t"), bucket_ms, F.col("__row")))
    inside = Window.partitionBy("__k", "__b").orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
    # one row a bucket: its last right row, if it has one
    buckets = _by_bucket(seen, F.max_by("__in", F.struct("__t", "__side", "__o")).alias("__last"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.select("__k", "__b", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    found = seen.where("__side = 1").join(carry, ["__k", "__b"], "left").select("__row.*", F.coalesce("__in", "__carry").alias("__m"))
    return found.select(*left.columns, "__m.*")


def neighbour(df: DataFrame, key: str, t: str, order: str, columns: list[str], prefix: str, ahead: bool = False, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Each row with columns of the one before it (or after) by (t, order) in its key; null at the end.

    A lag inside a time bucket; a bucket's first row takes the last row of the bucket before. A row without key or time
    is kept, has no neighbour and is none.
    """
    rows = df.withColumns({"__k": _key(key), "__b": _bucket(F.col(t), bucket_ms, F.struct(*df.columns))})
    place = F.struct(t, order)
    by = [F.desc(t), F.desc(order)] if ahead else [F.col(t), F.col(order)]
    held = F.when(_known(key, t), F.struct(*[F.col(c).alias(prefix + c) for c in columns]))
    edge = F.min_by(held, place) if ahead else F.max_by(held, place)
    order_by = F.desc("__b") if ahead else F.col("__b")
    # column by column, since a struct of them would be a second copy of each row in the shuffle; a bucket has only rows with key and time, or none
    w = Window.partitionBy("__k", "__b").orderBy(*by)
    inside = rows.withColumns({"__has": F.lag(F.lit(True)).over(w)} | {f"__near_{c}": F.lag(c).over(w) for c in columns})
    edges = _by_bucket(inside, edge.alias("__edge")).withColumn("__carry", F.lag("__edge").over(Window.partitionBy("__k").orderBy(order_by))).select("__k", "__b", "__carry")
    near = F.when(_known(key, t), F.when(F.col("__has"), F.struct(*[F.col(f"__near_{c}").alias(prefix + c) for c in columns])).otherwise(F.col("__carry")))
    return inside.join(edges, ["__k", "__b"], "left").withColumn("__near", near).select(*df.columns, "__near.*")


def last_known(df: DataFrame, key: str, t: str, columns: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Rows, one for each key and time, with each column's last value that is not null at or before the row, in place.

    A row without key or time keeps its own values and lends none.
    """
    rows = df.withColumns({"__k": _key(key), "__b": _bucket(F.col(t), bucket_ms, F.struct(*df.columns))})
    inside = Window.partitionBy("__k", "__b").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({f"__in_{c}": F.when(_known(key, t), F.last(c, ignorenulls=True).over(inside)).otherwise(F.col(c)) for c in columns})
    ends = _by_bucket(seen, *[F.max_by(f"__in_{c}", F.when(_known(key, t), F.col(t))).alias(f"__end_{c}") for c in columns])
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("__k", "__b", *[F.last(f"__end_{c}", ignorenulls=True).over(before).alias(f"__carry_{c}") for c in columns])
    held = {c: F.coalesce(f"__in_{c}", F.when(_known(key, t), F.col(f"__carry_{c}"))) for c in columns}
    return seen.join(carry, ["__k", "__b"], "left").select(*[held.get(c, F.col(c)).alias(c) for c in df.columns])


def window_aggregates(decisions: DataFrame, rows: DataFrame, t: str, span: int, aggs: dict[str, tuple[str, Column, bool]], end_closed: bool = True) -> DataFrame:
    """By id of the decisions (id, symbol, t), aggregates over the rows of its symbol from t - span to t.

    ``aggs``: name -> (sum, count, min or max, column, whether a row at t - span itself counts); ``end_closed``: whether rows
    at t do. With time cut in bins as long as the span, a window is the end of one bin and the beginning of the next, so
    it meets what has run up inside the one from its end and inside the other from its start: no pairs of a decision and
    a row are made, and nothing is subtracted. Decisions without rows are kept with nulls, and counts of 0.
    """
    how = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    kinds = sorted({closed for _, _, closed in aggs.values()})
    marks = [F.struct(F.col("t").alias("__t"), F.lit(2 if end_closed else 0).alias("__place"), F.lit("now").alias("__mark"))]
    marks += [F.struct((F.col("t") - span).alias("__t"), F.lit(2 if closed else 0).alias("__place"), F.lit(f"then_{closed}").alias("__mark")) for closed in kinds]
    asked = decisions.select("id", _key("symbol").alias("__k"), F.inline(F.array(*marks)))
    asked = asked.withColumn("__b", _bucket(F.col("__t"), span, F.struct("id", "__mark")))
    held = rows.where(_known("symbol", t)).select(_key("symbol").alias("__k"), F.col(t).alias("__t"), F.lit(1).alias("__place"), F.floor(F.col(t) / span).alias("__b"), *[c.alias(f"__v_{n}") for n, (_, c, _) in aggs.items()])
    both = held.unionByName(asked, allowMissingColumns=True)
    bin_of = Window.partitionBy("__k", "__b")
    after, before = bin_of.orderBy("__t", "__place"), bin_of.orderBy(F.desc("__t"), "__place")
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    run = {f"__a_{n}": how[h](f"__v_{n}").over(to_here(after)) for n, (h, _, _) in aggs.items()} | {f"__z_{n}": how[h](f"__v_{n}").over(to_here(before)) for n, (h, _, _) in aggs.items()}
    seen = both.withColumns(run).where("__place <> 1")

    def part(n: str, closed: bool) -> Column:
        return F.when(F.col("__mark") == "now", F.col(f"__a_{n}")).when(F.col("__mark") == f"then_{closed}", F.col(f"__z_{n}"))

    return seen.groupBy("id").agg(*[(how["sum"] if h == "count" else how[h])(part(n, closed)).alias(n) for n, (h, _, closed) in aggs.items()])


def asof_quotes(requests: DataFrame, quotes: DataFrame, max_age: int) -> DataFrame:
    """The quote known at each request, and whether it is fresh and sane; requests without one are kept."""
    j = asof_join(requests, quotes, "symbol", "t", "event_ms", "update_id")
    age = F.col("t") - F.col("r_event_ms")
    valid = age.between(0, max_age) & (F.col("r_bid") > 0) & (F.col("r_bid") < F.col("r_ask")) & (F.col("r_bid_qty") > 0) & (F.col("r_ask_qty") > 0)
    return j.withColumn("age", age).withColumn("valid", F.coalesce(valid, F.lit(False)))


def exact_horizon_join(bars: DataFrame, horizon: int) -> DataFrame:
    """Each bar with the one exactly ``horizon`` later on the same UTC day."""
    later = bars.select("symbol", (F.col("open_time") - horizon).alias("open_time"), F.col("close").alias("later_close"))
    same_day = F.floor(F.col("open_time") / 86_400_000) == F.floor((F.col("open_time") + horizon) / 86_400_000)
    return bars.join(later, ["symbol", "open_time"]).where(same_day)


def horizon_exclusions(bars: DataFrame, horizon: int) -> DataFrame:
    """For each symbol, how many bars the exact-horizon join keeps, and why it leaves others out."""
    later = bars.select("symbol", (F.col("open_time") - horizon).alias("open_time"), F.lit(True).alias("__there"))
    same_day = F.floor(F.col("open_time") / 86_400_000) == F.floor((F.col("open_time") + horizon) / 86_400_000)
    rows = bars.select("symbol", "open_time").join(later, ["symbol", "open_time"], "left")
    there = F.col("__there").isNotNull()
    return rows.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(there & same_day).alias("kept"), F.count_if(~same_day).alias("crosses_day"), F.count_if(same_day & ~there).alias("no_later_bar"))


def running_sum(events: DataFrame, key: str, t: str, order: str, value: str, name: str = "s", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Running sum by (t, order) for each key: sums inside a time bucket, on top of the buckets before.

    A row without key or time is kept with a null sum and adds to none; null values add nothing.
    """
    return running_sums(events, key, t, order, {name: value}, bucket_ms)


def running_sums(events: DataFrame, key: str, t: str, order: str, values: dict[str, str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Several running sums (name of the sum: column) in one pass."""
    rows = events.withColumns({"__k": _key(key), "__b": _bucket(F.col(t), bucket_ms, F.struct(*events.columns))})
    inside = Window.partitionBy("__k", "__b").orderBy(t, order).rowsBetween(Window.unboundedPreceding, 0)
    ran = rows.withColumns({f"__in_{n}": F.sum(v).over(inside) for n, v in values.items()})
    totals = _by_bucket(ran, *[F.sum(F.when(_known(key, t), F.col(v))).alias(f"__total_{n}") for n, v in values.items()])
    earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__k", "__b", *[F.sum(f"__total_{n}").over(earlier).alias(f"__before_{n}") for n in values])
    sums = {n: F.when(_known(key, t), F.coalesce(F.col(f"__in_{n}") + F.col(f"__before_{n}"), F.col(f"__in_{n}"), F.col(f"__before_{n}"))) for n in values}
    return ran.join(before, ["__k", "__b"], "left").withColumns(sums).select(*[c for c in events.columns if c not in values], *values)


def sums_at(left: DataFrame, times: dict[str, Column], events: DataFrame, value: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Each left row with, for each named time, the sum of its symbol's event values up to and including that time.

    Events and the times asked for are one union, dealt out by (symbol, bucket) and run up once; what comes before a
    bucket is a window over one row for each bucket. The times of a row meet again by two hashes of the row, which itself
    goes along with the first time only; equal rows stay as many as they were. A null time or symbol has a null sum;
    events without a time or symbol are left out.
    """
    first = next(iter(times))
    row = F.struct(*[F.col(c) for c in left.columns])
    none = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    asked = F.inline(F.array(*[F.struct(t.cast("long").alias("__t"), F.lit(name).alias("__name")) for name, t in times.items()]))
    marked = left.select(_key("symbol").alias("__k"), row.alias("__whole"), F.struct(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b")).alias("__id"), asked)
    marks = marked.select("__k", "__t", F.lit(1).alias("__side"), F.lit(0.0).alias("__v"), "__id", F.when(F.col("__name") == first, F.col("__whole")).alias("__row"), "__name")
    unmarked = marks.schema["__id"].dataType
    told_events = events.where("symbol IS NOT NULL AND t IS NOT NULL").select(_key("symbol").alias("__k"), F.col("t").cast("long").alias("__t"), F.lit(0).alias("__side"), F.col(value).cast("double").alias("__v"), F.lit(None).cast(unmarked).alias("__id"), none.alias("__row"), F.lit(None).cast("string").alias("__name"))
    both = told_events.unionByName(marks).withColumn("__b", _bucket(F.col("__t"), bucket_ms, F.col("__id")))
    inside = Window.partitionBy("__k", "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__s", F.sum("__v").over(inside))
    totals = _by_bucket(seen, F.sum("__v").alias("__total"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__k", "__b", F.coalesce(F.sum("__total").over(before), F.lit(0.0)).alias("__carry"))
    told = F.when(_known("__k.k", "__t"), F.coalesce("__s", F.lit(0.0)) + F.col("__carry"))
    found = seen.where("__side = 1").join(carry, ["__k", "__b"], "left").withColumn("__s", told)
    met = found.groupBy("__id").agg(F.first("__row", ignorenulls=True).alias("__row"), F.count_if(F.col("__name") == first).cast("int").alias("__n"), *[F.max(F.when(F.col("__name") == name, F.col("__s"))).alias(name) for name in times])
    return met.select("__row", *times, F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*", *times)


def trailing_event_sum(grid: DataFrame, events: DataFrame, span: int, value: str) -> DataFrame:
    """Sum of event values in (t - span, t] at each grid time."""
    return trailing_event_sums(grid, events, {"trailing": span}, value)


def trailing_event_sums(grid: DataFrame, events: DataFrame, spans: dict[str, int], value: str) -> DataFrame:
    """Sums of event values in (t - span, t] at each grid time, for each named span."""
    times = {"__now": F.col("open_time")} | {f"__{n}": F.col("open_time") - span for n, span in spans.items()}
    return sums_at(grid, times, events, value).select(*grid.columns, *[(F.col("__now") - F.col(f"__{n}")).alias(n) for n in spans])


def interval_sum(left: DataFrame, events: DataFrame, start: str, end: str, value: str) -> DataFrame:
    """Sum of event values in (start, end], as the difference of two running sums."""
    return sums_at(left, {"__a": F.col(start), "__z": F.col(end)}, events, value).select(*left.columns, (F.col("__z") - F.col("__a")).alias("between"))


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, order: str, prefix: str = "r_", bucket_ms: int = BUCKET_MS, max_age: int | None = None) -> DataFrame:
    """Each left row with the first right row at or after its time (ties by ``order``): the join run backwards.

    Rows further away than ``max_age`` count as none.
    """
    back = right.withColumn("__nt", -F.col(right_t)).withColumn("__no", -F.col(order))
    j = asof_join(left.withColumn("__lt", -F.col(left_t)), back, key, "__lt", "__nt", "__no", prefix, bucket_ms)
    j = j.drop("__lt", f"{prefix}__nt", f"{prefix}__no")
    if max_age is None:
        return j
    near = F.col(f"{prefix}{right_t}") - F.col(left_t) <= max_age
    return j.select(*left.columns, *[F.when(near, F.col(c)).alias(c) for c in j.columns if c not in left.columns])


def asof_lags(left: DataFrame, series: DataFrame, lags: list[int], value: str) -> DataFrame:
    """The series' value at t - lag for each lag, as columns."""
    asked = left.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("__at", F.col("t") - F.col("lag"))
    j = asof_join(asked, series, "symbol", "__at", "t", "id")
    return j.groupBy("id", "symbol").agg(*[F.max(F.when(F.col("lag") == k, F.col(f"r_{value}"))).alias(f"{value}_{k}") for k in lags])


def next_row_join(bars: DataFrame, step: int) -> DataFrame:
    """Each bar with the one a step later, where there is one."""
    later = bars.select("symbol", (F.col("open_time") - step).alias("open_time"), F.col("close").alias("next_close"))
    return bars.join(later, ["symbol", "open_time"])


def common_timestamps(panel: DataFrame) -> DataFrame:
    """Rows at the times that every symbol has."""
    symbols = panel.agg(F.count_distinct("symbol").alias("__all"))
    times = panel.groupBy("open_time").agg(F.count_distinct("symbol").alias("__n")).join(F.broadcast(symbols), F.col("__n") == F.col("__all"), "left_semi")
    return panel.join(times, "open_time", "left_semi")


def causal_left_join(core: DataFrame, sidecar: DataFrame, keys: list[str]) -> DataFrame:
    """Optional columns beside the core rows, and whether they were there."""
    return core.join(sidecar.withColumn("available", F.lit(True)), keys, "left").withColumn("available", F.coalesce("available", F.lit(False)))


def current_view(facts: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of the archives that the manifest calls current."""
    return facts.join(manifest.where("is_current"), keys, "left_semi")


def redundant_pairing(lanes: DataFrame, window_ms: int) -> DataFrame:
    """The k-th copy of a message on two lanes is one message if both came within the window; else each is its own.

    One aggregate by (message, k) instead of a join of the lanes.
    """
    nth = F.row_number().over(Window.partitionBy("message", "lane").orderBy("received"))
    pairs = lanes.withColumn("k", nth).groupBy("message", "k").agg(F.min("received").alias("a"), F.max("received").alias("b"), F.count("*").alias("n"))
    paired = (F.col("n") == 2) & (F.col("b") - F.col("a") <= window_ms)
    times = F.when((F.col("n") == 1) | paired, F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select("message", "k", F.explode(times).alias("received"), paired.alias("paired"), F.when(paired, F.col("b") - F.col("a")).alias("lane_gap"))


def scenarios(df: DataFrame, rows: list[tuple[str, float]]) -> DataFrame:
    """Every row under every (name, cost) scenario, without a join."""
    listed = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("cost")) for n, c in rows])
    return df.withColumn("__s", F.explode(listed)).select(*df.columns, "__s.scenario", "__s.cost")


def first_passage(orders: DataFrame, trades: DataFrame, required: int, expiry_ms: int) -> DataFrame:
    """When a queue ahead of each order was traded away at its level: the first trade at which the level's traded
    quantity since arrival reaches ``required``; null where that is later than the expiry.

    Both lookups are as-of joins: the level's running quantity at arrival, then the trade that brings it to the sum.
    """
    run = running_sum(trades.withColumn("__q", F.col("qty").cast("double")), "level", "t", "id", "__q").select("level", "t", "id", F.col("s").cast("long").alias("s"))
    at = asof_join(orders, run, "level", "t", "t", "id")
    want = at.withColumn("__goal", F.coalesce("r_s", F.lit(0)) + required).select(*orders.columns, "__goal")
    hit = asof_forward(want, run.withColumnRenamed("t", "at"), "level", "__goal", "s", "at", bucket_ms=4096)
    inside = F.col("r_at") - F.col("t") <= expiry_ms
    return hit.select(*orders.columns, F.when(inside, F.col("r_at")).alias("filled"))
