"""What a price did inside windows: ordered path aggregates that merge from one stretch of a window to the next."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.operators import intervals


def ticks_seen(markets: DataFrame, ticks: DataFrame) -> DataFrame:
    """Ticks of a market's window that had been received when it was observed; of one source time, the first received.

    ``markets``: (market_id, symbol, start, end, observed), the end excluded; ``ticks``: (symbol, id, source, published,
    received, price). Ticks without a time or a positive price are none.
    """
    good = ticks.where("source is not null and received is not null and price > 0")
    held = markets.withColumn("__last", F.col("end") - 1)
    pairs = intervals.contained_join(held, good, ["symbol"], ("start", "__last"), "source").where("received <= observed")
    keep = F.min_by(F.struct("id", "published", "received", "price"), F.struct("received", "id")).alias("x")
    return pairs.groupBy("market_id", "source").agg(keep).select("market_id", "source", "x.*")


def path_aggregate(rows: DataFrame, key: str, t: str, price: str, stretch: int) -> DataFrame:
    """Count, first, last, sum of absolute and of squared log returns by key, in order of time.

    Stretches of a key are aggregated apart and joined where they meet, so a long window is many tasks.
    """
    part = rows.withColumn("__s", F.floor(F.col(t) / stretch))
    move = F.log(F.col(price).cast("double")) - F.log(F.lag(price).over(Window.partitionBy(key, "__s").orderBy(t)).cast("double"))
    row = F.struct(*[c for c in rows.columns if c != key])
    steps = part.withColumn("__r", move).groupBy(key, "__s").agg(F.count("*").alias("n"), F.min_by(row, t).alias("first"), F.max_by(row, t).alias("last"), F.sum(F.abs("__r")).alias("a"), F.sum(F.col("__r") ** 2).alias("q"))
    return _joined(steps, key, price)


def _joined(steps: DataFrame, key: str, price: str) -> DataFrame:
    """One row a key from the aggregates of its stretches (key, __s, n, first, last, a, q), with the moves between them."""
    before = F.lag(F.col("last")[price]).over(Window.partitionBy(key).orderBy("__s"))
    joint = F.coalesce(F.log(F.col("first")[price].cast("double")) - F.log(before.cast("double")), F.lit(0.0))
    met = steps.withColumn("__j", joint)
    return met.groupBy(key).agg(
        F.sum("n").alias("n"),
        F.min_by("first", "__s").alias("first"),
        F.max_by("last", "__s").alias("last"),
        F.sum(F.coalesce("a", F.lit(0.0)) + F.abs("__j")).alias("length"),
        F.sum(F.coalesce("q", F.lit(0.0)) + F.col("__j") ** 2).alias("variance"),
    )


def _sweep() -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of one stretch, inside another so that it travels to the workers whole."""

    def sweep(asked: pa.Table, held: pa.Table) -> pa.Table:
        """What each market had seen of a stretch: ticks enter in order of receipt, sums of moves are kept by place (Fenwick trees)."""
        held = held.sort_by("source")
        sources, received = (held.column(c).to_pylist() for c in ("source", "received"))
        logs = [math.log(float(x)) for x in held.column("price").to_pylist()]
        n = len(sources)
        arrival = sorted(range(n), key=received.__getitem__)
        # neighbours at the time of entry: all are linked, then taken out from the last received on
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for i in reversed(arrival):
            if before[i] >= 0:
                after[before[i]] = after[i]
            if after[i] < n:
                before[after[i]] = before[i]
        seen, length, variance = [0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)

        def add(i: int, count: int, move: float, square: float) -> None:
            i += 1
            while i <= n:
                seen[i] += count
                length[i] += move
                variance[i] += square
                i += i & -i

        def upto(i: int) -> tuple[int, float, float]:
            c, a, q = 0, 0.0, 0.0
            while i > 0:
                c, a, q = c + seen[i], a + length[i], q + variance[i]
                i -= i & -i
            return c, a, q

        def place(k: int) -> int:
            i = 0
            for bit in range(n.bit_length() - 1, -1, -1):
                if i + (1 << bit) <= n and seen[i + (1 << bit)] < k:
                    i += 1 << bit
                    k -= seen[i]
            return i

        froms, tos, observed = (asked.column(c).to_pylist() for c in ("__from", "__to", "observed"))
        rows, counts, firsts, lasts, moves, squares, entered = [], [], [], [], [], [], 0
        for m in sorted(range(len(observed)), key=observed.__getitem__):
            while entered < n and received[arrival[entered]] <= observed[m]:
                i = arrival[entered]
                entered += 1
                p, x = before[i], after[i]
                out = logs[x] - logs[i] if x < n else 0.0
                add(i, 1, abs(out), out * out)
                if p >= 0:
                    new, old = logs[i] - logs[p], logs[x] - logs[p] if x < n else 0.0
                    add(p, 0, abs(new) - abs(old), new * new - old * old)
            low, high = upto(bisect.bisect_left(sources, froms[m]))[0], upto(bisect.bisect_right(sources, tos[m]))[0]
            if high > low:
                first, last = place(low + 1), place(high)
                (_, a0, q0), (_, a1, q1) = upto(first), upto(last)
                for column, value in zip((rows, counts, firsts, lasts, moves, squares), (m, high - low, first, last, max(0.0, a1 - a0), max(0.0, q1 - q0)), strict=True):
                    column.append(value)
        rows, firsts, lasts = (pa.array(at, pa.int64()) for at in (rows, firsts, lasts))
        parts = {"market_id": asked.column("market_id").take(rows), "__s": asked.column("__s").take(rows), "n": pa.array(counts, pa.int64()), "a": pa.array(moves, pa.float64()), "q": pa.array(squares, pa.float64())}
        columns = [c for c in held.column_names if c not in ("symbol", "__s")]
        return pa.table(parts | {f"{e}_{c}": held.column(c).take(at) for e, at in (("first", firsts), ("last", lasts)) for c in columns})

    return sweep


def seen_paths(markets: DataFrame, ticks: DataFrame, stretch: int) -> DataFrame:
    """``path_aggregate`` of ``ticks_seen``, without pairs of a market and a tick.

    A market meets each stretch of its window once. Inside a stretch of a symbol ticks enter by receipt and markets ask by
    the time they were observed, so the work grows with ticks and markets and not with their product.
    """
    good = ticks.where("symbol is not null and source is not null and received is not null and price > 0")
    kept = good.groupBy("symbol", "source").agg(F.min_by(F.struct("id", "published", "received", "price"), F.struct("received", "id")).alias("x")).select(F.col("symbol").alias("symbol"), "source", "x.*")
    held = kept.withColumn("__s", F.floor(F.col("source") / stretch))
    ends = good.agg(F.min("source").alias("__min"), F.max("source").alias("__max"))  # one row
    asked = markets.where("symbol is not null and start is not null and observed is not null").crossJoin(F.broadcast(ends))
    asked = asked.select("market_id", F.col("symbol").alias("symbol"), "observed", F.greatest("start", "__min").alias("__from"), F.least(F.coalesce(F.col("end") - 1, F.col("__max")), F.col("__max")).alias("__to")).where("__from <= __to")
    asked = asked.withColumn("__s", F.explode(F.sequence(F.floor(F.col("__from") / stretch), F.floor(F.col("__to") / stretch))))
    types = {f.name: f.dataType for f in held.schema.fields}
    columns = [c for c in held.columns if c not in ("symbol", "__s")]
    schema = StructType([asked.schema["market_id"], asked.schema["__s"], StructField("n", LongType()), StructField("a", DoubleType()), StructField("q", DoubleType())])
    schema = StructType(schema.fields + [StructField(f"{e}_{c}", types[c]) for e in ("first", "last") for c in columns])
    steps = asked.groupBy("symbol", "__s").cogroup(held.groupBy("symbol", "__s")).applyInArrow(_sweep(), schema)
    met = [F.struct(*[F.col(f"{e}_{c}").alias(c) for c in columns]).alias(e) for e in ("first", "last")]
    return _joined(steps.select("market_id", "__s", "n", "a", "q", *met), "market_id", "price")


def path_features(markets: DataFrame, ticks: DataFrame, max_age: int, least_returns: int, least_seconds: float, stretch: int = 60_000) -> DataFrame:
    """How far and how straight a price has come since a window opened, or the reasons why that cannot be told.

    The opening tick must lie exactly at the window's start. Features are null where a reason stands; counts, ages and
    prices are told all the same.
    """
    path = seen_paths(markets, ticks, stretch)
    j = markets.join(path, "market_id", "left")
    count = F.coalesce("n", F.lit(0))
    covered = F.coalesce((F.col("last.source") - F.col("first.source")) / 1000, F.lit(0.0))
    opening = F.when(F.col("first.source") == F.col("start"), F.col("first.price"))
    age = F.col("observed") - F.col("last.source")
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce((F.col("observed") >= F.col("start")) & (F.col("observed") < F.col("end")), F.lit(False)), "market_window_not_live"),
            F.when(opening.isNull(), "exact_opening_missing"),
            F.when(count == 0, "no_causal_ticks"),
            F.when((count > 0) & ~age.between(0, max_age), "current_stale_or_future"),
            F.when(count - 1 < least_returns, "insufficient_return_count"),
            F.when(covered < least_seconds, "insufficient_time_coverage"),
        )
    )
    distance = F.log(F.col("last.price").cast("double") / opening.cast("double"))
    efficiency: Column = F.when(F.col("length") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.abs(distance) / F.col("length")))
    out = j.withColumn("reasons", reasons)
    free = F.size("reasons") == 0
    return out.select(
        "market_id", "symbol", "observed", free.alias("available"),
        F.greatest(F.lit(0.0), (F.col("end") - F.col("observed")) / 1000).alias("remaining_seconds"),
        count.alias("tick_count"), covered.alias("coverage_seconds"), opening.alias("opening"), F.col("last.price").alias("current"),
        F.when(free, distance).alias("log_distance"), F.when(free, F.col("variance") / covered).alias("variance_rate"), F.when(free, efficiency).alias("efficiency"),
        age.alias("source_age"), (F.col("last.published") - F.col("last.source")).alias("publish_delay"), (F.col("last.received") - F.col("last.published")).alias("receipt_delay"),
        "reasons",
    )
