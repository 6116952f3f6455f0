"""Forecast rows from a trade tape and cumulative depth: a clock, what was last known at each second, features and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, bars
from tidemark.operators.features import by_time, chunked, frame, own
from tidemark.operators.microstructure import Columns

#: Seconds looked back over, fixed values.
RETURNS = (1, 5, 15, 30, 60, 120, 300, 900)
VOLATILITIES = (10, 30, 60, 120, 300, 900)
RANGES = (5, 15, 30, 60, 300, 900)
FLOWS = (1, 5, 15, 60, 300)
VWAPS = (15, 60, 300, 900)
EFFICIENCIES = (60, 300, 900)
OBSERVATIONS = (60, 300, 900)
ACCELERATIONS = ((5, 60), (15, 300))
ALIGNMENTS = (15, 60, 300)
HISTORY = 900
BANDS = ("fine", "near", "far")
SUMMED = ("step", "square", "move", "base_volume", "quote_volume", "signed", "trade_count", "traded")


def source_rows(tape: DataFrame, depth: DataFrame, step: int) -> DataFrame:
    """Every second from a symbol's first to its last trade, with the trades of that second or the price held from before
    without volume, and the last depth at or before it.

    ``tape``: (symbol, open_time, open, high, low, close, base_volume, quote_volume, buy_volume, sell_volume, trade_count);
    ``depth``: (symbol, depth_time, and bid_/ask_ notional and imbalance of each band). Rows without a symbol or a time are
    left out; of several depths at one time the one with the greatest imbalance nearby counts.
    """
    known = tape.where("symbol is not null and open_time is not null")
    rows = bars.clock_spine(known, step).join(known.withColumn("__traded", F.col("open_time")), ["symbol", "open_time"], "left")
    held = asof.last_known(rows.withColumn("trade_time", F.col("__traded")).withColumn("__price", F.col("close")), "symbol", "open_time", ["trade_time", "__price"])
    here = F.col("__traded").isNotNull()
    flat = {c: F.when(here, F.col(c)).otherwise(F.col("__price")) for c in ("open", "high", "low", "close")}
    still = {c: F.when(here, F.col(c).cast("double")).otherwise(0.0) for c in ("base_volume", "quote_volume", "buy_volume", "sell_volume", "trade_count")}
    dense = held.withColumns(flat | still).withColumn("traded", here.cast("double")).drop("__traded", "__price")
    return asof.asof_join(dense, depth.withColumn("__o", F.floor(F.coalesce(F.col("imbalance_near"), F.lit(0.0)) * 1e6).cast("long")), "symbol", "open_time", "depth_time", "__o", "d_").drop("d___o")


def tape_depth_features(rows: DataFrame, step: int, unit: int, max_age: int) -> dict[str, Column]:
    """Features by name over windows of ``source_rows``; depth features are null where the depth is too old."""
    w = Columns()

    def n(seconds: int) -> int:
        return max(1, seconds // unit)

    def ratio(a: Column, d: Column) -> Column:
        return F.coalesce(a / F.when(d != 0, d), F.lit(0.0))

    def over(s: int) -> Column:
        return F.col("close") / F.lag("close", n(s)).over(by_time())

    def spread(k: int) -> Column:
        total = w.sum("step", k)
        seen = F.count("step").over(frame(k))
        return F.when(seen > 1, F.sqrt(F.greatest(w.sum("square", k) - total * total / seen, F.lit(0.0)) / (seen - 1)))

    share = {s: ratio(w.sum("signed", n(s)), w.sum("base_volume", n(s))) for s in {*FLOWS, *ALIGNMENTS}}
    f = {f"return_{s}": (over(s) - 1) * 10_000 for s in RETURNS} | {f"volatility_{s}": spread(n(s)) * 10_000 for s in VOLATILITIES}
    f |= {f"range_{s}": (w.max("high", n(s)) / w.min("low", n(s)) - 1) * 10_000 for s in RANGES}
    f |= {f"log_quote_volume_{s}": F.log1p(w.sum("quote_volume", n(s))) for s in FLOWS} | {f"aggressor_imbalance_{s}": share[s] for s in FLOWS} | {f"log_trade_count_{s}": F.log1p(w.sum("trade_count", n(s))) for s in FLOWS}
    f |= {f"vwap_deviation_{s}": F.coalesce((F.col("close") / (w.sum("quote_volume", n(s)) / F.when(w.sum("base_volume", n(s)) != 0, w.sum("base_volume", n(s)))) - 1) * 10_000, F.lit(0.0)) for s in VWAPS}
    f |= {f"efficiency_{s}": ratio(F.abs(F.log(over(s))), w.sum("move", n(s))) for s in EFFICIENCIES}
    f |= {f"observation_rate_{s}": w.sum("traded", n(s)) / F.count("traded").over(frame(n(s))) for s in OBSERVATIONS}
    for name, c in (("volume", "quote_volume"), ("trade", "trade_count")):
        f |= {f"{name}_acceleration_{a}_{z}": F.log((1e-9 + w.sum(c, n(a)) / n(a)) / (1e-9 + w.sum(c, n(z)) / n(z))) for a, z in ACCELERATIONS}
    f |= {f"alignment_{s}": share[s] * (over(s) - 1) * 10_000 for s in ALIGNMENTS}
    age = F.col("open_time") - F.col("d_depth_time")
    fresh = F.coalesce(age.between(0, max_age), F.lit(False))
    fine = fresh & F.col("d_bid_fine").isNotNull() & F.col("d_ask_fine").isNotNull()
    f |= {"trade_observed": F.col("traded"), "trade_age": (F.col("open_time") - F.col("trade_time")) / 1000, "depth_available": fresh.cast("double"), "fine_depth_available": fine.cast("double"), "depth_age": F.when(fresh, age / 1000)}
    f |= {f"depth_imbalance_{b}": F.when(fresh, F.col(f"d_imbalance_{b}")) for b in BANDS} | {f"log_depth_{b}": F.when(fresh, F.log1p(F.col(f"d_bid_{b}") + F.col(f"d_ask_{b}"))) for b in BANDS}
    f |= {f"log_{s}_curve": F.when(fresh, F.log((1 + F.col(f"d_{s}_far")) / (1 + F.col(f"d_{s}_fine")))) for s in ("bid", "ask")}
    phase = F.pmod(F.floor(F.col("open_time") / 1000), F.lit(86_400)) * (2 * 3.141592653589793 / 86_400)
    weekend = F.pmod(F.floor(F.col("open_time") / 86_400_000) + 3, F.lit(7)) >= 5
    return f | {"day_sin": F.sin(phase), "day_cos": F.cos(phase), "weekend": weekend.cast("double")}


def tape_depth_dataset(tape: DataFrame, depth: DataFrame, step: int = 1000, unit: int = 1, delay: int = 1, horizon: int = 60, cadence: int = 5, max_age: int = 60_000) -> DataFrame:
    """(symbol, decision_time, entry and exit time and price, gross_return, features) of each decision with a whole history
    and a whole future.

    A decision is taken at the end of a second; it enters at the close ``delay`` seconds on and leaves ``horizon`` seconds
    after that. Rows are dealt out by (symbol, stretch of time) with those that windows and targets reach into; windows are
    divided by ``unit`` for rows of another length than a second.
    """
    back, ahead = max(1, HISTORY // unit), delay + horizon
    source = chunked(source_rows(tape, depth, step), back + 1, ahead + 1, step)
    move = F.log(F.col("close") / F.lag("close").over(by_time()))
    rows = source.withColumn("step", move).withColumns({"square": F.col("step") ** 2, "move": F.abs("step"), "signed": F.col("buy_volume") - F.col("sell_volume")})
    rows = rows.withColumns({f"run_{c}": F.sum(F.coalesce(c, F.lit(0.0))).over(by_time().rowsBetween(Window.unboundedPreceding, 0)) for c in SUMMED})

    def later(c: str, k: int) -> Column:
        return F.lead(c, k).over(by_time())

    whole = (F.lag("open_time", back).over(by_time()) == F.col("open_time") - back * step) & (later("open_time", delay) == F.col("open_time") + delay * step) & (later("open_time", ahead) == F.col("open_time") + ahead * step)
    decided = F.col("open_time") + step
    told = rows.select(
        "symbol", "open_time", "__own", "__chunk", whole.alias("__whole"), decided.alias("decision_time"), (decided + delay * step).alias("entry_time"), (decided + ahead * step).alias("exit_time"),
        later("close", delay).alias("entry_price"), later("close", ahead).alias("exit_price"), *[v.alias(k) for k, v in tape_depth_features(rows, step, unit, max_age).items()],
    )
    out = own(told.where("__whole")).where(F.floor(F.col("decision_time") / step) % cadence == 0)
    return out.withColumn("gross_return", (F.col("exit_price") / F.col("entry_price") - 1) * 10_000).drop("__whole", "open_time")
