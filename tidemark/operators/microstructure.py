"""Features of a second from the hour before it, defined once and computed over tables and over a ring of rows alike.

A row (symbol, open_time, quotes and trades of its second) holds ``COLUMNS``. What trades did is known a
second late, so trade columns are those of the row before. A row has features only if the whole hour before it has no
gap, and where its decision time, the end of its second, falls on the cadence.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import by_time, chunked, frame, own

#: What a row must hold, beside symbol and open_time.
COLUMNS = (
    "high", "low", "close", "close_bid", "close_ask", "close_bid_qty", "close_ask_qty", "spread", "max_spread", "imbalance", "close_imbalance",
    "microprice_offset", "quote_updates", "delay_p50", "delay_p99", "trade_close", "base_volume", "buy_volume", "sell_volume", "trade_imbalance", "trade_count",
)
#: Of these, what trades tell.
TRADE = ("trade_close", "base_volume", "buy_volume", "sell_volume", "trade_imbalance", "trade_count")
#: Seconds looked back over, fixed values.
RETURNS = (1, 5, 15, 30, 60, 120, 300, 900, 1_800, 3_600)
VOLATILITIES = (10, 30, 60, 120, 300, 900, 1_800, 3_600)
RANGES = (60, 300, 900, 1_800, 3_600)
DELTAS = (5, 15, 30, 60)
LEAST = 1e-12


def required(unit: int) -> int:
    """Rows that a feature row needs, itself and the one whose trades and price come before the first among them."""
    return max(1, RETURNS[-1] // unit) + 1


def derived(x: Any, was: Any, b: Any) -> dict[str, Any]:
    """Series of a row and the one before it: log return, order-flow imbalance over mean depth, depth in quote units, late trades."""
    flow = (
        b.where(x("close_bid") >= was("close_bid"), x("close_bid_qty"), 0.0)
        - b.where(x("close_bid") <= was("close_bid"), was("close_bid_qty"), 0.0)
        - b.where(x("close_ask") <= was("close_ask"), x("close_ask_qty"), 0.0)
        + b.where(x("close_ask") >= was("close_ask"), was("close_ask_qty"), 0.0)
    )
    depth = (x("close_bid_qty") + x("close_ask_qty") + was("close_bid_qty") + was("close_ask_qty")) / 2
    step = b.log(x("close") / was("close"))
    bid, ask = x("close_bid") * x("close_bid_qty"), x("close_ask") * x("close_ask_qty")
    out = {"step": step, "move": b.abs(step), "square": step * step, "ofi": flow / b.most(depth, LEAST), "bid_quote": bid, "ask_quote": ask, "depth_quote": bid + ask}
    return out | {c: was(c) for c in TRADE} | {"signed": was("buy_volume") - was("sell_volume")} | {c: x(c) for c in COLUMNS if c not in TRADE}


#: Series that are summed over windows.
SUMMED = ("step", "move", "square", "ofi", "spread", "imbalance", "quote_updates", "trade_imbalance", "signed", "base_volume", "trade_count", "delay_p99", "depth_quote")


def features(b: Any, open_time: Any, unit: int) -> dict[str, Any]:
    """Every feature by name; ``b`` tells sums, means, extremes and earlier values of the series, as columns or numbers."""

    def n(seconds: int) -> int:
        return max(1, seconds // unit)

    def ratio(a: Any, d: Any) -> Any:
        return a / b.most(d, LEAST)

    def fade(name: str, c: str, sizes: tuple[int, ...]) -> dict[str, Any]:
        return {f"{name}_mean_{s}": b.mean(c, n(s)) for s in sizes}

    def deltas(name: str, c: str) -> dict[str, Any]:
        return {f"{name}_delta_{s}": b.now(c) - b.back(c, n(s)) for s in DELTAS}

    total = {s: b.sum("step", n(s)) for s in RETURNS}
    spread_of = {s: b.sqrt(b.most(b.mean("square", n(s)) - b.mean("step", n(s)) * b.mean("step", n(s)), 0.0)) if n(s) > 1 else b.now("step") * 0.0 for s in VOLATILITIES}
    spans = {s: (b.max("high", n(s)) - b.min("low", n(s))) * 10_000 / b.now("close") for s in RANGES}
    high, low, close = b.now("high"), b.now("low"), b.now("close")
    f: dict[str, Any] = {f"return_{s}": total[s] * 10_000 for s in RETURNS}
    f |= {f"volatility_{s}": spread_of[s] * 10_000 for s in VOLATILITIES}
    f |= {"range_1": (high - low) * 10_000 / close} | {f"range_{s}": spans[s] for s in RANGES}
    f |= {"spread": b.now("spread"), "max_spread": b.now("max_spread")} | {f"spread_ratio_{s}": ratio(b.now("spread"), b.mean("spread", n(s))) for s in (60, 300, 900)}
    f |= {"imbalance": b.now("imbalance"), "close_imbalance": b.now("close_imbalance")} | fade("imbalance", "imbalance", (10, 60, 300)) | deltas("close_imbalance", "close_imbalance")
    f |= {"microprice": b.now("microprice_offset")} | deltas("microprice", "microprice_offset")
    f |= {"ofi": b.now("ofi")} | fade("ofi", "ofi", (10, 60, 300)) | deltas("ofi", "ofi")
    f |= {"log_quotes": b.log1p(b.now("quote_updates"))} | {f"quote_ratio_{s}": ratio(b.now("quote_updates"), b.mean("quote_updates", n(s))) for s in (60, 300, 900)}
    f |= {"trade_imbalance": b.now("trade_imbalance")} | fade("trade_imbalance", "trade_imbalance", (10, 60, 300)) | deltas("trade_imbalance", "trade_imbalance")
    f |= {f"signed_share_{s}": ratio(b.sum("signed", n(s)), b.sum("base_volume", n(s))) for s in (10, 60, 300)}
    f |= {"log_volume": b.log1p(b.now("base_volume"))} | {f"volume_ratio_{s}": ratio(b.now("base_volume"), b.mean("base_volume", n(s))) for s in (60, 300, 900)}
    f |= {"log_trades": b.log1p(b.now("trade_count")), "trade_ratio_900": ratio(b.now("trade_count"), b.mean("trade_count", n(900))), "trade_gap": (b.now("trade_close") / close - 1) * 10_000}
    f |= {"delay_p50": b.now("delay_p50"), "delay_p99": b.now("delay_p99"), "delay_ratio_60": ratio(b.now("delay_p99"), b.mean("delay_p99", n(60)))}
    f |= {f"efficiency_{s}": ratio(b.abs(total[s]), b.sum("move", n(s))) for s in (60, 300, 900, 3_600)}
    f |= {f"drift_{s}": ratio(total[s], spread_of[s] * math.sqrt(n(s))) for s in (60, 300, 900, 1_800, 3_600)}
    f |= {f"volatility_ratio_{a}_{z}": ratio(spread_of[a], spread_of[z]) for a, z in ((10, 300), (60, 900), (300, 3_600), (900, 3_600))}
    f |= {"spread_to_volatility": ratio(b.now("spread"), spread_of[10] * 10_000), "ofi_trade": b.now("ofi") * b.now("trade_imbalance"), "quotes_to_trades": b.log1p(b.now("quote_updates")) - b.log1p(b.now("trade_count"))}
    f["place_in_range"] = b.where(high > low, 2 * (close - low) / b.most(high - low, LEAST) - 1, 0.0)
    for name, period, shift in (("day", 86_400, 0), ("eight", 28_800, 0), ("week", 604_800, 3 * 86_400)):
        phase = ((b.seconds(open_time) + shift) % period) * (2 * math.pi / period)
        f |= {f"{name}_sin": b.sin(phase), f"{name}_cos": b.cos(phase)}
    f["weekend"] = b.where((b.days(open_time) + 3) % 7 >= 5, 1.0, 0.0)
    f |= {"log_bid_depth": b.log1p(b.now("bid_quote")), "log_ask_depth": b.log1p(b.now("ask_quote"))} | {f"depth_ratio_{s}": ratio(b.now("depth_quote"), b.mean("depth_quote", n(s))) for s in (60, 300)}
    for s in (10, 60, 300):
        flow = b.sum("signed", n(s))
        pressed = b.log1p(b.abs(flow) / b.most(b.where(flow >= 0, b.now("close_ask_qty"), b.now("close_bid_qty")), LEAST))
        f[f"pressure_{s}"] = b.where(flow >= 0, pressed, -pressed)
    return f


class Columns:
    """Windows over rows in order of time; sums are differences of running sums, so a window's length costs nothing."""

    log, log1p, abs, sqrt, sin, cos = staticmethod(F.log), staticmethod(F.log1p), staticmethod(F.abs), staticmethod(F.sqrt), staticmethod(F.sin), staticmethod(F.cos)
    now = staticmethod(F.col)

    @staticmethod
    def where(test: Column, a: Any, z: Any) -> Column:
        return F.when(test, a).otherwise(z)

    @staticmethod
    def most(a: Column, z: Any) -> Column:
        return F.greatest(a, z if isinstance(z, Column) else F.lit(z))

    @staticmethod
    def seconds(t: Column) -> Column:
        return F.floor(t / 1000)

    @staticmethod
    def days(t: Column) -> Column:
        return F.floor(t / 86_400_000)

    def sum(self, c: str, k: int) -> Column:
        return F.col(f"run_{c}") - F.coalesce(F.lag(f"run_{c}", k).over(by_time()), F.lit(0.0))

    def mean(self, c: str, k: int) -> Column:
        return self.sum(c, k) / k

    def max(self, c: str, k: int) -> Column:
        return F.max(c).over(frame(k))

    def min(self, c: str, k: int) -> Column:
        return F.min(c).over(frame(k))

    def back(self, c: str, k: int) -> Column:
        return F.lag(c, k).over(by_time())


class Ring:
    """The same over arrays of a ring of rows, the newest last."""

    log, log1p, abs, sqrt, sin, cos = staticmethod(np.log), staticmethod(np.log1p), staticmethod(np.abs), staticmethod(np.sqrt), staticmethod(np.sin), staticmethod(np.cos)
    where, most = staticmethod(np.where), staticmethod(np.maximum)

    def __init__(self, rows: dict[str, np.ndarray]):
        self.rows = derived(lambda c: rows[c][1:], lambda c: rows[c][:-1], self)

    @staticmethod
    def seconds(t: int) -> int:
        return t // 1000

    @staticmethod
    def days(t: int) -> int:
        return t // 86_400_000

    def now(self, c: str) -> float:
        return self.rows[c][-1]

    def back(self, c: str, k: int) -> float:
        return self.rows[c][-1 - k] if k < len(self.rows[c]) else np.nan

    def sum(self, c: str, k: int) -> float:
        return self.rows[c][-k:].sum()

    def mean(self, c: str, k: int) -> float:
        return self.rows[c][-k:].mean()

    def max(self, c: str, k: int) -> float:
        return self.rows[c][-k:].max()

    def min(self, c: str, k: int) -> float:
        return self.rows[c][-k:].min()


NAMES = tuple(features(Ring({c: np.ones(3_602) for c in COLUMNS}), 0, 1))


def ring_features(rows: dict[str, np.ndarray], open_time: int, unit: int) -> list[float]:
    """Features of the newest of ``required`` rows without a gap, in the order of ``NAMES``."""
    return [float(v) for v in features(Ring(rows), open_time, unit).values()]


def microstructure_features(seconds: DataFrame, step: int = 1000, unit: int = 1, cadence: int = 5) -> DataFrame:
    """(symbol, open_time, decision_time, features) of each row that has them.

    ``unit`` divides the windows, for rows of another length than a second. Rows without a symbol or a time, and of one
    symbol and time all but one (the least by its columns), take no part; the rest are dealt out by (symbol, stretch of
    time) with the rows that their windows reach into.
    """
    need = required(unit)
    good = seconds.where("symbol is not null and open_time is not null").select("symbol", "open_time", *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    one = good.groupBy("symbol", "open_time").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("symbol", "open_time", "x.*")
    rows = chunked(one, need + 1, step=step)
    keys = ["symbol", "open_time", "__own", "__chunk"]
    series = derived(F.col, lambda c: F.lag(c).over(by_time()), Columns)
    rows = rows.select(*keys, *[v.alias(k) for k, v in series.items()], (F.lag("open_time", need - 1).over(by_time()) == F.col("open_time") - (need - 1) * step).alias("__whole"))
    rows = rows.withColumns({f"run_{c}": F.sum(F.coalesce(c, F.lit(0.0))).over(by_time().rowsBetween(Window.unboundedPreceding, 0)) for c in SUMMED})
    told = rows.select(*keys, "__whole", *[v.alias(k) for k, v in features(Columns(), F.col("open_time"), unit).items()])
    decided = F.col("open_time") + step
    out = own(told.where("__whole")).withColumn("decision_time", decided)
    return out.where(F.floor(F.col("decision_time") / step) % cadence == 0).select("symbol", "open_time", "decision_time", *NAMES)
