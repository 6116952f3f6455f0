"""Operators whose state outlives a batch: late rows, paired lanes, books, decayed flow and silent feeds.

Each keeps a few numbers (a book: its levels) for a key in the state store; rows of a key are taken in order of arrival
inside a batch, and the watermark or a timer lets state go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def late_rows(rows: DataFrame, step_ms: int, delay_ms: int) -> DataFrame:
    """Each row (symbol, id, t, arrival) with whether its step was closed when it came.

    A step is closed once a row ``delay_ms`` beyond its end has been seen for the symbol.
    """

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = state.get[0] if state.exists else -(2**62)
        out = []
        for r in pd.concat(list(batches)).sort_values(["arrival", "id"]).itertuples():
            late = r.t < closed
            out.append((key[0], r.id, r.t, late))
            closed = max(closed, (r.t - delay_ms) // step_ms * step_ms)
        state.update((closed,))
        yield pd.DataFrame(out, columns=["symbol", "id", "t", "late"])

    return rows.groupBy("symbol").applyInPandasWithState(mark, "symbol string, id long, t long, late boolean", "closed long", "append", GroupStateTimeout.NoTimeout)


def redundant_union(lanes: DataFrame, window_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Each message (message, lane, received) once: as soon as its second lane brings it, or alone when the window is over."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            first, _ = state.get
            out.append((key[0], first, False, None))
            state.remove()
        else:
            held = state.get if state.exists else None
            for r in pd.concat(list(batches)).sort_values(["received", "lane"]).itertuples():
                if held and held[1] != r.lane and r.received - held[0] <= window_ms:
                    out.append((key[0], held[0], True, int(r.received - held[0])))
                    held = None
                else:
                    if held:
                        out.append((key[0], held[0], False, None))
                    held = (int(r.received), r.lane)
            if held:
                state.update(held)
                state.setTimeoutTimestamp(max(held[0] + window_ms, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["message", "received", "paired", "lane_gap"]).astype({"received": "int64", "paired": "bool", "lane_gap": "Int64"})

    timed = lanes.withColumn("ts", F.timestamp_millis("received")).withWatermark("ts", delay)
    return timed.groupBy("message").applyInPandasWithState(pair, "message string, received long, paired boolean, lane_gap long", "received long, lane string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_book(feed: DataFrame) -> DataFrame:
    """Best prices after each update of a feed of snapshots and changes; nothing from a gap to the next snapshot."""

    def replay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, good, bids, asks = (state.get[0], state.get[1], dict(state.get[2]), dict(state.get[3])) if state.exists else (None, False, {}, {})
        out = []
        for r in pd.concat(list(batches)).sort_values(["event_ms", "update_id"]).itertuples():
            good = bool(r.snapshot) or (good and r.previous_id == last)
            last = int(r.update_id)
            if not good:
                continue
            for held, changes in ((bids, r.bids), (asks, r.asks)):
                if r.snapshot:
                    held.clear()
                for level in changes:
                    held[float(level["price"])] = float(level["qty"])
                for price in [p for p, q in held.items() if q <= 0]:
                    del held[price]
            out.append((key[0], last, max(bids, default=None), min(asks, default=None), sum(bids.values()), sum(asks.values())))
        state.update((last, good, list(bids.items()), list(asks.items())))
        yield pd.DataFrame(out, columns=["symbol", "update_id", "best_bid", "best_ask", "bid_depth", "ask_depth"])

    side = "array<struct<price: double, qty: double>>"
    return feed.groupBy("symbol").applyInPandasWithState(replay, "symbol string, update_id long, best_bid double, best_ask double, bid_depth double, ask_depth double", f"last long, good boolean, bids {side}, asks {side}", "append", GroupStateTimeout.NoTimeout)


def decay_state(trades: DataFrame, half_life: int, gap: int) -> DataFrame:
    """Decayed count, notional and signed notional after each trade, from zero after a silence longer than ``gap``."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n, notional, signed = state.get if state.exists else (None, 0.0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["t", "id"]).itertuples():
            keep = 0.0 if at is None or r.t - at > gap else 2.0 ** (-(r.t - at) / half_life)
            quote = r.price * r.qty
            at, n, notional, signed = int(r.t), n * keep + 1, notional * keep + quote, signed * keep + (-quote if r.buyer_is_maker else quote)
            out.append((r.id, n, notional, signed))
        state.update((at, n, notional, signed))
        yield pd.DataFrame(out, columns=["id", "n", "notional", "signed"])

    return trades.groupBy("symbol").applyInPandasWithState(fold, "id long, n double, notional double, signed double", "at long, n double, notional double, signed double", "append", GroupStateTimeout.NoTimeout)


def feed_gaps(rows: DataFrame, limit_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Silences of a feed longer than the limit: from the last row to the next, or open (null) once the watermark is past."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], last, None))
            state.update((last,))
        else:
            for t in sorted(pd.concat(list(batches))["t"]):
                if last is not None and t - last > limit_ms:
                    out.append((key[0], last, int(t)))
                last = int(t) if last is None else max(last, int(t))
            state.update((last,))
            state.setTimeoutTimestamp(max(last + limit_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["symbol", "since", "until"]).astype({"since": "Int64", "until": "Int64"})

    timed = rows.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", delay)
    return timed.groupBy("symbol").applyInPandasWithState(watch, "symbol string, since long, until long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
