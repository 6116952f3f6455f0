"""Microstructure features of a stream: a ring of the last rows a symbol, settled in order by the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.microstructure import COLUMNS, NAMES, required, ring_features

ROW = "open_time long, " + ", ".join(f"{c} double" for c in COLUMNS)
OUT = "symbol string, open_time long, decision_time long, " + ", ".join(f"{c} double" for c in NAMES)


class RingFeatures(StatefulProcessor):
    """Holds rows back until the watermark passes them, then takes them in order; a gap empties the ring.

    Rows at or before the last one taken are late and dropped; of rows of one time the least by its columns counts, as in batch.
    A timer a row settles what no later row of the symbol would.
    """

    def __init__(self, step: int, unit: int, cadence: int):
        self.step, self.unit, self.cadence = step, unit, cadence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.ring = handle.getListState("ring", ROW)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ring = list(self.ring.get())
        last = ring[-1][0] if ring else -(1 << 62)
        fresh = []
        for part in rows:
            for r in part[["open_time", *COLUMNS]].itertuples(index=False):
                if r[0] > last:
                    fresh.append((int(r[0]), *map(float, r[1:])))
        if fresh:
            self.waiting.appendList(fresh)
            for t in {r[0] for r in fresh}:
                self.handle.registerTimer(t + self.step)
        yield from self._settle(key, ring, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, list(self.ring.get()), timerValues.getCurrentWatermarkInMs())

    def _settle(self, key: Any, ring: list, watermark: int) -> Iterator[pd.DataFrame]:
        """Takes the waiting rows whose second lies before the watermark."""
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if r[0] + self.step <= watermark]
        if not ready:
            return
        need, out = required(self.unit), []
        for r in ready:
            if ring and r[0] <= ring[-1][0]:
                continue
            if ring and r[0] != ring[-1][0] + self.step:
                ring = []
            ring.append(r)
            ring = ring[-need:]
            if len(ring) == need and (r[0] + self.step) // self.step % self.cadence == 0:
                columns = np.array([x[1:] for x in ring], float)
                out.append((key[0], r[0], r[0] + self.step, *ring_features({c: columns[:, i] for i, c in enumerate(COLUMNS)}, r[0], self.unit)))
        left = held[len(ready) :]
        self.waiting.put(left) if left else self.waiting.clear()
        self.ring.put([tuple(x) for x in ring])
        if out:
            yield pd.DataFrame(out, columns=["symbol", "open_time", "decision_time", *NAMES])

    def close(self) -> None:
        pass


def stream_features(seconds: DataFrame, step: int = 1000, unit: int = 1, cadence: int = 5, delay: str = "250 milliseconds") -> DataFrame:
    """The rows that ``microstructure_features`` gives, as a stream settles them; needs the RocksDB state store."""
    timed = seconds.where("symbol is not null and open_time is not null").select("symbol", "open_time", *[F.col(c).cast("double").alias(c) for c in COLUMNS], F.timestamp_millis("open_time").alias("ts"))
    return timed.withWatermark("ts", delay).groupBy("symbol").transformWithStateInPandas(RingFeatures(step, unit, cadence), OUT, "Append", "EventTime")
