"""Positions held by a rule with memory: they change only against a cost hurdle and end at a greatest age.

What the rule does to a position over a stretch of time is a map from the state at its start to the state at its end. Maps
are made for each stretch apart, composed over one row a stretch, and every stretch is then played from the state in which
it really starts. So a symbol's history is as many tasks as it has stretches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons of a change, by number.
ENTER, LEAVE, REVERSE, EXPIRE = 1, 2, 3, 4


def _next(position: np.ndarray, age: np.ndarray, forecast: float, long_only: bool, hurdle: float, oldest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, ages and reasons after a step, for several states at once."""
    wanted = (1 if forecast > 0 else 0) if long_only else int(np.sign(forecast))
    expired = (position != 0) & (age >= oldest)
    moves = ~expired & (position != wanted) & (abs(forecast) > hurdle * np.abs(wanted - position))
    after = np.where(expired, 0, np.where(moves, wanted, position))
    reason = np.where(expired, EXPIRE, np.where(moves, np.where(position == 0, ENTER, LEAVE if wanted == 0 else REVERSE), 0))
    aged = np.where(after == 0, 0, np.where(after == position, age + 1, 1))
    return after, aged, reason


def _states(oldest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ages by state number: flat, then long and short of each age."""
    ages = np.arange(1, oldest + 1)
    return np.r_[0, np.ones(oldest, int), -np.ones(oldest, int)], np.r_[0, ages, ages]


def _number(position: np.ndarray, age: np.ndarray, oldest: int) -> np.ndarray:
    return np.where(position == 0, 0, np.where(position > 0, age, oldest + age))


def stateful_turnover(rows: DataFrame, key: list[str], t: str, forecast: str, target: str, cost: str, long_only: str, oldest: int = 24, multiple: float = 2.0, stretch: int = 4096 * 3_600_000) -> DataFrame:
    """Each row with the position taken at it: ``position``, ``age``, ``units`` traded, ``reason``, ``held`` (how long a
    position that ended had lasted) and ``net`` = position * target - cost * units.

    A position ends once it is ``oldest`` rows old; otherwise it changes to the forecast's sign (never below 0 where
    ``long_only``) only if the forecast exceeds ``multiple`` * cost for each unit of change. What is still held at a key's
    last row is closed there, at cost. Rows without a time or with a null in the key take no part; a null or NaN forecast
    or target counts as 0. Rows of one key have times of their own; of equal ones the order is by forecast.
    """
    number = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double")) for c in (forecast, target)}
    good = rows.dropna(subset=[*key, t, cost, long_only]).withColumns(number).withColumn("__s", F.floor(F.col(t) / stretch))
    narrow = good.select(*key, "__s", F.col(t).alias("__t"), F.col(forecast).alias("__f"), F.col(cost).cast("double").alias("__c"), F.col(long_only).alias("__l"))
    kinds, own = dict(rows.dtypes), list(rows.columns)
    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    def to_map(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__t", "__f"])
        position, age = _states(oldest)
        for f, c, only in zip(frame["__f"], frame["__c"], frame["__l"], strict=True):
            position, age, _ = _next(position, age, f, only, multiple * c, oldest)
        return pd.DataFrame([(*group, _number(position, age, oldest).tolist())], columns=[*key, "__s", "__map"])

    maps = narrow.groupBy(*key, "__s").applyInPandas(to_map, f"{keyed}, __s long, __map array<int>")
    # one row a stretch: where each starts, by following the maps of those before it
    ordered = F.array_sort(F.collect_list(F.struct("__s", "__map")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<__s:bigint,start:int,last:boolean>>").alias("starts"))
    follow = F.aggregate("__all", zero, lambda acc, m: F.struct(F.get(m["__map"], acc["at"]).alias("at"), F.concat(acc["starts"], F.array(F.struct(m["__s"].alias("__s"), acc["at"].alias("start"), (m["__s"] == F.col("__end")).alias("last")))).alias("starts")))
    starts = maps.groupBy(*key).agg(ordered.alias("__all"), F.max("__s").alias("__end")).select(*key, F.inline(follow["starts"]))

    out_columns = {"position": "int", "age": "int", "units": "double", "reason": "int", "held": "int", "net": "double"}
    played = good.join(starts.withColumnsRenamed({"start": "__start", "last": "__last"}), [*key, "__s"])
    schema = ", ".join([*(f"`{c}` {kinds[c] if c not in (forecast, target) else 'double'}" for c in own), *(f"{c} {k}" for c, k in out_columns.items())])

    def play(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([t, forecast]).reset_index(drop=True)
        positions, ages = _states(oldest)
        state = int(frame["__start"].iloc[0])
        position, age = positions[state : state + 1], ages[state : state + 1]
        made = []
        for f, y, c, only in zip(frame[forecast], frame[target], frame[cost], frame[long_only], strict=True):
            after, aged, reason = _next(position, age, f, only, multiple * float(c), oldest)
            units = float(abs(after[0] - position[0]))
            made.append([int(after[0]), int(aged[0]), units, int(reason[0]), int(age[0]) if reason[0] > ENTER else None, float(after[0] * y - float(c) * units)])
            position, age = after, aged
        if bool(frame["__last"].iloc[0]) and position[0] != 0:
            c, last = float(frame[cost].iloc[-1]), made[-1]
            last[2] += float(abs(position[0]))
            last[5] -= c * float(abs(position[0]))
            last[4] = int(age[0]) if last[4] is None else last[4]
        done = pd.DataFrame(made, columns=list(out_columns)).astype({"held": "Int64"})
        return pd.concat([frame[own], done], axis=1)

    return played.groupBy(*key, "__s").applyInPandas(play, schema)


def turnover_metrics(trace: DataFrame, by: list[str]) -> DataFrame:
    """Rows, net, traded units, changes by reason and the mean time that positions lasted, by group."""
    count: dict[str, Column] = {name: F.count_if(F.col("reason") == k) for name, k in (("entries", ENTER), ("exits", LEAVE), ("reversals", REVERSE), ("expiries", EXPIRE))}
    return trace.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("net").alias("net"), F.sum("units").alias("units"), *[c.alias(n) for n, c in count.items()], F.avg("held").alias("mean_held"), F.avg(F.abs("position")).alias("exposure"))
