"""Microstructure features: stream equals batch, gaps, late and repeated rows, the future changes nothing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import microstructure
from tidemark.operators.microstructure import COLUMNS, NAMES
from tidemark.streaming.ring import stream_features

UNIT, STEP, BASE = 400, 1000, 1_000_000  # windows of up to 9 rows


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out, price = [], {"a": 100.0, "b": 50.0}
    for i in range(70):
        for k in "ab":
            if (k, i) in (("a", 30), ("b", 12), ("b", 13)):
                continue  # gaps
            price[k] *= 1 + r.choice((0.0, r.gauss(0, 0.001)))
            p = price[k]
            v = {c: r.uniform(0.5, 5) for c in COLUMNS} | {"close": p, "high": p * 1.001, "low": p * 0.999, "close_bid": round(p - 0.01, 2), "close_ask": round(p + 0.01, 2), "trade_close": p}
            out.append((k, BASE + i * STEP, *[v[c] for c in COLUMNS]))
    return out


@pytest.fixture(scope="module")
def schema():
    return "symbol string, open_time long, " + ", ".join(f"{c} double" for c in COLUMNS)


def told(df):
    return {(r["symbol"], r["open_time"]): [r[c] for c in NAMES] for r in df.collect()}


def alike(a, b):
    return a.keys() == b.keys() and all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-7) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_stream_gives_what_batch_gives(spark, rows, schema, tmp_path):
    """Out of order inside the delay, repeated, late by far, and with keys or times missing."""
    batch = told(microstructure.microstructure_features(spark.createDataFrame(rows, schema), STEP, UNIT, 2))
    need = microstructure.required(UNIT)
    assert need == 10 and all(t % (2 * STEP) == STEP for _, t in batch)
    assert {k for k in batch if k[0] == "a"} == {("a", BASE + t * STEP) for t in range(70) if t % 2 and (9 <= t < 30 or t >= 40)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        r, arrived = random.Random(1), sorted(rows, key=lambda x: x[1])
        swapped = [x for i in range(0, len(arrived), 6) for x in r.sample(arrived[i : i + 6], len(arrived[i : i + 6]))]
        parts = [swapped[i : i + 28] for i in range(0, len(swapped), 28)]
        wrong = tuple(v * 9 for v in rows[0][2:])
        parts[1] += parts[0][:5] + [(None, BASE + 5_000, *wrong), ("a", None, *wrong)]  # repeated; no symbol, no time
        parts[3] += [("a", BASE + 2_000, *wrong), ("b", BASE + 4_000, *wrong)]  # later than settled
        parts.append([("z", 10_000_000, *wrong)])  # what comes much later settles the rest
        where = str(tmp_path / "rows")
        for p in parts:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
        query = stream_features(stream, STEP, UNIT, 2, "6 seconds").writeStream.format("memory").queryName("ring_out").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = told(spark.table("ring_out"))
        assert sorted(got) == sorted(batch)
        assert alike(got, batch), [(k, n, x, y) for k in batch for n, x, y in zip(NAMES, got[k], batch[k], strict=True) if not math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-7)][:5]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_future_and_odd_rows_change_nothing(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    before = told(microstructure.microstructure_features(df, STEP, UNIT, 1).where("open_time <= 1040000"))
    later = df.withColumns({c: F.when(F.col("open_time") > 1_040_000, 1.0).otherwise(F.col(c)) for c in COLUMNS})
    odd = spark.createDataFrame([(None, 1000, *rows[0][2:]), ("a", None, *rows[0][2:])], schema)
    assert alike(told(microstructure.microstructure_features(later.union(odd).union(df.where("open_time <= 1040000")), STEP, UNIT, 1).where("open_time <= 1040000")), before)
    assert microstructure.microstructure_features(df.limit(0), STEP, UNIT, 1).count() == 0


def test_trades_are_known_a_second_late(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    a = told(microstructure.microstructure_features(df, STEP, UNIT, 1))
    at = ("a", 1_020_000)
    changed = df.withColumns({c: F.when((F.col("symbol") == "a") & (F.col("open_time") == 1_020_000), 777.0).otherwise(F.col(c)) for c in microstructure.TRADE})
    b = told(microstructure.microstructure_features(changed, STEP, UNIT, 1))
    assert alike({at: a[at]}, {at: b[at]}) and not alike({("a", 1_021_000): a["a", 1_021_000]}, {("a", 1_021_000): b["a", 1_021_000]})
