import math

from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators.replay import nonoverlap_select
from tidemark.sources import ingest, views
from tidemark.streaming.bars import stream_trade_bars

SF = "/root/testdata/sf0.001"


def test_lenient_readers(spark, tmp_path):
    (tmp_path / "k.csv").write_text("1000,1,2,0.5,1.5,10,1999,15,3,1,2\n2000,1,2,x,1.5,10,2999\n3000,1,2,0.5,1.5,10,3999\n4000,1\n")
    rows = sorted(map(tuple, ingest.read_klines(spark, str(tmp_path / "k.csv")).select("open_time", "close", "trade_count").collect()))
    assert rows == [(1000, 1.5, 3.0), (3000, 1.5, 0.0)]
    (tmp_path / "t.csv").write_text("1,10,1,5,6,1700000000000000,True,true\n-1,10,1,5,6,1,true,true\n2,10,0,5,6,1,true,true\n3,10,1,6,5,1,false,true\n4,9,2,7,7,1700000000001,false\nid,price,qty,a,b,t,m,x\n")
    rows = sorted(map(tuple, ingest.read_agg_trades(spark, str(tmp_path / "t.csv")).select("id", "t", "buyer_is_maker").collect()))
    assert rows == [(1, 1700000000000, True), (4, 1700000000001, False)]


def test_upsert_and_append(spark):
    old = spark.createDataFrame([("a", 1, 1.0, 5), ("a", 2, 2.0, 5)], "symbol string, open_time long, close double, seen long")
    new = spark.createDataFrame([("a", 2, 3.0, 4), ("a", 2, 4.0, 6), ("b", 1, 9.0, 1)], old.schema)
    assert sorted((r[0], r[1], r[2]) for r in ingest.upsert(old, new, ["symbol", "open_time"], "seen").collect()) == [("a", 1, 1.0), ("a", 2, 4.0), ("b", 1, 9.0)]
    schema = "kind string, source string, observed_at long, payload string"
    seen = spark.createDataFrame([("k", "s", 1, "x")], schema)
    fresh = spark.createDataFrame([("k", "s", 1, "x"), ("k", "s", 1, "y"), ("k", "s", 1, "y")], schema)
    assert [r["payload"] for r in ingest.append_observations(seen, fresh).collect()] == ["y"]


def test_book_walk(spark):
    df = spark.sql("SELECT array(named_struct('price', 10.0D, 'qty', 1.0D), named_struct('price', 11.0D, 'qty', 2.0D)) AS asks")
    row = df.select(book.walk(F.col("asks"), F.lit(2.0)).alias("a"), book.walk(F.col("asks"), F.lit(4.0)).alias("b"), book.depth(F.col("asks"), 1).alias("d")).first()
    assert math.isclose(row["a"], 10.5) and row["b"] is None and row["d"] == 1.0


def test_nonoverlap_matches_a_loop(spark):
    rows = sorted((r["symbol"], r["t"], r["id"]) for r in views.trades(spark, SF).collect())
    want, last = set(), {}
    for s, t, i in rows:
        key = (s, t // 86_400_000)
        if t >= last.get(key, -1):
            want.add(i)
            last[key] = t + 3_600_000
    assert {r["id"] for r in nonoverlap_select(views.trades(spark, SF), 3_600_000).collect()} == want


def test_stream_bars_match_batch(spark, tmp_path):
    from tidemark.operators.bars import trade_bars

    trades = views.trades(spark, SF)
    ends = trades.agg(F.max("t")).first()[0]
    trades.repartitionByRange(4, "t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in"))
    query = stream_trade_bars(stream, "1 hour", "40 days").writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["symbol"], r["open_time"]): (r["open"], r["close"], r["trade_count"]) for r in spark.table("bars_out").collect()}
    want = {(r["symbol"], r["open_time"]): (r["open"], r["close"], r["trade_count"]) for r in trade_bars(trades, 3_600_000).collect()}
    assert got == want and ends


def test_chunks_change_nothing(spark, monkeypatch):
    """Rolling features are the same whether a symbol is one stretch of time or many."""
    from tidemark.operators import features, labels
    from tidemark.plans.base import dense

    def results():
        bars = dense(spark, SF)
        made = [features.atr(bars), features.rsi(bars), features.ema_truncated(bars, 6), features.flow_windows(bars, (3, 12)), features.next_return(bars), labels.triple_barrier(bars, 12, 0.2, 0.3)]
        return [sorted(map(str, (tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()))) for df in made]

    whole = results()
    monkeypatch.setattr(features, "CHUNK_ROWS", 1)
    assert results() == whole


def test_ranks_over_ranges_match_a_loop(spark):
    from tidemark.operators import ranks

    values = [(i * 7919) % 997 / 10 for i in range(3000)] + [5.0] * 500
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    order = sorted(values)
    first, count = {}, {}
    for i, v in enumerate(order):
        first.setdefault(v, i)
        count[v] = count.get(v, 0) + 1
    got = {r["id"]: r["rank"] for r in ranks.average_rank(df, "v").collect()}
    assert all(got[i] == first[v] + (count[v] + 1) / 2 for i, v in enumerate(values))


def test_running_sum_over_buckets(spark):
    from tidemark.operators.asof import running_sum

    rows = [("a" if i % 3 else "b", i * 37 % 1000, i, float(i)) for i in range(200)]
    got = {r["id"]: r["s"] for r in running_sum(spark.createDataFrame(rows, "symbol string, t long, id long, v double"), "symbol", "t", "id", "v", bucket_ms=50).collect()}
    for k, t, i, _ in rows:
        assert got[i] == sum(v for q, u, j, v in rows if q == k and (u, j) <= (t, i))


def _stream(spark, df, tmp_path):
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_repeats_sessions_and_windows(spark, tmp_path):
    from tidemark.streaming import events

    trades = views.trades(spark, SF)
    twice = trades.unionByName(trades.where("id % 4 = 0"))
    once = _run(events.drop_repeats(_stream(spark, twice, tmp_path / "a"), ["id"], "60 days"), "once", "append")
    assert once.count() == once.select("id").distinct().count() == trades.count()
    gap = 6 * 3_600_000
    got = sorted((r["symbol"], r["first_t"], r["last_t"], r["n"]) for r in _run(events.sessions(_stream(spark, trades, tmp_path / "b"), "6 hours", "60 days"), "sess", "complete").collect())
    want, rows = [], sorted((r["symbol"], r["t"]) for r in trades.collect())
    for s, t in rows:
        if want and want[-1][0] == s and t - want[-1][2] < gap:
            want[-1][2:] = [t, want[-1][3] + 1]
        else:
            want.append([s, t, t, 1])
    assert got == [tuple(w) for w in want]
    slid = _run(events.sliding_flow(_stream(spark, trades, tmp_path / "c"), "2 hours", "1 hour", "60 days"), "slid", "complete")
    assert slid.agg(F.sum("n")).first()[0] == 2 * trades.count()


def test_stream_append_is_idempotent(spark, tmp_path):
    from tidemark.streaming.events import observations_sink

    write, batch = observations_sink(spark, str(tmp_path / "obs")), views.observations(spark, SF)
    write(batch.where("id % 2 = 0"), 0)
    write(batch.where("id % 2 = 0"), 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "obs")).count() == batch.dropDuplicates(["kind", "source", "observed_at", "payload"]).count()


def test_ridge_matches_numpy(spark):
    import numpy as np

    from tidemark.operators.models import ridge

    rows = views.predictions(spark, SF).select("p", "weight", F.col("y").cast("double").alias("y"))
    got = ridge(rows, ["p", "weight"], "y", 3.0)
    data = np.array([tuple(r) for r in rows.collect()], float)
    x = (data[:, :2] - data[:, :2].mean(0)) / data[:, :2].std(0)
    want = np.linalg.solve(x.T @ x + 3.0 * np.eye(2), x.T @ (data[:, 2] - data[:, 2].mean()))
    assert math.isclose(got["p"], want[0], rel_tol=1e-6) and math.isclose(got["weight"], want[1], rel_tol=1e-6)
    assert ridge(rows.where("false"), ["p"], "y", 1.0) == {"p": 0.0, "intercept": 0.0}
