import pytest
from pyspark.sql import functions as F

from tidemark.functions import factors
from tidemark.operators import asof, portfolio
from tidemark.sources import archives

DAY = 1_705_276_800_000


def test_strict_trades_and_their_audit(spark, tmp_path):
    good = f"agg_id,price,qty,first,last,time,maker,best\n1,10,1,5,6,{DAY},True,true\n2,11,1,7,7,{DAY + 5},false,true\n2,11,1,9,9,{DAY + 4},false,true,,\n"
    (tmp_path / "a.csv").write_text(good)
    rows = archives.read_agg_trades_strict(spark, str(tmp_path / "a.csv"), "spot", DAY).collect()
    assert [(r["id"], r["price"], r["buyer_is_maker"]) for r in sorted(rows)] == [(1, 10.0, True), (2, 11.0, False), (2, 11.0, False)]
    (tmp_path / "b.csv").write_text(good + f"3,0,1,8,8,{DAY},true,true\n4,1,1,8,8,{DAY + 86_400_000},true,true\nx\n5,1,1,8,8,{DAY},maybe,true\n6,1,1,8,8,{DAY}\n7,nan,1,8,8,{DAY},true,true\n")
    audit = archives.audit_trades(archives.trade_rows(spark, str(tmp_path / "b.csv"), "spot"), DAY).first()
    assert {k: audit[k] for k in ("rows", "rejected", "accepted", "outside_day", "repeated_ids", "id_regressions", "time_regressions", "missing_ids")} == {
        "rows": 8, "rejected": 4, "accepted": 4, "outside_day": 1, "repeated_ids": 1, "id_regressions": 0, "time_regressions": 1, "missing_ids": 1,
    }
    with pytest.raises(Exception, match="trade archive"):
        archives.read_agg_trades_strict(spark, str(tmp_path / "b.csv"), "spot").collect()
    (tmp_path / "f.csv").write_text(f"1,10,1,5,6,{DAY}000,true\n")
    assert archives.read_agg_trades_strict(spark, str(tmp_path / "f.csv"), "futures").first()["t"] == DAY


def test_premium_index(spark, tmp_path):
    lines = ["open_time,o,h,l,c,v,close_time", "1000,-1,2,-3,1,0,1999", "2000,1,0.5,0,0.2,0,2999", "2000,1,2,0,1,0,2999", "3000,1,x,0,1,0,3999", "4000,1,2"]
    (tmp_path / "p.csv").write_text("\n".join(lines))
    got = archives.read_premium_index(spark, str(tmp_path / "p.csv")).collect()
    assert sorted((r["open_time"], r["problem"] or "") for r in got) == [(1000, ""), (2000, "price bounds"), (2000, "time does not rise"), (3000, "bad number"), (4000, "column count")]
    marks = archives.read_premium_index(spark, str(tmp_path / "p.csv"), positive=True).where("open_time = 1000").first()
    assert marks["problem"] == "not positive"


def test_datasets_are_whole_or_not_there(spark, tmp_path):
    df = spark.range(100).withColumn("t", F.col("id") * 10)
    root = str(tmp_path / "sets")
    assert archives.load_dataset(spark, root, "k") is None
    archives.save_dataset(df, root, "k")
    again = archives.load_dataset(spark, root, "k")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert archives.slice_dataset(again, "t", 100, 200).count() == 10
    spark.range(1).withColumn("t", F.col("id")).write.mode("append").parquet(f"{root}/k/rows")
    with pytest.raises(ValueError, match="differs"):
        archives.load_dataset(spark, root, "k")
    one = archives.write_observations_csv(df, str(tmp_path / "csv"), ["id"])
    assert one == archives.write_observations_csv(df.orderBy(F.rand(1)), str(tmp_path / "csv2"), ["id"])
    assert sum(len(open(f).readlines()) for f in (tmp_path / "csv").glob("*.csv")) == 100


def test_factor_programs(spark):
    df = spark.createDataFrame([(2.0, 4.0, 0.0), (-3.0, 1.0, 5.0)], "a double, b double, c double")
    units = {"a": "bps", "b": "bps", "c": ""}
    programs = {"x": "safe_divide(a, b) + c * 2", "y": "clip(-a, -1, 1)", "z": "tanh(maximum(a, b)) - sign(c)", "w": "abs(a - b) * c"}
    got = [tuple(r[k] for k in programs) for r in factors.factor_columns(df, programs, units).orderBy("b").collect()]
    assert got[0] == pytest.approx((-3.0 + 10.0, 1.0, 0.7615941559557649 - 1, 20.0)) and got[1] == pytest.approx((0.5, -1.0, 0.999329299739067, 0.0))
    for bad in ("a * b", "a ** 2", "open('x')", "a.b", "__import__('os')", "q + 1", "clip(a, 1)", "1e9 * c", "lambda: 1", "safe_divide(c, a)"):
        with pytest.raises(ValueError):
            factors.factor(bad, units)


def test_sums_at_keep_equal_rows_and_edges(spark):
    events = spark.createDataFrame([("a", t, t, 1.0) for t in range(0, 100, 10)], "symbol string, t long, id long, v double")
    left = spark.createDataFrame([("a", 50, 20), ("a", 50, 20), ("b", 5, 0), ("a", 200, -5)], "symbol string, hi long, lo long")
    got = sorted(map(tuple, asof.interval_sum(left, events, "lo", "hi", "v").collect()))
    assert got == [("a", 50, 20, 3.0), ("a", 50, 20, 3.0), ("a", 200, -5, 10.0), ("b", 5, 0, 0.0)]


def test_runs_that_are_not_expected_are_an_error(spark):
    trades = spark.createDataFrame([(1, "x", 3), (2, "y", 1), (3, "x", 1)], "id long, run string, exit long")
    got = {r["id"]: r["place"] for r in portfolio.realization_order(trades, ["y", "x"]).collect()}
    assert got == {2: 1, 3: 2, 1: 3}
    with pytest.raises(Exception, match="not expected"):
        portfolio.realization_order(trades, ["x"]).collect()
