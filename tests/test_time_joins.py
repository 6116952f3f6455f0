"""Point-in-time joins on rows without key or time, with ties and repeated rows, against DuckDB."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import asof

KEYS, TIMES = st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 60))
ROWS = st.lists(st.tuples(KEYS, TIMES, st.integers(0, 5)), max_size=14)
EACH = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frames(spark, left, right):
    l = [(k, t, i % 4) for i, (k, t, _) in enumerate(left)]
    l += l[:2]  # repeated rows
    r = [(k, t, i, float(v) if v else None) for i, (k, t, v) in enumerate(right)]
    c = duckdb.connect()
    for name, rows, cols in (("l", l, "symbol VARCHAR, t BIGINT, x INT"), ("r", r, "symbol VARCHAR, t BIGINT, id BIGINT, v DOUBLE")):
        c.sql(f"CREATE TABLE {name} ({cols})")
        if rows:
            c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return spark.createDataFrame(l, "symbol string, t long, x int"), spark.createDataFrame(r, "symbol string, t long, id long, v double"), c


def alike(df, c, sql, columns):
    got = sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr)
    assert got == sorted(c.sql(sql).fetchall(), key=repr)


@EACH
@given(ROWS, ROWS)
def test_asof_with_nulls(spark, left, right):
    a, b, c = frames(spark, left, right)
    last = "SELECT l.symbol, l.t, l.x, (SELECT r.id FROM r WHERE r.symbol = l.symbol AND r.t {} l.t ORDER BY r.t {}, r.id {} LIMIT 1) FROM l"
    alike(asof.asof_join(a, b, "symbol", "t", "t", "id", bucket_ms=16), c, last.format("<=", "DESC", "DESC"), ["symbol", "t", "x", "r_id"])
    alike(asof.asof_forward(a, b, "symbol", "t", "t", "id", bucket_ms=16), c, last.format(">=", "", ""), ["symbol", "t", "x", "r_id"])


@EACH
@given(ROWS)
def test_neighbours_and_running_sums_with_nulls(spark, right):
    _, b, c = frames(spark, [], right)
    known = "symbol IS NOT NULL AND t IS NOT NULL"
    near = f"SELECT id, CASE WHEN {known} THEN {{}}(id) OVER (PARTITION BY symbol, {known} ORDER BY t, id) END FROM r"
    alike(asof.neighbour(b, "symbol", "t", "id", ["id"], "p_", bucket_ms=16), c, near.format("lag"), ["id", "p_id"])
    alike(asof.neighbour(b, "symbol", "t", "id", ["id"], "p_", ahead=True, bucket_ms=16), c, near.format("lead"), ["id", "p_id"])
    run = f"SELECT id, v, CASE WHEN {known} THEN sum(v) OVER (PARTITION BY symbol, {known} ORDER BY t, id) END FROM r"
    alike(asof.running_sum(b, "symbol", "t", "id", "v", bucket_ms=16), c, run, ["id", "v", "s"])


@EACH
@given(ROWS)
def test_last_known_with_nulls(spark, right):
    _, b, c = frames(spark, [], [(k, None if t is None else 10 * i + t, v) for i, (k, t, v) in enumerate(right)])
    known = "symbol IS NOT NULL AND t IS NOT NULL"
    one = b.groupBy("symbol", "t").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    c.sql("CREATE VIEW o AS SELECT symbol, t, max(v) AS v FROM r GROUP BY 1, 2")
    want = f"SELECT symbol, t, CASE WHEN {known} THEN last_value(v IGNORE NULLS) OVER (PARTITION BY symbol, {known} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE v END FROM o"
    alike(asof.last_known(one, "symbol", "t", ["v"], bucket_ms=16), c, want, ["symbol", "t", "v"])


@EACH
@given(ROWS, ROWS, st.integers(1, 30))
def test_sums_between_times_with_nulls(spark, left, right, span):
    a, b, c = frames(spark, left, right)
    total = "(SELECT coalesce(sum(v), 0) FROM r WHERE r.symbol = l.symbol AND r.t > l.{} AND r.t <= l.{})"
    c.sql(f"CREATE VIEW w AS SELECT symbol, t - {span} AS lo, CASE WHEN x < 3 THEN t END AS hi FROM l")
    both = "symbol IS NULL OR lo IS NULL OR hi IS NULL"
    want = f"SELECT symbol, lo, hi, CASE WHEN {both} THEN NULL ELSE {total.format('lo', 'hi')} END FROM w AS l"
    asked = a.selectExpr("symbol", f"t - {span} AS lo", "CASE WHEN x < 3 THEN t END AS hi")
    alike(asof.interval_sum(asked, b, "lo", "hi", "v"), c, want, ["symbol", "lo", "hi", "between"])
    grid = a.selectExpr("symbol", "t AS open_time")
    c.sql(f"CREATE VIEW g AS SELECT symbol, t - {span} AS lo, t AS open_time FROM l")
    want = f"SELECT symbol, open_time, CASE WHEN symbol IS NULL OR open_time IS NULL THEN NULL ELSE {total.format('lo', 'open_time')} END FROM g AS l"
    alike(asof.trailing_event_sum(grid, b, span, "v"), c, want, ["symbol", "open_time", "trailing"])


def test_named_cases(spark):
    """One null time on the right is nobody's match; one null bound gives one row with a null sum."""
    left = spark.createDataFrame([("a", 5), ("a", None), (None, 5), ("a", None)], "symbol string, t long")
    right = spark.createDataFrame([("a", None, 1, 9.0)], "symbol string, t long, id long, v double")
    assert [r["r_v"] for r in asof.asof_join(left, right, "symbol", "t", "t", "id").collect()] == [None] * 4
    bounds = spark.createDataFrame([("a", None, 7), ("a", 1, 7), ("a", None, None), (None, 1, 7)], "symbol string, lo long, hi long")
    events = spark.createDataFrame([("a", 3, 2.0), ("a", None, 5.0)], "symbol string, t long, v double")
    got = asof.interval_sum(bounds, events, "lo", "hi", "v").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([("a", None, 7, None), ("a", 1, 7, 2.0), ("a", None, None, None), (None, 1, 7, None)], key=repr)
