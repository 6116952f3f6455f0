"""Every query that has SQL against DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    result = con.sql(registry.oracle_sql()[name])
    assert sorted(result.columns) == names

    def ordered(rows):
        return sorted(rows, key=lambda r: [(x is not None, round(x, 4) if isinstance(x, float) else x) for x in r])

    got = ordered(tuple(r[n] for n in names) for r in df.collect())
    at = [result.columns.index(n) for n in names]
    want = ordered(tuple(r[i] for i in at) for r in result.fetchall())
    assert len(got) == len(want) and got
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not bad, bad[:3]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_asof_causality(spark):
    """Changing what comes later changes nothing before."""
    from tidemark.operators.asof import asof_join

    left = spark.createDataFrame([(i, "a", i * 1000) for i in range(50)], "id long, symbol string, t long")
    right = [(i, "a", i * 1700 + 300, float(i)) for i in range(30)]
    schema = "uid long, symbol string, rt long, v double"
    one = asof_join(left, spark.createDataFrame(right, schema), "symbol", "t", "rt", "uid", bucket_ms=5000)
    changed = [(a, b, c, d if c <= 20_000 else -1.0) for a, b, c, d in right]
    two = asof_join(left, spark.createDataFrame(changed, schema), "symbol", "t", "rt", "uid", bucket_ms=5000)
    early = "t <= 20000"
    assert sorted(map(tuple, one.where(early).collect())) == sorted(map(tuple, two.where(early).collect()))
    want = {i: max((u for u, _, rt, _ in right if rt <= i * 1000), default=None) for i in range(50)}
    assert {r["id"]: r["r_uid"] for r in one.collect()} == want
