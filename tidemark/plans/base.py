"""What the plan modules share: hourly bars over the tables, rounding, and the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators import bars
from tidemark.sources import views

HOUR = 3_600_000
DAY = 24 * HOUR
#: Added to means of short decimals before rounding, so that an exact tie rounds alike on both sides.
TIE = 1e-9
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.trade_bars(views.trades(spark, sf_dir), HOUR)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.fill_bars(hourly(spark, sf_dir), HOUR)


V = views.SQL
DENSE = (
    V
    + """, ends AS (SELECT symbol, min(open_time) a, max(open_time) b FROM v_bars GROUP BY 1),
spine AS (SELECT symbol, unnest(generate_series(a, b, 3600000)) AS open_time FROM ends),
held AS (SELECT s.symbol, s.open_time, open, high, low, close, volume, quote_volume, trade_count, buy_volume, buy_quote_volume,
    last_value(close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY s.open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior
  FROM spine s LEFT JOIN v_bars b ON b.symbol = s.symbol AND b.open_time = s.open_time),
dense AS (SELECT symbol, open_time, coalesce(open, prior) AS open, coalesce(high, prior) AS high, coalesce(low, prior) AS low, coalesce(close, prior) AS close,
    coalesce(volume, 0) AS volume, coalesce(quote_volume, 0) AS quote_volume, coalesce(trade_count, 0) AS trade_count, coalesce(buy_volume, 0) AS buy_volume, coalesce(buy_quote_volume, 0) AS buy_quote_volume FROM held)
"""
)
BY = "(PARTITION BY symbol ORDER BY open_time)"


def frame_sql(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rounds(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)
