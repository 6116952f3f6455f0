"""The query of the tape and depth dataset, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars, tapedepth
from tidemark.operators.tapedepth import ACCELERATIONS, ALIGNMENTS, BANDS, EFFICIENCIES, FLOWS, OBSERVATIONS, RANGES, RETURNS, VOLATILITIES, VWAPS
from tidemark.plans.base import HOUR, TIE, Query, V
from tidemark.sources import views

#: Four places are told, as sums over windows are differences of running sums. Hours stand for seconds, with 900 of them for 30 rows; depth is known for 5 hours.
UNIT, DELAY, HORIZON, CADENCE, AGE = 30, 1, 4, 3, 5 * HOUR
SCALE = {"fine": 1, "near": 3, "far": 5}


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.trades(spark, sf_dir)
    bought = F.when(~F.col("buyer_is_maker"), F.col("qty")).otherwise(0.0)
    order = F.struct("t", "id")
    tape = t.groupBy("symbol", bars.bucket("t", HOUR).alias("open_time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("base_volume"),
        F.sum(F.col("price") * F.col("qty")).alias("quote_volume"), F.sum(bought).alias("buy_volume"), (F.sum("qty") - F.sum(bought)).alias("sell_volume"), F.count("*").alias("trade_count"),
    )
    cells = [c for b, k in SCALE.items() for c in ((F.col("qty") * k).alias(f"bid_{b}"), (F.col("qty") * k + F.col("id") % 7).alias(f"ask_{b}"))]
    depth = t.where("id % 2 = 0").select("symbol", F.col("t").alias("depth_time"), *cells)
    depth = depth.withColumns({f"imbalance_{b}": (F.col(f"bid_{b}") - F.col(f"ask_{b}")) / (F.col(f"bid_{b}") + F.col(f"ask_{b}")) for b in BANDS})
    depth = depth.withColumns({f"{s}_fine": F.when(F.col("depth_time") % 5 != 0, F.col(f"{s}_fine")) for s in ("bid", "ask")})
    out = tapedepth.tape_depth_dataset(tape, depth, HOUR, UNIT, DELAY, HORIZON, CADENCE, AGE)
    return out.select(*[F.round(F.col(c) + TIE, 4).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


def _w(s: int) -> str:
    return f"(PARTITION BY symbol ORDER BY h ROWS BETWEEN {max(1, s // UNIT) - 1} PRECEDING AND CURRENT ROW)"


def _sql() -> str:
    o = "(PARTITION BY symbol ORDER BY h)"
    n = lambda s: max(1, s // UNIT)
    total = lambda c, s: f"sum({c}) OVER {_w(s)}"
    zero = lambda a, d: f"coalesce({a} / nullif({d}, 0.0::DOUBLE), 0)"
    over = lambda s: f"close / lag(close, {n(s)}) OVER {o}"
    f = {f"return_{s}": f"({over(s)} - 1) * 10000" for s in RETURNS} | {f"volatility_{s}": f"stddev_samp(step) OVER {_w(s)} * 10000" for s in VOLATILITIES}
    f |= {f"range_{s}": f"(max(high) OVER {_w(s)} / min(low) OVER {_w(s)} - 1) * 10000" for s in RANGES}
    f |= {f"log_quote_volume_{s}": f"ln(1 + {total('qv', s)})" for s in FLOWS} | {f"aggressor_imbalance_{s}": zero(total("bv - sv", s), total("bs", s)) for s in FLOWS} | {f"log_trade_count_{s}": f"ln(1 + {total('tc', s)})" for s in FLOWS}
    f |= {f"vwap_deviation_{s}": f"coalesce((close / ({total('qv', s)} / nullif({total('bs', s)}, 0.0::DOUBLE)) - 1) * 10000, 0)" for s in VWAPS}
    f |= {f"efficiency_{s}": zero(f"abs(ln({over(s)}))", total("abs(step)", s)) for s in EFFICIENCIES} | {f"observation_rate_{s}": f"avg(seen::DOUBLE) OVER {_w(s)}" for s in OBSERVATIONS}
    for name, c in (("volume", "qv"), ("trade", "tc")):
        f |= {f"{name}_acceleration_{a}_{z}": f"ln((1e-9::DOUBLE + {total(c, a)} / {n(a)}) / (1e-9::DOUBLE + {total(c, z)} / {n(z)}))" for a, z in ACCELERATIONS}
    f |= {f"alignment_{s}": f"{zero(total('bv - sv', s), total('bs', s))} * ({over(s)} - 1) * 10000" for s in ALIGNMENTS}
    fresh = f"(depth_time IS NOT NULL AND h - depth_time BETWEEN 0 AND {AGE})"
    f |= {"trade_observed": "seen::DOUBLE", "trade_age": "(h - traded) / 1000", "depth_available": f"{fresh}::INT::DOUBLE", "fine_depth_available": f"({fresh} AND bid_fine IS NOT NULL AND ask_fine IS NOT NULL)::INT::DOUBLE", "depth_age": f"CASE WHEN {fresh} THEN (h - depth_time) / 1000 END"}
    f |= {f"depth_imbalance_{b}": f"CASE WHEN {fresh} THEN imbalance_{b} END" for b in BANDS} | {f"log_depth_{b}": f"CASE WHEN {fresh} THEN ln(1 + bid_{b} + ask_{b}) END" for b in BANDS}
    f |= {f"log_{s}_curve": f"CASE WHEN {fresh} THEN ln((1 + {s}_far) / (1 + {s}_fine)) END" for s in ("bid", "ask")}
    f |= {f"day_{k}": f"{k}((h // 1000 % 86400) * (2 * 3.141592653589793::DOUBLE / 86400))" for k in ("sin", "cos")} | {"weekend": "((h // 86400000 + 3) % 7 >= 5)::INT::DOUBLE"}
    cells = ", ".join(f"qty * {k} AS bid_{b}0, qty * {k} + id % 7 AS ask_{b}0, (qty * {k} - (qty * {k} + id % 7)) / (qty * {k} + (qty * {k} + id % 7)) AS imbalance_{b}" for b, k in SCALE.items())
    ahead = DELAY + HORIZON
    return (
        V
        + f""", tp AS (SELECT symbol, t // 3600000 * 3600000 AS h, arg_min(price, (t, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, id)) AS close, sum(qty) AS bs, sum(price * qty) AS qv, sum(CASE WHEN buyer_is_maker THEN 0 ELSE qty END) AS bv, sum(CASE WHEN buyer_is_maker THEN qty ELSE 0 END) AS sv, count(*) AS tc FROM v_trades GROUP BY 1, 2),
ck AS (SELECT symbol, unnest(generate_series(min(h), max(h), 3600000)) AS h FROM tp GROUP BY 1),
co AS (SELECT ck.symbol, ck.h, tp.h AS traded, tp.h = ck.h AS seen, CASE WHEN tp.h = ck.h THEN tp.high ELSE tp.close END AS high, CASE WHEN tp.h = ck.h THEN tp.low ELSE tp.close END AS low, close, CASE WHEN tp.h = ck.h THEN bs ELSE 0 END AS bs, CASE WHEN tp.h = ck.h THEN qv ELSE 0 END AS qv, CASE WHEN tp.h = ck.h THEN bv ELSE 0 END AS bv, CASE WHEN tp.h = ck.h THEN sv ELSE 0 END AS sv, CASE WHEN tp.h = ck.h THEN tc ELSE 0 END AS tc
  FROM ck ASOF LEFT JOIN tp ON tp.symbol = ck.symbol AND ck.h >= tp.h),
dp0 AS (SELECT symbol, t AS depth_time, id, {cells} FROM v_trades WHERE id % 2 = 0),
dp AS (SELECT *, CASE WHEN depth_time % 5 <> 0 THEN bid_fine0 END AS bid_fine, CASE WHEN depth_time % 5 <> 0 THEN ask_fine0 END AS ask_fine, bid_near0 AS bid_near, ask_near0 AS ask_near, bid_far0 AS bid_far, ask_far0 AS ask_far FROM dp0 QUALIFY row_number() OVER (PARTITION BY symbol, depth_time ORDER BY floor(coalesce(imbalance_near, 0) * 1e6) DESC) = 1),
sr AS (SELECT co.*, dp.* EXCLUDE (symbol, id) FROM co ASOF LEFT JOIN dp ON dp.symbol = co.symbol AND co.h >= dp.depth_time),
bs0 AS (SELECT *, ln(close / lag(close) OVER {o}) AS step, lag(h, 30) OVER {o} AS first, lead(h, {DELAY}) OVER {o} AS e, lead(h, {ahead}) OVER {o} AS x, lead(close, {DELAY}) OVER {o} AS entry_price, lead(close, {ahead}) OVER {o} AS exit_price FROM sr),
ft AS (SELECT symbol, h, first, e, x, entry_price, exit_price, {', '.join(f'{v} AS "{k}_"' for k, v in f.items())} FROM bs0)
SELECT symbol, h + 3600000 AS decision_time, h + {(DELAY + 1) * HOUR} AS entry_time, h + {(ahead + 1) * HOUR} AS exit_time, round(entry_price + 1e-9::DOUBLE, 4) AS entry_price, round(exit_price + 1e-9::DOUBLE, 4) AS exit_price, round((exit_price / entry_price - 1) * 10000 + 1e-9::DOUBLE, 4) AS gross_return, {', '.join(f'round("{k}_" + 1e-9::DOUBLE, 4) AS "{k}"' for k in f)}
FROM ft WHERE first = h - 30 * 3600000 AND e = h + {DELAY * HOUR} AND x = h + {ahead * HOUR} AND (h // 3600000 + 1) % {CADENCE} = 0"""
    )


QUERIES: dict[str, tuple[Query, str]] = {"F21_tape_depth_dataset": (dataset, _sql())}
