"""Rolling features over dense bars; partial frames at the start are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof

#: Rows of one key that a task takes at a time.
CHUNK_ROWS = 4096


def chunked(bars: DataFrame, back: int, ahead: int = 0, step: int = 3_600_000) -> DataFrame:
    """Dense bars dealt out by (symbol, stretch of time), each stretch with the rows its frames reach into.

    A symbol with years of bars makes many tasks; at most a quarter of the rows is read twice. ``own`` drops the
    borrowed rows again.
    """
    span = step * max(CHUNK_ROWS, 4 * (back + ahead))
    chunk = F.floor(F.col("open_time") / span)
    into = F.col("open_time") - chunk * span
    homes = F.array_compact(F.array(chunk, F.when(into >= span - back * step, chunk + 1), F.when(into < ahead * step, chunk - 1)))
    return bars.withColumn("__own", chunk).withColumn("__chunk", F.explode(homes))


def own(rows: DataFrame) -> DataFrame:
    return rows.where("__own = __chunk").drop("__own", "__chunk")


def by_time():
    return Window.partitionBy("symbol", "__chunk").orderBy("open_time")


def frame(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


KEYS = ("symbol", "open_time", "__own", "__chunk")


def full(value: Column, column: str, n: int) -> Column:
    """The value, where the frame is full."""
    return F.when(F.count(column).over(frame(n)) == n, value)


def momentum(bars: DataFrame, lags: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    bars = chunked(bars, max(lags))
    return own(bars.select(*KEYS, *[(F.col("close") / F.lag("close", k).over(by_time()) - 1).alias(f"momentum_{k}") for k in lags]))


def sma_spread(bars: DataFrame, short: int, long: int) -> DataFrame:
    a, b = F.avg("close").over(frame(short)), F.avg("close").over(frame(long))
    return own(chunked(bars, long).select(*KEYS, full(a / b - 1, "close", long).alias("sma_spread")))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean relative strength; 100 where nothing was lost."""
    d = chunked(bars, n).select(*KEYS, (F.col("close") - F.lag("close").over(by_time())).alias("d"))
    gain, loss = F.avg(F.greatest("d", F.lit(0.0))).over(frame(n)), F.avg(F.greatest(-F.col("d"), F.lit(0.0))).over(frame(n))
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    return own(d.select(*KEYS, full(value, "d", n).alias("rsi")))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    before = F.lag("close").over(by_time())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    d = chunked(bars, n).select(*KEYS, "close", tr.alias("tr"))
    return own(d.select(*KEYS, full(F.avg("tr").over(frame(n)) / F.col("close"), "tr", n).alias("atr")))


def rolling_corr(bars: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """Pearson correlation of the last n rows from sums, in [-1, 1]; 0 where a variance is not positive."""
    w = frame(n)
    m = {k: F.avg(v).over(w) for k, v in {"x": F.col(x), "y": F.col(y), "xx": F.col(x) ** 2, "yy": F.col(y) ** 2, "xy": F.col(x) * F.col(y)}.items()}
    vx, vy = m["xx"] - m["x"] ** 2, m["yy"] - m["y"] ** 2
    c = (m["xy"] - m["x"] * m["y"]) / F.sqrt(vx * vy)
    return own(chunked(bars, n).select(*KEYS, full(F.when((vx > 1e-9) & (vy > 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))).otherwise(0.0), x, n).alias("corr")))


def realised_volatility(bars: DataFrame, n: int) -> DataFrame:
    r = chunked(bars, n).select(*KEYS, F.log(F.col("close") / F.lag("close").over(by_time())).alias("r"))
    return own(r.select(*KEYS, full(F.stddev_pop("r").over(frame(n)), "r", n).alias("volatility")))


def path_efficiency(bars: DataFrame, n: int) -> DataFrame:
    d = chunked(bars, n).select(*KEYS, "close", F.abs(F.col("close") - F.lag("close").over(by_time())).alias("d"))
    path = F.sum("d").over(frame(n))
    return own(d.select(*KEYS, full(F.when(path > 0, F.abs(F.col("close") - F.lag("close", n).over(by_time())) / path).otherwise(0.0), "d", n).alias("efficiency")))


def cross_section(bars: DataFrame) -> DataFrame:
    """Mean and population deviation of returns over the symbols of each time, and how many agree with the mean's sign."""
    r = simple_returns(bars)
    return r.where("r is not null").groupBy("open_time").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("dispersion"), F.abs(F.avg(F.signum("r"))).alias("agreement"), F.count("*").alias("n"))


def order_flow_imbalance(quotes: DataFrame) -> DataFrame:
    """Best-quote order flow of each update against the one before, over the mean depth of the two."""
    rows = asof.neighbour(quotes.select("symbol", "event_ms", "update_id", "bid", "ask", "bid_qty", "ask_qty"), "symbol", "event_ms", "update_id", ["bid", "ask", "bid_qty", "ask_qty"], "p_")
    b, a, bq, aq = (F.col(f"p_{c}") for c in ("bid", "ask", "bid_qty", "ask_qty"))
    bid = F.when(F.col("bid") >= b, F.col("bid_qty")).otherwise(0.0) - F.when(F.col("bid") <= b, bq).otherwise(0.0)
    ask = F.when(F.col("ask") <= a, F.col("ask_qty")).otherwise(0.0) - F.when(F.col("ask") >= a, aq).otherwise(0.0)
    mean = F.greatest((F.col("bid_qty") + F.col("ask_qty") + bq + aq) / 2, F.lit(1e-12))
    return rows.select("symbol", "update_id", F.when(b.isNotNull(), (bid - ask) / mean).alias("ofi"))


def next_return(bars: DataFrame, delay: int = 1, horizon: int = 1) -> DataFrame:
    """Log return in basis points from the open after a delay to the one a horizon later."""
    value = F.log(F.lead("open", delay + horizon).over(by_time()) / F.lead("open", delay).over(by_time())) * 10_000
    return own(chunked(bars, 0, delay + horizon).select(*KEYS, value.alias("target")))


def simple_returns(bars: DataFrame) -> DataFrame:
    """Return of each bar over the one before; null at the first."""
    return own(chunked(bars, 1).withColumn("r", F.col("close") / F.lag("close").over(by_time()) - 1))


def ema_truncated(bars: DataFrame, n: int) -> DataFrame:
    """Exponential mean over the last 2n rows, seeded with the oldest of them."""
    alpha = 2.0 / (n + 1)
    held = F.collect_list("close").over(frame(2 * n))
    ema = F.aggregate(F.slice(held, 2, 2 * n), held[0], lambda acc, x: acc * (1 - alpha) + x * alpha)
    return own(chunked(bars, 2 * n).select(*KEYS, ema.alias("ema")))


def activity(bars: DataFrame, n: int = 24) -> DataFrame:
    """Quote volume and trades of the last n bars, scaled up to n where fewer are there."""
    scale = F.lit(float(n)) / F.count("*").over(frame(n))
    sums = [(F.sum(c).over(frame(n)) * scale).alias(f"{c}_day") for c in ("quote_volume", "trade_count")]
    return own(chunked(bars, n).select(*KEYS, *sums))


def zscore(bars: DataFrame, column: str, n: int) -> DataFrame:
    """Distance from the mean of the last n rows in population deviations; 0 where nothing varies."""
    m, d = F.avg(column).over(frame(n)), F.stddev_pop(column).over(frame(n))
    return own(chunked(bars, n).select(*KEYS, full(F.when(d > 1e-12, (F.col(column) - m) / d).otherwise(0.0), column, n).alias("z")))


def beta_residual(bars: DataFrame, n: int, lead: str, peers: tuple[str, ...]) -> DataFrame:
    """Return less beta times the benchmark's return, beta over the last n bars.

    The benchmark is the lead symbol; for the lead itself it is the mean of its peers. Times without it are left out.
    """
    r = simple_returns(bars).select("symbol", "open_time", "r")
    m = r.groupBy("open_time").agg(F.max(F.when(F.col("symbol") == lead, F.col("r"))).alias("__lead"), F.avg(F.when(F.col("symbol").isin(*peers), F.col("r"))).alias("__peers"))
    both = r.join(m, "open_time").withColumn("m", F.when(F.col("symbol") == lead, F.col("__peers")).otherwise(F.col("__lead"))).drop("__lead", "__peers")
    rows = chunked(both.where("m is not null"), n)
    var = F.var_pop("m").over(frame(n))
    rows = rows.withColumn("beta", full(F.when(var > 1e-15, F.covar_pop("r", "m").over(frame(n)) / var).otherwise(0.0), "r", n))
    return own(rows.select(*KEYS, "beta", (F.col("r") - F.col("beta") * F.col("m")).alias("residual")))


def funding_features(grid: DataFrame, events: DataFrame) -> DataFrame:
    """At each grid time the last funding rate, its interval and age, sums over 24, 72 and 168 hours, and mean and z of 30 events."""
    order = Window.partitionBy("symbol").orderBy("t", "id")  # a symbol has one event in some hours
    last = order.rowsBetween(-29, 0)
    whole = F.count("*").over(last) == 30
    m, d = F.avg("rate").over(last), F.stddev_pop("rate").over(last)
    told = events.withColumns({"interval": F.col("t") - F.lag("t").over(order), "mean30": F.when(whole, m), "z30": F.when(whole, F.when(d > 1e-12, (F.col("rate") - m) / d).otherwise(0.0))})
    known = asof.asof_join(grid, told, "symbol", "open_time", "t", "id")
    known = known.select("symbol", "open_time", F.col("r_rate").alias("rate"), F.col("r_interval").alias("interval"), (F.col("open_time") - F.col("r_t")).alias("age"), F.col("r_mean30").alias("mean30"), F.col("r_z30").alias("z30"))
    summed = asof.trailing_event_sums(known, events, {f"sum_{k}": k * 3_600_000 for k in (24, 72, 168)}, "rate")
    return summed.withColumns({f"sum_{k}": F.col(f"sum_{k}") + 1e-9 for k in (24, 72, 168)})


def candle_features(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Thirteen features of a bar: momentum of 1, 3, 10 and 20 bars, spread of means, relative strength, gaps of the
    exponential mean and of 5 bars, range, mean absolute change, volume ratio, acceleration and volume trend; 0 where undefined.

    Bars before the longest frame is full are left out.
    """
    rows = chunked(bars, 2 * long + 22)
    before = F.lag("close").over(by_time())
    rows = rows.withColumns({
        "__d": F.col("close") - before, "__a": F.abs(F.col("close") / before - 1), "__i": F.count("close").over(by_time().rowsBetween(Window.unboundedPreceding, 0)),
        "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        "__held": F.collect_list("close").over(frame(2 * long)),
    })

    def share(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b).otherwise(0.0)

    def mean(c: str, n: int, back: int = 0) -> Column:
        return F.avg(c).over(by_time().rowsBetween(-(n - 1) - back, -back))

    alpha = 2.0 / (long + 1)
    ema = F.aggregate(F.slice("__held", 2, 2 * long), F.element_at("__held", 1), lambda acc, x: acc * (1 - alpha) + x * alpha)
    gain, loss = (F.avg(F.greatest(s * F.col("__d"), F.lit(0.0))).over(frame(14)) for s in (1, -1))
    rsi = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))
    close, volume = F.col("close"), F.col("volume")
    values = {f"momentum_{k}": share(close - F.lag("close", k).over(by_time()), F.lag("close", k).over(by_time())) for k in (1, 3, 10, 20)}
    values |= {
        "sma_spread": share(mean("close", short) - mean("close", long), mean("close", long)), "rsi": rsi / 100, "ema_gap": share(ema - close, close), "atr": share(mean("__tr", 14), close),
        "mean_abs_return": mean("__a", 20), "volume_ratio": share(volume - mean("volume", 20, 1), mean("volume", 20, 1)), "acceleration": share(mean("close", short) - mean("close", short, 2), mean("close", short, 2)),
        "gap_5": share(close - mean("close", 5), close), "volume_trend": share(mean("volume", short) - mean("volume", long), mean("volume", long)),
    }
    ready = F.col("__i") > 2 * long + 20
    return own(rows.select(*KEYS, ready.alias("__ready"), *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in values.items()]).where("__ready").drop("__ready"))


def same_slot_ratio(bars: DataFrame, column: str, period: int, k: int = 4) -> DataFrame:
    """Value over the mean of the same slot in the k periods before; null without any, 0 where that mean is 0."""
    slot = F.pmod(F.col("open_time"), F.lit(period))
    before = Window.partitionBy("symbol", slot).orderBy("open_time").rowsBetween(-k, -1)
    mean = F.avg(column).over(before)
    return bars.select("symbol", "open_time", F.when(mean > 0, F.col(column) / mean).when(mean.isNotNull(), 0.0).alias("slot_ratio"))


def flow_windows(bars: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Per width: quote volume, buyers' share, trades a bar, log return, and the change of the share against the width before."""
    rows = chunked(bars, 2 * max(widths))
    for n in widths:
        vol, buy = F.sum("volume").over(frame(n)), F.sum("buy_volume").over(frame(n))
        rows = rows.withColumns({
            f"quote_{n}": full(F.sum("quote_volume").over(frame(n)), "close", n),
            f"share_{n}": full(F.when(vol > 0, buy / vol).otherwise(0.5), "close", n),
            f"rate_{n}": full(F.avg("trade_count").over(frame(n)), "close", n),
            f"return_{n}": F.log(F.col("close") / F.lag("close", n).over(by_time())),
        })
        rows = rows.withColumn(f"share_change_{n}", F.col(f"share_{n}") - F.lag(f"share_{n}", n).over(by_time()))
    return own(rows.select(*KEYS, *[f"{c}_{n}" for n in widths for c in ("quote", "share", "rate", "return", "share_change")]))


def rolling_extreme(bars: DataFrame, n: int) -> DataFrame:
    """Highest high and lowest low of a full frame."""
    return own(chunked(bars, n).select(*KEYS, full(F.max("high").over(frame(n)), "high", n).alias("highest"), full(F.min("low").over(frame(n)), "low", n).alias("lowest")))


def basis_features(spot: DataFrame, perp: DataFrame, widths: tuple[int, ...] = (3, 12), lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Two markets of a symbol side by side: log basis, and by width its change, the gap of returns, product and distance of
    flows, and gaps of log volume and log rate; by lag the spot's earlier flow times and less the other's present one.

    Both are dense bars; rows without the widest past are left out.
    """
    names = ("close", "volume", "quote_volume", "trade_count", "buy_volume")
    sides = [m.select("symbol", "open_time", *[F.col(c).alias(f"{k}_{c}") for c in names]) for k, m in (("s", spot), ("p", perp))]
    rows = chunked(sides[0].join(sides[1], ["symbol", "open_time"]), 2 * max(widths) + max(lags))

    def flow(k: str, n: int) -> Column:
        total = F.sum(f"{k}_volume").over(frame(n))
        return F.when(total > 0, F.sum(2 * F.col(f"{k}_buy_volume") - F.col(f"{k}_volume")).over(frame(n)) / total).otherwise(0.0)

    rows = rows.withColumns({"basis": 10_000 * (F.log("p_close") - F.log("s_close")), "__s": flow("s", 1), "__p": flow("p", 1)})
    made = {}
    for n in widths:
        back = [10_000 * F.log(F.col(f"{k}_close") / F.lag(f"{k}_close", n).over(by_time())) for k in "sp"]
        flows = [flow(k, n) for k in "sp"]
        made |= {
            f"basis_change_{n}": F.col("basis") - F.lag("basis", n).over(by_time()), f"return_gap_{n}": back[0] - back[1], f"flow_product_{n}": flows[0] * flows[1], f"flow_gap_{n}": F.abs(flows[0] - flows[1]),
            f"volume_gap_{n}": F.log1p(F.sum("s_quote_volume").over(frame(n))) - F.log1p(F.sum("p_quote_volume").over(frame(n))), f"rate_gap_{n}": F.log1p(F.sum("s_trade_count").over(frame(n)) / n) - F.log1p(F.sum("p_trade_count").over(frame(n)) / n),
        }
    for k in lags:
        before = F.lag("__s", k).over(by_time())
        made |= {f"lagged_product_{k}": before * F.col("__p"), f"lagged_gap_{k}": before - F.col("__p")}
    return own(rows.withColumns(made)).where(F.col(f"basis_change_{max(widths)}").isNotNull()).select("symbol", "open_time", "basis", *made)


def peer_context(bars: DataFrame, anchor: str) -> DataFrame:
    """Each symbol's return against the mean and deviation of the others at the same time, from sums less its own.

    Beside them the anchor symbol's return and the distance from it, 0 where the anchor has none, and whether it has one.
    """
    r = simple_returns(bars).select("symbol", "open_time", "r").where("r is not null")
    t = r.groupBy("open_time").agg(F.sum("r").alias("s"), F.sum(F.col("r") ** 2).alias("q"), F.count("*").alias("n"), F.max(F.when(F.col("symbol") == anchor, F.col("r"))).alias("a"))
    told = F.col("a").isNotNull()
    others, mean = F.col("n") - 1, (F.col("s") - F.col("r")) / (F.col("n") - 1)
    spread = F.sqrt(F.greatest((F.col("q") - F.col("r") ** 2) / others - mean**2, F.lit(0.0)))
    return r.join(t, "open_time").where("n > 1").select("symbol", "open_time", mean.alias("peer_mean"), spread.alias("peer_dispersion"), (F.col("r") - mean).alias("relative"), F.coalesce("a", F.lit(0.0)).alias("anchor_return"), F.when(told, F.col("r") - F.col("a")).otherwise(0.0).alias("anchor_relative"), told.alias("anchor_available"))


def decision_offsets(starts: DataFrame, t: str, offsets: list[int]) -> DataFrame:
    """One row for each start and offset after it."""
    return starts.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("decision", F.col(t) + F.col("offset"))


def clip_bounds(df: DataFrame, column: str, by: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    return df.groupBy(by).agg(F.percentile(column, low).alias("low"), F.percentile(column, high).alias("high"))


def clip_apply(df: DataFrame, bounds: DataFrame, column: str, by: str) -> DataFrame:
    """Column held inside bounds learned elsewhere; one row of bounds for each value of ``by``."""
    return df.join(bounds, by, "left").withColumn(column, F.greatest("low", F.least("high", column))).drop("low", "high")


def action_expand(df: DataFrame, signed: list[str], swapped: tuple[str, str]) -> DataFrame:
    """Each event once long and once short: signed columns turn their sign, the pair changes places."""
    a, b = swapped
    rows = df.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    long = F.col("side") == 1
    return rows.withColumns({c: F.col(c) * F.col("side") for c in signed} | {a: F.when(long, F.col(a)).otherwise(F.col(b)), b: F.when(long, F.col(b)).otherwise(F.col(a))})


def fee(price: Column, qty: Column, rate: float, power: int = 1) -> Column:
    """qty * rate * (p (1 - p)) ^ power, up to the next 0.00001; nothing where it is less than that."""
    raw = qty * rate * (price * (1 - price)) ** power
    return F.when(raw < 1e-5, 0.0).otherwise(F.ceil(F.round(raw * 1e5, 6)) / 1e5)


def outlook(bars: DataFrame) -> DataFrame:
    """Momentum over 1 and 10 bars, spread of the 3- and 12-bar means, range over 14 bars and the next return, in one pass."""
    before = F.lag("close").over(by_time())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = chunked(bars, 14, 2).withColumn("tr", tr)
    moved = [(F.col("close") / F.lag("close", k).over(by_time()) - 1).alias(f"momentum_{k}") for k in (1, 10)]
    spread = full(F.avg("close").over(frame(3)) / F.avg("close").over(frame(12)) - 1, "close", 12).alias("sma_spread")
    span = full(F.avg("tr").over(frame(14)) / F.col("close"), "tr", 14).alias("atr")
    target = (F.log(F.lead("open", 2).over(by_time()) / F.lead("open", 1).over(by_time())) * 10_000).alias("target")
    return own(rows.select(*KEYS, *moved, spread, span, target))
