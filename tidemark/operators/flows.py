"""Whole sets of market metrics by trailing window: dense quote flow, tape against candles, and a day's activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import KEYS, by_time, chunked, frame, full, own
from tidemark.operators.panels import ratio

#: Widths of the windows in steps of the dense flow, as used on one-second flow.
WIDTHS = (1, 5, 15, 30, 60, 300, 900)
METRICS = ("return", "path", "volatility", "range", "signed_flow", "log_volume", "order_rate", "log_mean_order", "log_max_order", "concentration", "log_constituents", "zero_share")
CHANGED = ("volatility", "signed_flow", "log_volume", "order_rate")


def market_windows(flow: DataFrame, widths: tuple[int, ...] = WIDTHS, step: int = 1000) -> DataFrame:
    """Twelve metrics of each width over dense flow, and by how much four of them differ from the window before.

    ``flow`` has the columns of ``bars.dense_flow``. Price metrics are in basis points; a metric is null unless its window
    is full, a change unless both are. Ratios without flow are 0. ``log_age`` is that of the last trade in seconds.
    """
    rows = chunked(flow, 2 * max(widths) + 1, step=step)
    quote = F.col("buy_quote") + F.col("sell_quote")
    moved = F.coalesce(F.log(F.col("close") / F.lag("close").over(by_time())), F.lit(0.0))
    rows = rows.withColumns({"__q": quote, "__s": F.col("buy_quote") - F.col("sell_quote"), "__r": moved, "__none": (F.col("aggregates") == 0).cast("double"), "log_age": F.log1p(F.col("age") / 1000)})
    made = {}
    for n in widths:
        w = frame(n)

        def total(c: str | Column, w=w) -> Column:
            return F.sum(c).over(w)

        values = (
            10_000 * F.log(F.col("close") / F.lag("close", n).over(by_time())),
            10_000 * total(F.abs("__r")),
            10_000 * F.sqrt(total(F.col("__r") ** 2)),
            10_000 * F.log(F.max("high").over(w) / F.min("low").over(w)),
            ratio(total("__s"), total("__q")),
            F.log1p(total("__q")),
            total("aggregates") / n,
            F.log1p(ratio(total("__q"), total("aggregates"))),
            F.log1p(F.max("max_quote").over(w)),
            ratio(total("squared_quote"), total("__q") ** 2),
            F.log1p(ratio(total("constituents"), total("aggregates"))),
            F.avg("__none").over(w),
        )
        made |= {f"{name}_{n}": full(value, "close", n) for name, value in zip(METRICS, values, strict=True)}
    rows = rows.withColumns(made)
    changes = {f"{c}_change_{n}": F.col(f"{c}_{n}") - F.lag(f"{c}_{n}", n).over(by_time()) for n in widths for c in CHANGED}
    return own(rows.withColumns(changes).select(*KEYS, "log_age", *made, *changes))


def tape_windows(bars: DataFrame, tape: DataFrame, lookbacks: tuple[int, ...]) -> DataFrame:
    """Sixteen features of the tape behind dense candles for each lookback; 0 until the lookback is full.

    ``tape`` has the columns of ``bars.tape_buckets``; a candle without a bucket has no flow, range or drift. Shares and
    imbalances are of notional, surprises are of the last bar against the mean, shifts are of the later half against the earlier.
    """
    cells = ("buy_qty", "sell_qty", "buy_notional", "sell_notional", "buys", "sells", "max_notional")
    met = bars.select("symbol", "open_time", "open", "high", "low", "close").join(tape.select("symbol", "open_time", *cells), ["symbol", "open_time"], "left").fillna(0, list(cells))
    rows = chunked(met, max(lookbacks) + 1)
    notional, trades = F.col("buy_notional") + F.col("sell_notional"), F.col("buys") + F.col("sells")
    seen, close = notional > 0, F.col("close")
    vwap = ratio(notional, F.col("buy_qty") + F.col("sell_qty"), 1.0)
    rows = rows.withColumns({
        "__n": notional, "__c": trades, "__f": ratio(F.col("buy_notional") - F.col("sell_notional"), notional), "__r": F.coalesce(close / F.lag("close").over(by_time()) - 1, F.lit(0.0)),
        "__gap": F.when(seen, close / vwap - 1).otherwise(0.0), "__span": F.when(seen, (F.col("high") - F.col("low")) / close).otherwise(0.0), "__drift": F.when(seen, close / F.col("open") - 1).otherwise(0.0), "__none": F.when(seen, 0.0).otherwise(1.0),
    })
    made = {}
    for n in lookbacks:
        w, cut = frame(n), max(1, n // 2)
        early, late = by_time().rowsBetween(-(n - 1), cut - n), by_time().rowsBetween(cut - n + 1, 0)

        def mean(c: str, over=w) -> Column:
            return F.avg(c).over(over)

        def total(c: str, w=w) -> Column:
            return F.sum(c).over(w)

        flow, spread = mean("__f"), F.stddev_pop("__f").over(w)
        vx, vy = F.var_pop("__f").over(w), F.var_pop("__r").over(w)
        large = ratio(total("max_notional"), total("__n"))
        values = {
            "buy_share": ratio(total("buy_notional"), total("__n"), 0.5),
            "imbalance": ratio(total("buy_notional") - total("sell_notional"), total("__n")),
            "count_imbalance": ratio(total("buys") - total("sells"), total("__c")),
            "notional_surprise": F.tanh(ratio(F.col("__n") - mean("__n"), mean("__n"))),
            "count_surprise": F.tanh(ratio(F.col("__c") - mean("__c"), mean("__c"))),
            "large_share": large,
            "vwap_gap": F.tanh(F.col("__gap") * 5000),
            "range": F.tanh(mean("__span") * 5000),
            "drift": F.tanh(mean("__drift") * 5000),
            "silent": mean("__none"),
            "shift": mean("__f", late) - mean("__f", early),
            "flow_corr": F.when(vx * vy > 1e-18, F.covar_pop("__f", "__r").over(w) / F.sqrt(vx * vy)).otherwise(0.0),
            "flow_gap": F.col("__f") - flow,
            "flow_z": F.tanh(F.when(spread > 1e-9, (F.col("__f") - flow) / spread).otherwise(0.0) / 3),
            "notional_shift": F.tanh(ratio(mean("__n", late) - mean("__n", early), mean("__n"))),
            "large_pressure": large * F.tanh(flow * 3),
        }
        ready = F.count("close").over(w) == n
        made |= {f"{k}_{n}": F.when(ready, v).otherwise(0.0) for k, v in values.items()}
    return own(rows.withColumns(made).select(*KEYS, *made))


def activity_day(bars: DataFrame, step: int, span: int = 86_400_000, least: int = 300_000) -> DataFrame:
    """Quote volume and trades of the bars of the last day, scaled up to a day; 0 until five minutes are observed.

    Bars need not be dense: the frame is one of time, and what is observed begins with its first bar.
    """
    w = by_time().rangeBetween(-span, Window.currentRow)
    seen = F.col("open_time") + step - F.min("open_time").over(w)
    rows = chunked(bars, span // step + 1, step=step).withColumns({"__seen": seen, "__q": F.sum("quote_volume").over(w), "__n": F.sum("trade_count").over(w)})
    observed = F.least(F.col("__seen"), F.lit(span))
    scale, early = F.lit(float(span)) / observed, F.col("__seen") < least
    return own(rows.select(*KEYS, observed.alias("observed"), F.when(early, 0.0).otherwise(F.col("__q") * scale).alias("quote_volume_day"), F.when(early, 0).otherwise(F.bround(F.col("__n") * scale, 0)).cast("long").alias("trade_count_day")))
