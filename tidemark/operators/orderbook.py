"""Features of order books, trades and event times, and books rebuilt from changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import asof, features

#: Books whose levels are merged at once.
SLICE = 2_000


def book_metrics(books: DataFrame, quote: float) -> DataFrame:
    """Middle, spread, micro price, depths, imbalances, the shape of both sides and what taking ``quote`` costs."""
    bid, ask = F.col("bids")[0], F.col("asks")[0]
    shapes = books.withColumns({"__b": book.depth_shape(F.col("bids")), "__a": book.depth_shape(F.col("asks"))})
    out = shapes.select(
        "update_id",
        ((bid["price"] + ask["price"]) / 2).alias("mid"),
        (ask["price"] - bid["price"]).alias("spread"),
        ((ask["price"] * bid["qty"] + bid["price"] * ask["qty"]) / (bid["qty"] + ask["qty"])).alias("microprice"),
        book.depth(F.col("bids"), 20).alias("bid_depth"),
        book.depth(F.col("asks"), 20).alias("ask_depth"),
        *[book.imbalance(F.col("bids"), F.col("asks"), n).alias(f"imbalance_{n}") for n in (1, 5, 10, 20)],
        F.col("__b.slope").alias("bid_slope"),
        F.col("__b.convexity").alias("bid_convexity"),
        F.col("__a.slope").alias("ask_slope"),
        F.col("__a.convexity").alias("ask_convexity"),
        book.quote_impact(F.col("asks"), quote, 1).alias("buy_impact"),
        book.quote_impact(F.col("bids"), quote, -1).alias("sell_impact"),
    )
    return out


def book_changes(books: DataFrame) -> DataFrame:
    """Share of depth added and cancelled on both sides of each book against the one before; the first book has none."""
    b = asof.neighbour(books, "symbol", "event_ms", "update_id", ["bids", "asks"], "p_")
    sides = {side: book.side_change(F.col(f"p_{side}s"), F.col(f"{side}s")) for side in ("bid", "ask")}
    return b.where("p_bids is not null").select("symbol", "event_ms", "update_id", *[sides[s][k].alias(f"{s}_{k}") for s in sides for k in ("added", "cancelled")])


def book_change_flow(decisions: DataFrame, books: DataFrame, span: int) -> DataFrame:
    """Sums of the changes in [t - span, t) at each decision."""
    names = ["bid_added", "bid_cancelled", "ask_added", "ask_cancelled"]
    aggs = {c: ("sum", F.col(c), True) for c in names} | {"updates": ("count", F.lit(1), True)}
    sums = asof.window_aggregates(decisions, book_changes(books), "event_ms", span, aggs, end_closed=False)
    return sums.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names], "updates")


def level_bands(books: DataFrame) -> DataFrame:
    """Each level whose quantity differs from the book before, with the band of its price's rank in that book.

    Both sides of both books of many updates are merged by price at once: a price met twice is one level that stays, and
    its rank is one more than the levels of the book before that come earlier. A book with a missing side or level, or after such
    a one, has no rows; a level without price or a price repeated on a side is an error.
    """
    parts = [(side, c) for side in ("bid", "ask") for c in ("price", "qty")]
    narrow = books.select("symbol", "event_ms", "update_id", *[F.col(f"{side}s")[c].cast("array<double>").alias(f"{side}_{c}") for side, c in parts])
    both = asof.neighbour(narrow, "symbol", "event_ms", "update_id", [f"{side}_{c}" for side, c in parts], "p_").where("p_bid_price is not null")
    pairs = both.select("symbol", "update_id", *[f"{p}{side}_{c}" for side, c in parts for p in ("p_", "")])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), SLICE):
                batch = whole.slice(low, SLICE)
                known = np.logical_and.reduce([batch.column(f"{p}{side}_price").is_valid().to_numpy(zero_copy_only=False) for side in ("bid", "ask") for p in ("p_", "")])
                sides = {}
                for side, sign in (("bid", -1.0), ("ask", 1.0)):
                    lengths, prices, sizes = ([batch.column(f"{p}{side}_{c}") for p in ("p_", "")] for c in ("price", "price", "qty"))
                    lengths = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lengths]
                    at = np.concatenate([np.repeat(np.arange(len(batch)), n) for n in lengths])
                    price, size = (pa.concat_arrays([x.flatten() for x in v]) for v in (prices, sizes))
                    gone = price.is_null().to_numpy(zero_copy_only=False)
                    if gone.any():
                        if size.is_valid().to_numpy(zero_copy_only=False)[gone].any():
                            raise ValueError("a level has no price")
                        known[at[gone]] = False
                    was = np.repeat([1, 0], [int(n.sum()) for n in lengths])
                    price, step = price.to_numpy(zero_copy_only=False), size.fill_null(0.0).to_numpy(zero_copy_only=False) * (1.0 - 2.0 * was)
                    order = np.lexsort((sign * price, at))
                    at, price, step, was = at[order], price[order], step[order], was[order]
                    same = (at[1:] == at[:-1]) & (price[1:] == price[:-1])
                    if (same & (was[1:] == was[:-1]) & known[at[1:]]).any():
                        raise ValueError("a price is repeated on one side of a book")
                    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else np.empty(0, np.int64)
                    moved = np.add.reduceat(step, first) if len(at) else step
                    before = (np.cumsum(was) - was)[first] - (np.cumsum(lengths[0]) - lengths[0])[at[first]]
                    sides[side] = at[first], price[first], moved, before + 1
                for side, (at, price, moved, rank) in sides.items():
                    keep = (moved != 0) & known[at]
                    rows = pa.array(at[keep])
                    cells = [batch.column("symbol").take(rows), batch.column("update_id").take(rows), pa.repeat(side, len(rows)), pa.array(price[keep]), pa.array(moved[keep]), pa.array(rank[keep], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cells, names=["symbol", "update_id", "side", "price", "change", "rank"])

    kinds = dict(pairs.dtypes)
    rows = pairs.mapInArrow(changed, f"symbol {kinds['symbol']}, update_id {kinds['update_id']}, side string, price double, change double, rank int")
    return rows.withColumn("band", F.when(F.col("rank") <= 5, "1-5").when(F.col("rank") <= 10, "6-10").when(F.col("rank") <= 20, "11-20").otherwise("outside"))


def band_profile(bands: DataFrame) -> DataFrame:
    return bands.groupBy("symbol", "side", "band").agg(F.count("*").alias("n"), F.sum(F.abs("change")).alias("moved"))


def log_steps(trades: DataFrame) -> DataFrame:
    """Log return of each trade over the one before, its square, and the product of neighbouring absolute returns."""
    one = asof.neighbour(trades, "symbol", "t", "id", ["price"], "p_").withColumn("r", F.coalesce(F.log(F.col("price") / F.col("p_price")), F.lit(0.0)))
    two = asof.neighbour(one, "symbol", "t", "id", ["r"], "p_")
    return two.withColumn("bp", F.coalesce(F.abs(F.col("p_r") * F.col("r")), F.lit(0.0)))


def price_windows(decisions: DataFrame, trades: DataFrame, span: int) -> DataFrame:
    """Return from the price known at the window's start, variance, bipower variation and the share of jumps."""
    first = F.struct("t", F.col("id").alias("o"), "bp")
    aggs = {"log_return": ("sum", F.col("r"), False), "variance": ("sum", F.col("r") ** 2, False), "__bp": ("sum", F.col("bp"), False), "__first": ("min", first, False), "n": ("count", F.lit(1), True)}
    sums = asof.window_aggregates(decisions, log_steps(trades), "t", span, aggs)
    bipower = np.pi / 2 * F.greatest(F.lit(0.0), F.coalesce(F.col("__bp") - F.col("__first.bp"), F.lit(0.0)))
    sums = sums.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("log_return", "variance")], bipower.alias("bipower"), "n")
    return sums.withColumn("jump_share", F.when(F.col("variance") > 0, F.greatest(F.lit(0.0), (F.col("variance") - F.col("bipower")) / F.col("variance"))).otherwise(0.0))


def trade_windows(decisions: DataFrame, trades: DataFrame, span: int) -> DataFrame:
    """Return, variance, quote volume and its signed imbalance over the trades since the window's start."""
    quote = F.col("price") * F.col("qty")
    signed = F.when(F.col("buyer_is_maker"), -1.0).otherwise(1.0) * quote
    aggs = {"log_return": ("sum", F.col("r"), False), "variance": ("sum", F.col("r") ** 2, False), "quote_volume": ("sum", quote, False), "imbalance": ("sum", signed, False)}
    sums = asof.window_aggregates(decisions, log_steps(trades), "t", span, aggs)
    return sums.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("log_return", "variance", "quote_volume")], F.coalesce(F.col("imbalance") / F.col("quote_volume"), F.lit(0.0)).alias("imbalance"))


def sliding_quotes(decisions: DataFrame, quotes: DataFrame, span: int) -> DataFrame:
    """Updates, mean and largest spread and the path of the middle over quotes in (t - span, t]."""
    mid = quotes.select("symbol", "event_ms", "update_id", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"))
    rows = asof.neighbour(mid, "symbol", "event_ms", "update_id", ["mid"], "p_").withColumn("move", F.coalesce(F.abs(F.log(F.col("mid") / F.col("p_mid"))), F.lit(0.0)))
    aggs = {"updates": ("count", F.lit(1), False), "__told": ("count", F.col("spread"), False), "__spread": ("sum", F.col("spread"), False), "max_spread": ("max", F.col("spread"), False), "variation": ("sum", F.col("move"), False)}
    sums = asof.window_aggregates(decisions, rows, "event_ms", span, aggs)
    return sums.select("id", "updates", F.when(F.col("__told") > 0, F.col("__spread") / F.col("__told")).alias("mean_spread"), "max_spread", F.coalesce("variation", F.lit(0.0)).alias("variation"))


def decayed(rows: DataFrame, half_life: int, columns: list[str]) -> DataFrame:
    """Sums of columns that halve every ``half_life``, after each row of its symbol, scaled to the row's ``start``.

    Inside a time bucket of 64 half-lives the decayed sum is a running sum of values scaled to the bucket's start. What
    a bucket starts with is a recursion over one row for each bucket of a symbol.
    """
    span = 64 * half_life
    b = F.floor(F.col("t") / span)
    grown = F.pow(F.lit(2.0), (F.col("t") - b * span) / half_life)
    scaled = rows.select("symbol", "t", "id", b.alias("__b"), *[(F.col(c) * grown).alias(c) for c in columns])

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("__b")
        at, sums = group.column("__b").to_numpy(), np.column_stack([group.column(c).to_numpy() for c in columns])
        out = np.zeros(sums.shape)
        for i in range(1, len(at)):
            out[i] = (out[i - 1] + sums[i - 1]) * 2.0 ** (-64.0 * (at[i] - at[i - 1]))
        return pa.table({"symbol": group.column("symbol"), "__b": group.column("__b"), **{f"__c_{c}": out[:, i] for i, c in enumerate(columns)}})

    totals = scaled.groupBy("symbol", "__b").agg(*[F.sum(c).alias(c) for c in columns])
    carry = totals.groupBy("symbol").applyInArrow(chain, "symbol string, __b long, " + ", ".join(f"__c_{c} double" for c in columns))
    run = Window.partitionBy("symbol", "__b").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    inside = scaled.withColumns({c: F.sum(c).over(run) for c in columns})
    return inside.join(carry, ["symbol", "__b"]).select("symbol", "t", "id", (F.col("__b") * span).alias("start"), *[(F.col(c) + F.col(f"__c_{c}")).alias(c) for c in columns])


def exp_decay_flow(decisions: DataFrame, trades: DataFrame, half_life: int, delay: int) -> DataFrame:
    """Log rate and imbalance of buy and sell notional that halves every ``half_life``, as known ``delay`` before."""
    quote = F.col("price") * F.col("qty")
    rows = trades.select("symbol", "t", "id", F.when(F.col("buyer_is_maker"), 0.0).otherwise(quote).alias("buy"), F.when(F.col("buyer_is_maker"), quote).otherwise(0.0).alias("sell"))
    state = decayed(rows, half_life, ["buy", "sell"])
    known = asof.asof_join(decisions.select("id", "symbol", (F.col("t") - delay).alias("cut")), state, "symbol", "cut", "t", "id")
    decay = F.pow(F.lit(2.0), -(F.col("cut") - F.col("r_start")) / half_life)
    total = F.coalesce((F.col("r_buy") + F.col("r_sell")) * decay, F.lit(0.0))
    imbalance = (F.col("r_buy") - F.col("r_sell")) / (F.col("r_buy") + F.col("r_sell"))
    return known.select("id", F.log1p(total / (half_life / 1000)).alias("log_rate"), F.when(total > 0, imbalance).otherwise(0.0).alias("imbalance"))


def event_decay_state(trades: DataFrame, half_life: int, gap: int) -> DataFrame:
    """Decayed count, notional and signed notional after each trade, from zero after a silence longer than ``gap``."""
    quote = F.col("price") * F.col("qty")
    near = asof.neighbour(trades, "symbol", "t", "id", ["t"], "p_").withColumn("__new", F.coalesce(F.col("t") - F.col("p_t") > gap, F.lit(True)).cast("double"))
    runs = asof.running_sum(near, "symbol", "t", "id", "__new", "__run")
    rows = runs.select(F.concat_ws("/", "symbol", F.col("__run").cast("long").cast("string")).alias("symbol"), "t", "id", F.lit(1.0).alias("n"), quote.alias("notional"), F.when(F.col("buyer_is_maker"), -quote).otherwise(quote).alias("signed"))
    fall = F.pow(F.lit(2.0), -(F.col("t") - F.col("start")) / half_life)
    return decayed(rows, half_life, ["n", "notional", "signed"]).select("id", *[(F.col(c) * fall).alias(c) for c in ("n", "notional", "signed")])


def lead_lag(first: DataFrame, second: DataFrame, lags: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Returns and flow shares of two markets' dense bars, their basis and its change over five bars."""
    sides = []
    for name, bars in (("a", first), ("b", second)):
        rows = features.chunked(bars, max(lags))
        flow = 2 * F.col("buy_volume") - F.col("volume")
        moves = [(10_000 * F.log(F.col("close") / F.lag("close", k).over(features.by_time()))).alias(f"{name}_return_{k}") for k in lags]
        shares = [F.when(F.sum("volume").over(features.frame(k)) > 0, F.sum(flow).over(features.frame(k)) / F.sum("volume").over(features.frame(k))).otherwise(0.0).alias(f"{name}_share_{k}") for k in lags]
        past = F.lag("close", 5).over(features.by_time()).alias(f"{name}_past")
        sides.append(features.own(rows.select(*features.KEYS, F.col("close").alias(f"{name}_close"), past, *moves, *shares)).drop("symbol"))
    basis = 10_000 * F.log(F.col("b_close") / F.col("a_close"))
    both = sides[0].join(sides[1], "open_time").where(f"a_return_{max(lags)} is not null and b_return_{max(lags)} is not null")
    return both.withColumns({"basis": basis, "basis_change": basis - 10_000 * F.log(F.col("b_past") / F.col("a_past"))}).drop("a_close", "b_close", "a_past", "b_past")


def event_windows(rows: DataFrame, n: int, gap: int) -> DataFrame:
    """The last n events (id, t, price) of each event, back to the last pause longer than ``gap``."""
    near = asof.neighbour(rows.select("symbol", "t", "id", "price"), "symbol", "t", "id", ["t"], "p_")
    held = features.chunked(near.withColumn("open_time", F.col("t")), n + 1, step=gap)
    w = Window.partitionBy("symbol", "__chunk").orderBy("t", "id").rowsBetween(-(n - 1), 0)
    starts = F.col("p_t").isNull() | (F.col("t") - F.col("p_t") > gap)
    seen = F.collect_list(F.struct("id", "t", "price", starts.alias("starts"))).over(w)
    out = features.own(held.select("symbol", "id", "t", "__own", "__chunk", seen.alias("__s")))
    back = F.array_position(F.reverse(F.transform("__s", lambda e: e["starts"])), F.lit(True)).cast("int")
    kept = F.when(back > 0, F.slice("__s", F.size("__s") - back + 1, back)).otherwise(F.col("__s"))
    return out.select("symbol", "id", "t", F.transform(kept, lambda e: F.struct(e["id"].alias("id"), e["t"].alias("t"), e["price"].alias("price"))).alias("events"))


def liquidity_session(bars: DataFrame, lookback: int, base: float, slot_ms: int = 3_600_000, least: int = 2) -> DataFrame:
    """Threshold and size where volume lies under its trailing median or under that of the same slot of the week."""
    week = 7 * 86_400_000
    rows = features.chunked(bars, lookback).withColumn("slot", F.floor(F.pmod("open_time", F.lit(week)) / slot_ms))
    past = features.by_time().rowsBetween(-lookback, -1)
    same = Window.partitionBy("symbol", "__chunk", "slot").orderBy("open_time").rangeBetween(-lookback * slot_ms, -1)
    m = rows.select(*features.KEYS, "volume", F.count("volume").over(past).alias("n"), F.percentile("volume", 0.5).over(past).alias("median"), F.count("volume").over(same).alias("k"), F.percentile("volume", 0.5).over(same).alias("slot_median"))
    full = F.col("n") == lookback
    low = F.coalesce(full & (F.col("median") > 0) & (F.col("volume") < 0.35 * F.col("median")), F.lit(False))
    quiet = F.coalesce(full & (F.col("k") >= least) & (F.col("slot_median") > 0) & (F.col("volume") < 0.45 * F.col("slot_median")), F.lit(False))
    threshold = base + F.when(low, 0.04).otherwise(0.0) + F.when(quiet, 0.01).otherwise(0.0)
    size = F.when(low, 0.5).otherwise(1.0) * F.when(quiet, 0.85).otherwise(1.0)
    return features.own(m.select(*features.KEYS, low.alias("low"), quiet.alias("quiet"), threshold.alias("threshold"), size.alias("size")))


def robust_bounds(rows: DataFrame, columns: list[str], sample: int) -> DataFrame:
    """Median and scaled quartile distance of each column over the ``sample`` rows whose id hashes lowest, as one row."""
    picked = rows.orderBy(F.md5(F.col("id").cast("string"))).limit(sample)
    return picked.agg(*[F.percentile(c, 0.5).alias(f"mid_{c}") for c in columns], *[((F.percentile(c, 0.75) - F.percentile(c, 0.25)) / 1.349).alias(f"scale_{c}") for c in columns])


def robust_scale(rows: DataFrame, bounds: DataFrame, columns: list[str], clip: float = 8.0) -> DataFrame:
    """Columns less their median, over their scale (1 where that is 0), held to ``clip``. ``bounds`` is one row."""
    z = {c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"mid_{c}")) / F.when(F.col(f"scale_{c}") > 0, F.col(f"scale_{c}")).otherwise(1.0))) for c in columns}
    return rows.crossJoin(F.broadcast(bounds)).withColumns(z).drop(*[f"{k}_{c}" for c in columns for k in ("mid", "scale")])


def action_align(rows: DataFrame, pairs: list[tuple[str, str]], shares: list[str], directional: list[str]) -> DataFrame:
    """Each row as long and as short: for short the paired columns change places, shares turn to 1 - share, signs turn."""
    sided = rows.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    short = F.col("side") < 0
    swapped = {a: F.when(short, F.col(b)).otherwise(F.col(a)) for one in pairs for a, b in (one, one[::-1])}
    return sided.withColumns(swapped | {c: F.when(short, 1 - F.col(c)).otherwise(F.col(c)) for c in shares} | {c: F.col("side") * F.col(c) for c in directional})


def four_actions(rows: DataFrame, fees: dict[str, float]) -> DataFrame:
    """Each quote as passive and aggressive, long and short: the price it would get, its distance from the middle, its fee."""
    mid = (F.col("bid") + F.col("ask")) / 2
    kinds = [F.struct(F.lit(style).alias("style"), F.lit(side).alias("side"), F.col("bid" if (style == "passive") == (side == 1) else "ask").alias("price"), F.lit(fee).alias("fee_bps")) for style, fee in fees.items() for side in (1, -1)]
    out = rows.withColumn("__a", F.explode(F.array(*kinds))).select(*rows.columns, "__a.*")
    return out.withColumn("cost_bps", F.col("side") * (F.col("price") / mid - 1) * 10_000 + F.col("fee_bps"))


def book_feed(books: DataFrame, snapshot_every: int, lost: int) -> DataFrame:
    """A feed of snapshots and of changes against the book before, each naming the update before it; some are lost."""
    b = asof.neighbour(books, "symbol", "event_ms", "update_id", ["update_id", "bids", "asks"], "p_")
    whole = (F.col("update_id") % snapshot_every == 1) | F.col("p_bids").isNull()
    sides = {s: F.when(whole, F.col(s)).otherwise(book.delta(F.col(f"p_{s}"), F.col(s))).alias(s) for s in ("bids", "asks")}
    return b.where(F.col("update_id") % lost != 0).select("symbol", "event_ms", "update_id", F.col("p_update_id").alias("previous_id"), whole.alias("snapshot"), *sides.values())


def book_segments(feed: DataFrame) -> DataFrame:
    """Runs of updates that each name the one before: a snapshot begins one, a gap ends it until the next snapshot."""
    near = asof.neighbour(feed, "symbol", "event_ms", "update_id", ["update_id"], "seen_")
    broken = ~F.col("snapshot") & ~F.coalesce(F.col("previous_id") == F.col("seen_update_id"), F.lit(False))
    starts = near.withColumn("__start", (F.col("snapshot") | broken).cast("double"))
    return asof.running_sum(starts, "symbol", "event_ms", "update_id", "__start", "segment").withColumn("segment", F.col("segment").cast("long")).drop("__start", "seen_update_id")


def rebuild_book(feed: DataFrame, levels: int = 20) -> DataFrame:
    """Best prices and depths after each update of the segments that begin with a snapshot.

    Segments are dealt out and put in order, and each partition is read once as a stream: a task holds one book and one
    batch of the feed, however long a segment is.
    """
    names = ("best_bid", "best_ask", "bid_depth", "ask_depth")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, live, state = None, False, ({}, {})
        for batch in batches:
            symbols, segments, ids, snapshots = (batch.column(c).to_pylist() for c in ("symbol", "segment", "update_id", "snapshot"))
            sides = []
            for side in ("bids", "asks"):
                lists = batch.column(side)
                flat = lists.flatten()
                sides.append((np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist(), flat.field("price").to_pylist(), flat.field("qty").to_pylist()))
            out = {n: [] for n in ("symbol", "update_id", *names)}
            for i, update in enumerate(ids):
                if (symbols[i], segments[i]) != segment:
                    segment, live = (symbols[i], segments[i]), snapshots[i]
                if not live:
                    continue
                tops = []
                for down, held, (cuts, prices, sizes) in zip((True, False), state, sides, strict=True):
                    if snapshots[i]:
                        held.clear()
                    for j in range(cuts[i], cuts[i + 1]):
                        if sizes[j] > 0:
                            held[prices[j]] = sizes[j]
                        else:
                            held.pop(prices[j], None)
                    tops.append(sorted(held, reverse=down)[:levels])
                values = (symbols[i], update, *[t[0] if t else None for t in tops], *[sum([held[p] for p in t]) for held, t in zip(state, tops, strict=True)])
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("symbol", pa.string()), ("update_id", pa.int64()), *[(n, pa.float64()) for n in names]]))

    ordered = book_segments(feed).select("symbol", "segment", "event_ms", "update_id", "snapshot", "bids", "asks").repartition("symbol", "segment").sortWithinPartitions("symbol", "segment", "event_ms", "update_id")
    rows = ordered.mapInArrow(replay, "symbol string, update_id long, " + ", ".join(f"{n} double" for n in names))
    return rows.withColumn("imbalance", F.when(F.col("bid_depth") + F.col("ask_depth") > 0, (F.col("bid_depth") - F.col("ask_depth")) / (F.col("bid_depth") + F.col("ask_depth"))).otherwise(0.0))


def merged_events(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades and quotes of all symbols as one feed, with the columns that order it."""
    a = trades.select("symbol", "t", F.lit("trade").alias("kind"), F.col("id").alias("event"), F.col("price").alias("value"))
    b = quotes.select("symbol", F.col("event_ms").alias("t"), F.lit("quote").alias("kind"), F.col("update_id").alias("event"), ((F.col("bid") + F.col("ask")) / 2).alias("value"))
    return a.unionByName(b)
