"""What became of decisions: stress examples around anchors, delayed outcomes, exits along a quoted path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_forward, asof_join, last_known, neighbour, running_sum, running_sums
from tidemark.operators.regimes import cut

DAY_MS = 86_400_000
#: Anchors or blocks that one array holds at most before it is exploded.
STRETCH = 4096
#: Rows of a table that joins broadcast at most.
FEW = 100_000


def known_at(left: DataFrame, right: DataFrame, key: str, t: str, offsets: dict[str, int], right_t: str, order: str) -> DataFrame:
    """Distinct left rows with, for each named offset, the latest right row at or before t + offset as a struct; null where none is.

    All offsets are one union and one time join; the offsets of a row meet again by its own columns.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).cast("long").alias("o")) for n, o in offsets.items()]))
    rows = left.withColumn("__a", asked).select(*left.columns, F.col("__a.name").alias("__name"), (F.col(t) + F.col("__a.o")).alias("__at"))
    j = asof_join(rows, right, key, "__at", right_t, order, "__r_")
    held = [c for c in right.columns if c != key]
    seen = F.when(F.col(f"__r_{right_t}").isNotNull(), F.struct(*[F.col(f"__r_{c}").alias(c) for c in held]))
    return j.groupBy(*left.columns).agg(*[F.first(F.when(F.col("__name") == n, seen), ignorenulls=True).alias(n) for n in offsets])


def month_of(t: Column) -> Column:
    """UTC months since year 0."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / DAY_MS).cast("int"))
    return F.year(date) * 12 + F.month(date) - 1


def segments(snapshots: DataFrame, max_gap: int, columns: list[str]) -> DataFrame:
    """Snapshots, one for each symbol and time (the greatest of repeated ones), with the one before them and their segment.

    A segment is named by its first time; it ends before a pause longer than ``max_gap`` and at the end of a UTC month.
    """
    one = snapshots.where("symbol IS NOT NULL AND t IS NOT NULL").groupBy("symbol", "t").agg(F.max(F.struct(*columns)).alias("now"))
    near = neighbour(one, "symbol", "t", "t", ["t", "now"], "before_")
    broken = F.col("before_t").isNull() | (F.col("t") - F.col("before_t") > max_gap) | (month_of(F.col("t")) != month_of(F.col("before_t")))
    return last_known(near.withColumn("segment", F.when(broken, F.col("t"))), "symbol", "t", ["segment"])


def regular_anchors(told: DataFrame, step: int) -> DataFrame:
    """The multiples of ``step`` inside each segment that have a whole step of it after them."""
    ends = told.groupBy("symbol", "segment").agg(F.max("t").alias("__end"))
    first, last = F.floor((F.col("segment") + step - 1) / step), F.floor(F.col("__end") / step) - 1
    cut = ends.select("symbol", first.alias("__a"), last.alias("__z")).where("__a <= __z")
    part = cut.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__z") - F.col("__a")) / STRETCH))))
    low = F.col("__a") + F.col("__p") * STRETCH
    return part.select("symbol", F.explode(F.sequence(low, F.least("__z", low + STRETCH - 1))).alias("anchor")).withColumn("anchor", F.col("anchor") * step)


def depth_stress_examples(snapshots: DataFrame, columns: list[str], horizon: int, lags: dict[str, int], max_age: int, max_gap: int) -> DataFrame:
    """Examples that do not overlap: at every anchor the descriptors known, their changes and what they were, and the first snapshot a horizon later.

    An anchor stays if the snapshot before the known one, those at each lag and the one after the horizon all are in its
    segment and none is older (or later) than ``max_age``. Snapshots without symbol or time are none; an anchor's
    changes are null where a descriptor is.
    """
    if not 0 < max_age < max_gap:
        raise ValueError("an age must be positive and below the longest gap")
    told = cut(segments(snapshots, max_gap, columns))
    anchors = regular_anchors(told, horizon)
    seen = known_at(anchors, told, "symbol", "anchor", {"pre": 0} | {n: -k for n, k in lags.items()}, "t", "t")
    fresh = [(F.col("anchor") - k - F.col(f"{n}.t") <= max_age) & (F.col(f"{n}.segment") == F.col("pre.segment")) for n, k in ({"pre": 0} | lags).items()]
    kept = seen.where(_all([F.col("pre.t") > F.col("pre.segment"), *fresh]))
    rows = kept.withColumn("__target", F.col("anchor") + horizon)
    found = asof_forward(rows, told.select("symbol", "t", "segment", "now"), "symbol", "__target", "t", "t", "post_", max_age=max_age).where("post_segment = pre.segment")
    clock = {"hour": F.pmod(F.col("anchor"), F.lit(DAY_MS)) / DAY_MS, "weekday": F.pmod(F.floor(F.col("anchor") / DAY_MS) + 3, F.lit(7)) / 7}
    turned = [f(2 * 3.141592653589793 * share).alias(f"{name}_{kind}") for name, share in clock.items() for kind, f in (("sin", F.sin), ("cos", F.cos))]
    changes = [(F.col(f"pre.now.{c}") - F.col(f"{at}.{c}")).alias(f"{c}_{name}") for name, at in ({"change": "pre.before_now"} | {n: f"{n}.now" for n in lags}).items() for c in columns]
    return found.select(
        "symbol", "anchor", F.col("pre.t").alias("pre_t"), "post_t", F.floor(F.col("anchor") / DAY_MS).alias("day"), month_of(F.col("anchor")).alias("month"),
        *[F.col(f"pre.now.{c}").alias(c) for c in columns], *changes, *turned, *[F.col(f"post_now.{c}").alias(f"post_{c}") for c in columns],
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def average_uniqueness(decisions: DataFrame, labelled: DataFrame, end: str) -> DataFrame:
    """Labelled decisions with the mean, over the decisions that their label spans, of one over the labels that span them, scaled to mean 1 by symbol.

    ``labelled`` are rows of ``decisions`` (both one for each symbol and time) with the time their label ends. Labels open
    at a decision are a running sum of starts and ends, and the mean is a difference of running sums.
    """
    spans = cut(asof_join(labelled, decisions.select("symbol", F.col("t").alias("last")), "symbol", end, "last", "last", "__"))
    zero, one = F.lit(0), F.lit(1)
    marks = decisions.select("symbol", "t", one.alias("n"), zero.alias("a"), zero.alias("z"))
    marks = marks.unionByName(spans.select("symbol", "t", zero.alias("n"), one.alias("a"), zero.alias("z"))).unionByName(spans.select("symbol", F.col("__last").alias("t"), zero.alias("n"), zero.alias("a"), one.alias("z")))
    times = marks.groupBy("symbol", "t").agg(F.sum("n").alias("n"), F.sum("z").alias("z"), (F.sum("a") - F.sum("z")).alias("step"))
    opened = running_sums(times, "symbol", "t", "t", {"open": "step", "place": "n"}).withColumn("open", F.col("open") + F.col("z"))
    shared = cut(opened.select("symbol", "t", "place", F.when(F.col("open") > 0, 1 / F.col("open")).otherwise(0.0).alias("inverse")))
    counted = cut(running_sum(shared, "symbol", "t", "t", "inverse", "total"))
    first = counted.select("symbol", "t", (F.col("total") - F.col("inverse")).alias("__total"), (F.col("place") - 1).alias("__place"))
    last = counted.select("symbol", F.col("t").alias("__last"), "total", "place")
    unique = spans.join(first, ["symbol", "t"]).join(last, ["symbol", "__last"]).withColumn("__u", (F.col("total") - F.col("__total")) / (F.col("place") - F.col("__place")))
    means = unique.groupBy("symbol").agg(F.avg("__u").alias("__mean"))
    return unique.join(means, "symbol").select(*labelled.columns, (F.col("__u") / F.col("__mean")).alias("uniqueness"))


def _sane(quote: str, t: Column, max_age: int) -> Column:
    q = lambda c: F.col(f"{quote}.{c}")
    age = t - q("event_ms")
    return F.coalesce((age <= max_age) & (q("bid") > 0) & (q("bid") < q("ask")) & (q("bid_qty") > 0) & (q("ask_qty") > 0), F.lit(False))


def crossed(prefix: str, entry: str, exit_: str, cost: float, notional: float, share: float) -> dict[str, Column]:
    """Basis points of crossing the spread both ways, with costs on what each side is worth, and whether the best levels hold the order."""
    a, z = (lambda c: F.col(f"{entry}.{c}")), (lambda c: F.col(f"{exit_}.{c}"))
    bought, sold = z("bid") / a("ask"), z("ask") / a("bid")
    long, short = (bought - 1) * 10_000, (1 - sold) * 10_000
    long_qty, short_qty = notional / a("ask"), notional / a("bid")
    return {
        f"{prefix}_long_gross": long, f"{prefix}_short_gross": short, f"{prefix}_long_net": long - cost * (1 + bought), f"{prefix}_short_net": short - cost * (1 + sold),
        f"{prefix}_long_liquid": F.greatest(long_qty / a("ask_qty"), long_qty / z("bid_qty")) <= share, f"{prefix}_short_liquid": F.greatest(short_qty / a("bid_qty"), short_qty / z("ask_qty")) <= share,
    }


def horizon_path(decisions: DataFrame, quotes: DataFrame, latency: int, horizon: int, cost: float, notional: float, share: float, max_age: int) -> DataFrame:
    """Outcomes between each decision and the one exactly a horizon later on its UTC day, at quotes met after the latency and at those of the moment.

    Decisions are distinct; those whose delayed quote is missing, stale or crossed are none. Outcomes without latency are
    null where either quote of the moment is. ``uniqueness`` weighs decisions whose labels overlap.
    """
    rows = known_at(decisions.where("symbol IS NOT NULL AND t IS NOT NULL").select("symbol", "t").distinct(), quotes, "symbol", "t", {"delayed": latency, "moment": 0}, "event_ms", "update_id")
    rows = cut(rows.where(_sane("delayed", F.col("t") + latency, max_age)).withColumn("at_once", _sane("moment", F.col("t"), max_age)))
    later = rows.select("symbol", (F.col("t") - horizon).alias("t"), F.col("delayed").alias("delayed_exit"), F.col("moment").alias("moment_exit"), F.col("at_once").alias("exit_at_once"))
    pairs = rows.join(later, ["symbol", "t"]).where(F.floor(F.col("t") / DAY_MS) == F.floor((F.col("t") + horizon) / DAY_MS))
    known = F.col("at_once") & F.col("exit_at_once")
    middle = lambda q: (F.col(f"{q}.bid") + F.col(f"{q}.ask")) / 2
    plain = crossed("delayed", "delayed", "delayed_exit", cost, notional, share)
    moment = {n: F.when(known, c) for n, c in crossed("zero", "moment", "moment_exit", cost, notional, share).items() if "gross" not in n}
    moment |= {n: F.coalesce(c, F.lit(False)) for n, c in moment.items() if n.endswith("liquid")}
    told = pairs.select("symbol", "t", (F.col("t") + horizon).alias("future_t"), ((middle("delayed_exit") / middle("delayed") - 1) * 10_000).alias("delayed_mid_return"), *[c.alias(n) for n, c in (plain | moment).items()], known.alias("zero_valid"))
    told = cut(told)
    weighed = average_uniqueness(rows.select("symbol", "t"), told.select("symbol", "t", (F.col("t") + horizon + latency).alias("__end")), "__end")
    return told.join(weighed.drop("__end"), ["symbol", "t"])


def horizon_exclusion_counts(path: DataFrame) -> DataFrame:
    """By symbol, how many outcomes the missing quotes of the moment and thin levels would leave out."""
    sides = [(f"{kind}_{side}_thin", F.count_if(seen & ~F.col(f"{kind}_{side}_liquid"))) for kind, seen in (("delayed", F.lit(True)), ("zero", F.col("zero_valid"))) for side in ("long", "short")]
    return path.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(~F.col("zero_valid")).alias("zero_invalid"), *[c.alias(n) for n, c in sides])


def _small(df: DataFrame) -> DataFrame:
    """A table cut and counted; each task gets it whole if it has few rows, else joins with it shuffle."""
    told = cut(df)
    return F.broadcast(told) if told.count() <= FEW else told


def path_payoff(
    actions: DataFrame, path: DataFrame, step: int, horizon: int, protection: int, max_age: int, markouts: dict[str, int], check_gap: bool, adverse: bool, block: int | None = None
) -> DataFrame:
    """Exit of each action along the path of quotes: gap stop, stop, take, both at once, or the horizon; net basis points and markouts.

    ``path`` has a row a step (symbol, t, and least, greatest and last bid and ask); a step is known once it has ended.
    ``actions`` have id (one row each), symbol, t, side (1 or -1), entry, stop and take in basis points, entry_cost and
    exit_cost. Before the ``protection`` only a stop counts, and only if ``check_gap``; it fills at the worst price of its
    step. Later a stop or take fills at its price or worse (the worst of its step if ``adverse``, else the last).
    An action is not valid, and its outcome null, if it would outlive its UTC day or the quote at the protection, at the
    horizon or at a markout is missing or older than ``max_age``.

    Times of the path are multiples of ``step``, so what an action knows depends on its step alone and is asked once for each
    (symbol, step). The first touch is sought in blocks of ``block`` (64 steps): an action meets the extremes of all blocks
    that it lives through in one row, and then reads, one after the other, those that can hold its touch. Only the first
    few can be without one, those that a bound cuts, so that a handful of lookups is exact. No step sorts or groups actions.
    """
    wide = block or 64 * step
    asked = {"__protect": protection, "__fixed": horizon} | {f"__m_{n}": o for n, o in markouts.items()}
    path = cut(path.where("symbol IS NOT NULL AND t IS NOT NULL"))
    at_end = path.select("symbol", (F.col("t") + step).alias("end"), "close_bid", "close_ask")
    # dealt out by id, since a file may be one task
    whole = actions.where("id IS NOT NULL AND symbol IS NOT NULL AND t IS NOT NULL").withColumn("__slot", F.floor(F.col("t") / step) * step)
    steps = {n: o // step * step for n, o in asked.items()} | {f"{n}_over": (o // step + 1) * step for n, o in asked.items() if o % step}
    seen = _small(known_at(whole.select("symbol", "__slot").distinct(), at_end, "symbol", "__slot", steps, "end", "end"))
    rows = whole.repartition("id").join(seen, ["symbol", "__slot"])
    rows = rows.withColumns({n: F.when(F.col("t") - F.col("__slot") + o % step >= step, F.col(f"{n}_over")).otherwise(F.col(n)) for n, o in asked.items() if o % step})
    fresh = _all([F.coalesce(F.col("t") + o - F.col(f"{n}.end") <= max_age, F.lit(False)) for n, o in asked.items()])
    # at least one whole step lies between the protection and the end
    day_end, last = (F.floor(F.col("t") / DAY_MS) + 1) * DAY_MS, F.col("t") + horizon - step
    long = F.col("side") == 1
    stop = F.col("entry") * (1 - F.col("side") * F.col("stop") / 10_000)
    take = F.col("entry") * (1 + F.col("side") * F.col("take") / 10_000)
    start = F.floor((F.col("t") + step - 1) / step) * step if check_gap else F.col("t") + protection
    safe = F.col("t") + protection
    rows = rows.withColumns({"__known": fresh & (F.col("t") + horizon <= day_end) & (F.col("__fixed.end") - step >= safe), "__lo": F.floor(start / wide)})
    hit = lambda q: F.when(long, q["min_bid"] <= stop).otherwise(q["max_ask"] >= stop)
    gain = lambda q: F.when(long, q["max_bid"] >= take).otherwise(q["min_ask"] <= take)
    extremes = [F.min("min_bid").alias("min_bid"), F.max("max_bid").alias("max_bid"), F.min("min_ask").alias("min_ask"), F.max("max_ask").alias("max_ask")]
    held = F.struct("t", "min_bid", "max_bid", "close_bid", "min_ask", "max_ask", "close_ask")
    blocks = _small(path.groupBy("symbol", F.floor(F.col("t") / wide).alias("__b")).agg(*extremes, F.sort_array(F.collect_list(held)).alias("__steps")))
    ahead = blocks.withColumn("__lo", F.explode(F.sequence(F.col("__b") - max(0, (horizon - step) // wide + 1), F.col("__b"))))
    ahead = _small(ahead.groupBy("symbol", "__lo").agg(F.sort_array(F.collect_list(F.struct("__b", "min_bid", "max_bid", "min_ask", "max_ask"))).alias("__ahead")))
    may = F.filter("__ahead", lambda e: (e["__b"] <= F.floor(last / wide)) & (hit(e) | (gain(e) & ((e["__b"] + 1) * wide > safe))))
    # blocks cut by the start, by the end of the protection and by the end, and one that surely holds a touch
    reads = 4 if check_gap else 3
    rows = rows.join(ahead, ["symbol", "__lo"], "left").withColumn("__may", F.when(F.col("__known"), F.slice(may, 1, reads)["__b"])).drop("__ahead")
    rows = rows.withColumn("__x", F.lit(None).cast(path.select(held.alias("x")).schema["x"].dataType))
    for i in range(reads):
        # an action that has nothing to read stays by its own block, so that no key gathers those
        rows = rows.withColumn("__b", F.coalesce(F.get("__may", F.lit(i)), F.col("__lo"))).join(blocks.select("symbol", "__b", "__steps"), ["symbol", "__b"], "left")
        touch = F.get(F.filter("__steps", lambda p: p["t"].between(start, last) & (hit(p) | (gain(p) & (p["t"] >= safe)))), F.lit(0))
        rows = rows.withColumn("__x", F.coalesce("__x", F.when(F.get("__may", F.lit(i)).isNotNull(), touch))).drop("__b", "__steps")
    x = lambda c: F.col(f"__x.{c}")
    stopped = F.when(long, x("min_bid") <= stop).otherwise(x("max_ask") >= stop)
    taken = F.when(long, x("max_bid") >= take).otherwise(x("min_ask") <= take)
    early, trigger = x("t") < F.col("t") + protection, F.when(stopped, stop).otherwise(take)
    worst = F.when(long, x("min_bid")).otherwise(x("max_ask"))
    met = worst if adverse else F.when(long, x("close_bid")).otherwise(x("close_ask"))
    fixed = F.when(long, F.col("__fixed.close_bid")).otherwise(F.col("__fixed.close_ask"))
    price = F.when(F.col("__x").isNull(), fixed).when(early, worst).when(long, F.least(trigger, met)).otherwise(F.greatest(trigger, met))
    kind = F.when(F.col("__x").isNull(), "horizon").when(early, "gap_stop").when(stopped & taken, "ambiguous_stop").when(stopped, "stop").otherwise("take")
    share = price / F.col("entry")
    net = F.col("side") * (share - 1) * 10_000 - F.col("entry_cost") - F.col("exit_cost") * share
    marks = [F.when(F.col("__known") & (F.col("t") + o <= day_end), F.col("side") * (F.when(long, F.col(f"__m_{n}.close_bid")).otherwise(F.col(f"__m_{n}.close_ask")) / F.col("entry") - 1) * 10_000).alias(f"markout_{n}") for n, o in markouts.items()]
    known = lambda c: F.when(F.col("__known"), c)
    return rows.select("id", "symbol", "t", "side", F.col("__known").alias("valid"), known(kind).alias("outcome"), known(F.coalesce(x("t") + step, F.col("t") + horizon)).alias("exit_t"), known(net).alias("net"), *marks)
