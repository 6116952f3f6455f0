"""Order-book arithmetic over arrays of (price, qty) levels, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth(levels: Column, n: int) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda acc, x: acc + x["qty"])


def imbalance(bids: Column, asks: Column, n: int) -> Column:
    b, a = depth(bids, n), depth(asks, n)
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0)


def walk(levels: Column, qty: Column) -> Column:
    """Average price of taking ``qty`` from the levels in order; null where they hold less."""
    start = F.struct(qty.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(acc["left"], x["qty"])
        return F.struct((acc["left"] - take).alias("left"), (acc["cost"] + take * x["price"]).alias("cost"))

    return F.aggregate(levels, start, step, lambda acc: F.when(acc["left"] <= 1e-12, acc["cost"] / qty))


def walk_detail(levels: Column, qty: Column) -> Column:
    """(average price, worst price, levels used) of taking ``qty``; all null where the levels hold less."""
    start = F.struct(qty.cast("double").alias("left"), F.lit(0.0).alias("cost"), F.lit(None).cast("double").alias("worst"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(acc["left"], x["qty"])
        some = take > 0
        return F.struct((acc["left"] - take).alias("left"), (acc["cost"] + take * x["price"]).alias("cost"), F.when(some, x["price"]).otherwise(acc["worst"]).alias("worst"), (acc["used"] + some.cast("int")).alias("used"))

    return F.aggregate(levels, start, step, lambda acc: F.when(acc["left"] <= 1e-12, F.struct((acc["cost"] / qty).alias("price"), acc["worst"].alias("worst"), acc["used"].alias("used"))))


def walk_limit(levels: Column, qty: Column, limit: Column, rate: float) -> Column:
    """(average price, fees) of taking ``qty`` from asks up to a limit, each level paying rate * p * (1 - p) on its part; null where too little is there."""
    start = F.struct(qty.cast("double").alias("left"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("fee"))

    def step(acc: Column, x: Column) -> Column:
        take = F.when(x["price"] <= limit, F.least(acc["left"], x["qty"])).otherwise(0.0)
        return F.struct((acc["left"] - take).alias("left"), (acc["cost"] + take * x["price"]).alias("cost"), (acc["fee"] + take * rate * x["price"] * (1 - x["price"])).alias("fee"))

    return F.aggregate(levels, start, step, lambda acc: F.when(acc["left"] <= 1e-12, F.struct((acc["cost"] / qty).alias("price"), acc["fee"].alias("fee"))))


def quote_impact(levels: Column, quote: float, sign: int) -> Column:
    """Basis points by which the average price of taking ``quote`` of notional is worse than the best; 0 for no levels."""
    start = F.struct(F.lit(quote).alias("left"), F.lit(0.0).alias("quote"), F.lit(0.0).alias("qty"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(acc["left"], x["price"] * x["qty"])
        return F.struct((acc["left"] - take).alias("left"), (acc["quote"] + take).alias("quote"), (acc["qty"] + take / x["price"]).alias("qty"))

    worse = F.aggregate(levels, start, step, lambda acc: F.when(acc["qty"] > 0, sign * (acc["quote"] / acc["qty"] / levels[0]["price"] - 1) * 10_000))
    return F.greatest(F.lit(0.0), F.coalesce(worse, F.lit(0.0)))


def depth_shape(levels: Column) -> Column:
    """Slope and convexity of log cumulative depth over the distance from the best price, by least squares on (1, x, x^2)."""
    best, far = levels[0]["price"], F.abs(F.element_at(levels, -1)["price"] - levels[0]["price"])
    names = ("depth", "n", "x", "x2", "x3", "x4", "y", "xy", "x2y")

    def step(acc: Column, level: Column) -> Column:
        depth = acc["depth"] + level["qty"]
        once = F.struct((F.abs(level["price"] - best) / far).alias("x"), F.log1p(depth).alias("y"), depth.alias("depth"))

        def add(v: Column) -> Column:
            x, y = v["x"], v["y"]
            new = (v["depth"], acc["n"] + 1, acc["x"] + x, acc["x2"] + x * x, acc["x3"] + x * x * x, acc["x4"] + x * x * x * x, acc["y"] + y, acc["xy"] + x * y, acc["x2y"] + x * x * y)
            return F.struct(*[c.alias(k) for k, c in zip(names, new, strict=True)])

        return F.transform(F.array(once), add)[0]

    def solve(s: Column) -> Column:
        n, x, x2, x3, x4, y, xy, x2y = (s[k] for k in names[1:])
        det = n * (x2 * x4 - x3 * x3) - x * (x * x4 - x3 * x2) + x2 * (x * x3 - x2 * x2)
        b = n * (xy * x4 - x3 * x2y) - y * (x * x4 - x3 * x2) + x2 * (x * x2y - xy * x2)
        c = n * (x2 * x2y - xy * x3) - x * (x * x2y - xy * x2) + y * (x * x3 - x2 * x2)
        ok = det != 0
        return F.struct(F.when(ok, b / det).otherwise(0.0).alias("slope"), F.when(ok, c / det).otherwise(0.0).alias("convexity"))

    flat = F.struct(F.lit(0.0).alias("slope"), F.lit(0.0).alias("convexity"))
    return F.when((F.size(levels) < 3) | (far == 0), flat).otherwise(F.aggregate(levels, F.struct(*[F.lit(0.0).alias(k) for k in names]), step, solve))


def _moves(was: Column, now: Column) -> Column:
    """price -> change of quantity between two sides."""
    return F.map_zip_with(F.map_from_entries(was), F.map_from_entries(now), lambda _, a, b: F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0)))


def side_change(was: Column, now: Column) -> Column:
    """What was added to a side and cancelled from it, as shares of its mean depth."""
    moves, mean = F.map_values(_moves(was, now)), (depth(was, 20) + depth(now, 20)) / 2
    added = F.aggregate(moves, F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(0.0)))
    cancelled = F.aggregate(moves, F.lit(0.0), lambda acc, x: acc + F.greatest(-x, F.lit(0.0)))
    return F.struct(F.when(mean > 0, added / mean).otherwise(0.0).alias("added"), F.when(mean > 0, cancelled / mean).otherwise(0.0).alias("cancelled"))


def delta(was: Column, now: Column) -> Column:
    """Levels of ``now`` that differ, with their new quantity; 0 for those that are gone."""
    zero = F.lit(0.0)
    new = F.map_zip_with(F.map_from_entries(was), F.map_from_entries(now), lambda _, a, b: F.when(F.coalesce(a, zero) != F.coalesce(b, zero), F.coalesce(b, zero)))
    return F.transform(F.filter(F.map_entries(new), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("price"), e["value"].alias("qty")))


def rank(levels: Column, price: Column, side: str) -> Column:
    """Place of a price among a side's levels, 1 for the best."""
    return F.size(F.filter(levels, lambda x: x["price"] > price if side == "bid" else x["price"] < price)) + 1
