"""Factor programs: arithmetic over named columns, checked and turned into Spark columns."""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest absolute constant, number of nodes and depth of a program.
CONSTANT, NODES, DEPTH = 10_000.0, 128, 24

#: Functions a program may call and how many arguments each takes.
CALLS = {
    "abs": (1, F.abs),
    "clip": (3, lambda x, a, b: F.greatest(a, F.least(b, x))),
    "maximum": (2, F.greatest),
    "minimum": (2, F.least),
    "safe_divide": (2, lambda a, b: F.when(F.abs(b) > 1e-12, a / b).otherwise(0.0)),
    "sign": (1, F.signum),
    "tanh": (1, F.tanh),
}
OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b}


def factor(program: str, units: Mapping[str, str]) -> tuple[Column, str | None]:
    """The column of a program and its unit; None for a plain number. ``units`` names the columns it may use.

    Sums, limits and comparisons need one unit on both sides; a product keeps the unit of the one side that has one, a
    quotient of equal units has none.
    """
    tree = ast.parse(program, mode="eval")
    if sum(1 for _ in ast.walk(tree)) > NODES:
        raise ValueError("the program is too long")

    def same(*own: str | None) -> str | None:
        named = {u for u in own if u}
        if len(named) > 1:
            raise ValueError(f"units differ: {sorted(named)}")
        return named.pop() if named else None

    def build(node: ast.AST, depth: int) -> tuple[Column, str | None]:
        if depth > DEPTH:
            raise ValueError("the program is too deep")
        match node:
            case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) and abs(v) <= CONSTANT:
                return F.lit(float(v)), None
            case ast.Name(id=name) if name in units:
                return F.col(name).cast("double"), units[name] or None
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                value, unit = build(inner, depth + 1)
                return -value, unit
            case ast.BinOp(left=a, op=op, right=b) if type(op) in OPERATORS:
                (x, u), (y, v) = build(a, depth + 1), build(b, depth + 1)
                if isinstance(op, ast.Mult):
                    if u and v:
                        raise ValueError("a product of two units has none of its own")
                    return x * y, u or v
                return OPERATORS[type(op)](x, y), same(u, v)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in CALLS and len(args) == CALLS[name][0]:
                values, own = zip(*(build(a, depth + 1) for a in args), strict=True)
                if name == "safe_divide":
                    if own[1] and own[0] != own[1]:
                        raise ValueError("a quotient of different units")
                    return CALLS[name][1](*values), own[0] if not own[1] else None
                if name in ("sign", "tanh"):
                    return CALLS[name][1](*values), None
                return CALLS[name][1](*values), same(*own)
        raise ValueError(f"not allowed in a factor program: {ast.unparse(node) if isinstance(node, ast.expr) else node}")

    return build(tree.body, 0)


def factor_columns(df: DataFrame, programs: Mapping[str, str], units: Mapping[str, str]) -> DataFrame:
    """The rows with a column for each program; what is not finite becomes 0."""
    made = {}
    for name, program in programs.items():
        value, _ = factor(program, units)
        made[name] = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value).otherwise(0.0)
    return df.withColumns(made)
