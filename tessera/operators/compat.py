"""The few semantics of the surveyed system that differ from standard SQL and are deliberate, as building blocks.

Two-valued comparison: null equals null and differs from any value. Sums and averages of no rows are zero. Set operations
chain to the right with equal precedence. Negative LAG and LEAD offsets are zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal(col: str, value) -> Column:
    return F.col(col).eqNullSafe(F.lit(value))


def different(col: str, value) -> Column:
    return ~equal(col, value)


def sum_or_zero(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def avg_or_zero(col: str) -> Column:
    return F.coalesce(F.avg(col), F.lit(0.0))


def not_in(left: DataFrame, col: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN where a null on the right excludes only nulls on the left."""
    r = right.select(F.col(other).alias("__tsr_o"))
    return left.join(r, F.col(col).eqNullSafe(F.col("__tsr_o")), "left_anti")


def join_null_keys(left: DataFrame, right: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys."""
    return left.join(right, left[a].eqNullSafe(right[b]), how)


SET_OPS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "UNION ALL": lambda a, b: a.union(b),
    "UNION": lambda a, b: a.union(b).distinct(),
    "INTERSECT": lambda a, b: a.intersect(b),
    "EXCEPT": lambda a, b: a.subtract(b),
}


def right_chain(first: DataFrame, rest: list[tuple[str, DataFrame]]) -> DataFrame:
    """a op1 (b op2 (c ...))"""
    if not rest:
        return first
    (op, df), *more = rest
    return SET_OPS[op](first, right_chain(df, more))


def left_chain(first: DataFrame, rest: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(lambda a, x: SET_OPS[x[0]](a, x[1]), rest, first)


def shift(kind: str, col: str, n: int, window) -> Column:
    """LAG or LEAD with a negative offset held at the current row."""
    return {"lag": F.lag, "lead": F.lead}[kind](col, max(n, 0)).over(window)
