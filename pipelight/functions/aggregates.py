"""Aggregate functions by name; SQL null rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed alternative names.
ALIASES = {
    "mean": "avg", "stdev": "stddev", "stddev_samp": "stddev", "stdevp": "stddev_pop", "var": "variance", "var_samp": "variance", "varp": "var_pop", "dc": "distinct_count", "cardinality": "distinct_count", "estdc": "approx_count_distinct", "perc": "percentile",
}


def percentile(x: Column, p) -> Column:
    return F.percentile(x, float(p) / 100)


def percentile_disc(name: str, p) -> Column:
    """The least value of a column, which must be named, that p percent of the values don't exceed; exact."""
    return F.expr(f"percentile_disc({float(p) / 100}D) WITHIN GROUP (ORDER BY `{name}`)")


def build(name: str, args: list, distinct: bool, order: list[Column], time: str | None) -> Column:
    """name(args) as an aggregate Column.

    order has the values that rise from the first row to the last; time names the column for earliest
    and latest (ties go by order).
    """
    key = ALIASES.get(name.lower(), name.lower())
    x = args[0] if args else None
    by_order = F.struct(*order) if order else None
    by_time = F.struct(*([F.col(time)] if time else []), *order) if time or order else None
    simple: dict[str, Callable] = {
        "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "stddev_pop": F.stddev_pop, "variance": F.variance, "var_pop": F.var_pop,
        "distinct_count": F.count_distinct, "approx_count_distinct": F.approx_count_distinct, "median": F.median, "mode": lambda c: F.mode(c, True), "values": lambda c: F.array_sort(F.collect_set(c)), "list": F.collect_list,
        "range": lambda c: F.max(c) - F.min(c),
    }
    if key == "count":
        return F.count(F.lit(1)) if x is None else F.count_distinct(x) if distinct else F.count(x)
    if x is None:
        raise ValueError(f"{name} takes an argument")
    if key in simple:
        return F.sum_distinct(x) if distinct and key == "sum" else simple[key](x)
    if key in ("percentile", "percentile_approx"):
        p = args[1] if len(args) > 1 else 50
        return percentile(x, p) if key == "percentile" else F.percentile_approx(x, float(p) / 100)
    if key in ("first", "last"):
        return F.first(x) if by_order is None and key == "first" else F.last(x) if by_order is None else (F.min_by if key == "first" else F.max_by)(x, by_order)
    if key in ("earliest", "latest"):
        if by_time is None:
            raise ValueError(f"{name} needs a time column")
        return (F.min_by if key == "earliest" else F.max_by)(x, by_time)
    raise ValueError(f"unknown aggregate {name}")


NAMES = frozenset("count sum avg min max stddev stddev_pop variance var_pop distinct_count approx_count_distinct percentile percentile_approx median values list first last earliest latest mode range".split()) | frozenset(ALIASES)
