"""Aggregates whose Spark counterparts differ from PostgreSQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def sum_exact(x, scale: int = 0) -> Column:
    """Sum as numeric: whole-number sums don't overflow at 64 bits."""
    return F.sum(_c(x).cast(f"decimal(38,{scale})"))


def avg_exact(x, scale: int = 0, digits: int = 6) -> Column:
    """Exact mean, rounded half away from zero to `digits` places."""
    return F.round(sum_exact(x, scale).cast(f"decimal(28,{scale})") / F.count(_c(x)).cast("decimal(18,0)"), digits)


def bool_and(p) -> Column:
    return F.bool_and(_c(p))


every = bool_and


def bool_or(p) -> Column:
    return F.bool_or(_c(p))


def where(x: Column, p: Column) -> Column:
    """Argument of an aggregate with FILTER (WHERE p)."""
    return F.when(p, x)


def string_agg(x, delimiter=",", order_by: list[Column] | None = None, distinct: bool = False, filter: Column | None = None) -> Column:
    """Texts joined in order, each but the first behind its own row's delimiter; null texts are skipped.

    `delimiter` may be a Column; a null one joins without anything between. Ties of the order fall back to text, then
    delimiter. Null if no text is left.
    """
    x = _c(x).cast("string")
    d = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    keep = x.isNotNull() if filter is None else x.isNotNull() & filter
    keys = [k.alias(f"k{n}") for n, k in enumerate(order_by or [])]
    row = F.when(keep, F.struct(*keys, x.alias("x"), d.alias("d")))
    rows = F.sort_array(F.collect_set(row) if distinct else F.collect_list(row))
    joined = F.aggregate(rows, F.lit(None).cast("string"), lambda s, r: F.when(s.isNull(), r["x"]).otherwise(F.concat(s, F.coalesce(r["d"], F.lit("")), r["x"])))
    return joined


def grouping_mask(*columns: str) -> Column:
    """GROUPING(a, b, ...): the last argument is the lowest bit."""
    n = len(columns)
    out = F.lit(0)
    for k, c in enumerate(columns):
        out = out + F.grouping(c).cast("int") * (1 << (n - 1 - k))
    return out
