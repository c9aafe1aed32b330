"""Predicates in three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UPPER, LOWER, _c, _i


def distinct_from(a, b) -> Column:
    return ~_c(a).eqNullSafe(_i(b))


def not_distinct_from(a, b) -> Column:
    return _c(a).eqNullSafe(_i(b))


def is_true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def is_false(p: Column) -> Column:
    return F.coalesce(~p, F.lit(False))


def is_unknown(p: Column) -> Column:
    return p.isNull()


def like(x, pattern: str, escape: str = "\\") -> Column:
    """Whole-text match with % and _."""
    return F.like(_c(x), F.lit(pattern), F.lit(escape))


def ilike(x, pattern: str, escape: str = "\\") -> Column:
    """Folds the case of ASCII letters only."""
    return F.like(F.translate(_c(x), UPPER, LOWER), F.lit(pattern.translate(str.maketrans(UPPER, LOWER))), F.lit(escape))


def in_list(x, *values) -> Column:
    """Null if nothing matches and x or a value is null."""
    x = _c(x)
    return reduce(lambda a, b: a | b, [x == _i(v) for v in values])


def row_compare(op: str, left: list, right: list) -> Column:
    """Row comparison with = <> < <= > >=, field by field from the first, in three-valued logic."""
    pairs = [(_c(a), _i(b)) for a, b in zip(left, right, strict=True)]
    if op in ("=", "<>"):
        same = reduce(lambda a, b: a & b, [a == b for a, b in pairs])
        return same if op == "=" else ~same
    a, b = pairs[-1]
    out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    for a, b in reversed(pairs[:-1]):
        out = F.when(a == b, out).when(a != b, a < b if op[0] == "<" else a > b)
    return out
