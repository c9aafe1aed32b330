"""Grouping sets and group operators."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group(df: DataFrame, keys: list, aggregates: list[Column], having: Column | None = None) -> DataFrame:
    """GROUP BY keys; without keys one row, also for an empty input."""
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    return out if having is None else out.where(having)


def rollup(*keys: str) -> list[tuple[str, ...]]:
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def cube(*keys: str) -> list[tuple[str, ...]]:
    return [tuple(k for k, use in zip(keys, bits, strict=True) if use) for bits in product((True, False), repeat=len(keys))]


def products(*parts: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """GROUP BY of several grouping items: the product of their sets."""
    return [tuple(dict.fromkeys(k for part in combo for k in part)) for combo in product(*parts)]


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], aggregates: list[Column], mask: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """One group-by for all sets, by Spark's expansion; repeated sets repeat rows, unless `distinct`.

    The empty set gives its row on an empty input too, which Spark's own grouping sets don't: it is a branch of its own, as
    a global aggregate. `mask` adds `grouping`, the bits of GROUPING(mask...), the last argument lowest.
    """
    if distinct:
        sets = list({frozenset(s): s for s in reversed(sets)}.values())[::-1]
    names = list(dict.fromkeys(k for s in sets for k in s))
    full = [s for s in sets if s]
    out = None
    if full:
        bits = F.lit(0)
        for k, c in enumerate(mask):
            bits = bits + F.grouping(c).cast("int") * (1 << (len(mask) - 1 - k))
        # the id of the set keeps repeated sets apart
        grouped = df.groupingSets([[F.col(c) for c in s] for s in full], *[F.col(c) for c in names])
        out = grouped.agg(*aggregates, *([bits.alias("grouping")] if mask else []))
    for _ in range(sum(not s for s in sets)):
        one = df.agg(*aggregates)
        row = one.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names], *one.columns, *([F.lit((1 << len(mask)) - 1).alias("grouping")] if mask else []))
        out = row if out is None else out.unionByName(row)
    return out
