"""ORDER BY with PostgreSQL's null placement, limits, ties, DISTINCT ON and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(c, desc: bool = False, nulls: str | None = None) -> Column:
    """A sort key: nulls last when ascending and first when descending, unless said otherwise."""
    c = c if isinstance(c, Column) else F.col(c)
    first = desc if nulls is None else nulls == "first"
    if desc:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def whole_tuple(df: DataFrame) -> list[Column]:
    """Tie break by all columns, ascending, nulls first."""
    return [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]


def limit(df: DataFrame, keys: list[Column], n: int | None, offset: int = 0) -> DataFrame:
    """ORDER BY keys LIMIT n OFFSET offset; ties go by the whole tuple. Spark plans it as a distributed top-k."""
    out = df.orderBy(*keys, *whole_tuple(df))
    out = out.offset(offset) if offset else out
    return out if n is None else out.limit(n)


def with_ties(df: DataFrame, keys: list[tuple], n: int, offset: int = 0) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES after an offset; keys are arguments of `key`.

    A top-k of n + offset rows gives the last row's keys, and a broadcast of that one row finds its ties, so
    no window spans the table.
    """
    if n <= 0:
        return df.limit(0)
    parts = [k if isinstance(k, tuple) else (k,) for k in keys]
    names = [f"__k{k}" for k in range(len(parts))]
    own = df.select("*", *[(p[0] if isinstance(p[0], Column) else F.col(p[0])).alias(x) for p, x in zip(parts, names, strict=True)])
    order = [*[key(x, *p[1:]) for p, x in zip(parts, names, strict=True)], *whole_tuple(df)]
    top = own.orderBy(*order).limit(n + offset).withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    edge = F.broadcast(top.where(F.col("__n") == n + offset).select(F.struct(*names).alias("__edge")))
    tie = F.struct(*names).eqNullSafe(F.col("__edge"))
    # before the last row's keys come rows of the top-k only; with them, all rows but those under the offset
    lower = top.where(F.col("__n") > offset).join(edge, tie, "left_anti")
    tied = own.join(edge, tie, "left_semi").select(df.columns)
    if offset:
        tied = tied.exceptAll(top.where(F.col("__n") <= offset).join(edge, tie, "left_semi").select(df.columns))
    return lower.select(df.columns).unionAll(tied)


def distinct_on(df: DataFrame, on: list[str], keys: list[Column]) -> DataFrame:
    """First row of each group of `on` by `keys`, then the whole tuple."""
    return top_per_group(df, on, keys, 1)


def top_per_group(df: DataFrame, by: list[str], keys: list[Column], k: int, ties: bool = False) -> DataFrame:
    """First k rows (`ties`: ranks) of each group. Spark limits each group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*keys, *([] if ties else whole_tuple(df)))
    n = F.rank() if ties else F.row_number()
    return df.withColumn("__n", n.over(w)).where(F.col("__n") <= k).drop("__n")
