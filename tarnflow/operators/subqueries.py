"""Subqueries as joins: IN, ANY, ALL and EXISTS as values in three-valued logic, and scalar subqueries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keyed(inner: DataFrame, correlate: dict[str, str]) -> tuple[list[Column], Column | None]:
    keys = [F.col(i).alias(f"__c{n}") for n, i in enumerate(correlate.values())]
    on = [F.col(o) == F.col(f"__c{n}") for n, o in enumerate(correlate)]
    return keys, reduce(lambda a, b: a & b, on) if on else None


def mark_in(outer: DataFrame, probe: str, inner: DataFrame, value: str, name: str, negate: bool = False, correlate: dict[str, str] | None = None) -> DataFrame:
    """Adds `name` = probe [NOT] IN (SELECT value FROM inner WHERE inner.key = outer.key ...).

    `correlate` maps outer to inner columns. An aggregate gives the rows and nulls of each correlation group, a join on the
    distinct values the hit; without correlation the aggregate is one row, which is broadcast.
    """
    keys, on = _keyed(inner, correlate or {})
    vals = inner.select(*keys, F.col(value).alias("__v"))
    names = [f"__c{n}" for n in range(len(keys))]
    stats = vals.groupBy(*names).agg(F.count("*").alias("__n"), F.count_if(F.col("__v").isNull()).alias("__nulls"))
    hits = vals.where("__v is not null").distinct().withColumn("__hit", F.lit(True))
    out = outer.join(F.broadcast(stats) if on is None else stats, F.lit(True) if on is None else on, "left").drop(*names)
    match = F.col(probe) == F.col("__v")
    out = out.join(hits, match if on is None else match & on, "left")
    mark = F.when(F.coalesce("__n", F.lit(0)) == 0, False).when(F.col(probe).isNull(), None).when(F.col("__hit"), True).when(F.col("__nulls") > 0, None).otherwise(False)
    return out.withColumn(name, ~mark if negate else mark).select(*outer.columns, name)


def quantified(outer: DataFrame, probe: str, op: str, quantifier: str, inner: DataFrame, value: str, name: str, correlate: dict[str, str] | None = None) -> DataFrame:
    """Adds `name` = probe op ANY|ALL (SELECT value FROM inner ...), from minimum, maximum and counts alone."""
    keys, on = _keyed(inner, correlate or {})
    vals = inner.select(*keys, F.col(value).alias("__v"))
    names = [f"__c{n}" for n in range(len(keys))]
    stats = vals.groupBy(*names).agg(F.count("*").alias("__n"), F.count("__v").alias("__k"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    out = outer.join(F.broadcast(stats) if on is None else stats, F.lit(True) if on is None else on, "left")
    p, lo, hi = F.col(probe), F.col("__lo"), F.col("__hi")
    nulls = F.col("__n") > F.col("__k")
    if op == "=" and quantifier == "any":
        return mark_in(outer, probe, inner, value, name, False, correlate)
    if op == "<>" and quantifier == "all":
        return mark_in(outer, probe, inner, value, name, True, correlate)
    if quantifier == "any":
        hit = {"<": p < hi, "<=": p <= hi, ">": p > lo, ">=": p >= lo, "<>": (p != lo) | (p != hi)}[op]
        mark = F.when(F.coalesce("__n", F.lit(0)) == 0, False).when(p.isNull(), None).when(hit, True).when(nulls, None).otherwise(False)
    else:
        miss = {"<": p >= lo, "<=": p > lo, ">": p <= hi, ">=": p < hi, "=": (p != lo) | (p != hi)}[op]
        mark = F.when(F.coalesce("__n", F.lit(0)) == 0, True).when(p.isNull(), None).when(miss, False).when(nulls, None).otherwise(True)
    return out.withColumn(name, mark).select(*outer.columns, name)


def exists(outer: DataFrame, inner: DataFrame, name: str, correlate: dict[str, str], at_least: int = 1, negate: bool = False) -> DataFrame:
    """Adds `name` = [NOT] EXISTS (SELECT ... OFFSET at_least - 1); never null."""
    keys, on = _keyed(inner, correlate)
    names = [f"__c{n}" for n in range(len(keys))]
    n = inner.select(*keys).groupBy(*names).agg(F.count("*").alias("__n"))
    out = outer.join(F.broadcast(n) if on is None else n, F.lit(True) if on is None else on, "left")
    there = F.coalesce("__n", F.lit(0)) >= at_least
    return out.withColumn(name, ~there if negate else there).select(*outer.columns, name)


def scalar(outer: DataFrame, inner: DataFrame, value: str, name: str, correlate: dict[str, str] | None = None) -> DataFrame:
    """Adds the value of a scalar subquery: null without a row, an error for more than one."""
    keys, on = _keyed(inner, correlate or {})
    names = [f"__c{n}" for n in range(len(keys))]
    one = inner.select(*keys, F.col(value).alias("__v")).groupBy(*names).agg(F.count("*").alias("__n"), F.first("__v").alias("__v"))
    out = outer.join(F.broadcast(one) if on is None else one, F.lit(True) if on is None else on, "left")
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row returned by a subquery used as an expression")).cast(inner.schema[value].dataType)).otherwise(F.col("__v"))
    return out.withColumn(name, checked).select(*outer.columns, name)


def correlated_aggregate(outer: DataFrame, inner: DataFrame, aggregate: Column, name: str, correlate: dict[str, str], empty: Column | None = None) -> DataFrame:
    """Adds a correlated scalar aggregate; `empty` is its value over no rows (0 for COUNT)."""
    keys, on = _keyed(inner, correlate)
    names = [f"__c{n}" for n in range(len(keys))]
    agg = inner.select("*", *keys).groupBy(*names).agg(aggregate.alias("__v"), F.lit(True).alias("__there"))
    out = outer.join(agg, on, "left")
    v = F.col("__v") if empty is None else F.when(F.col("__there"), F.col("__v")).otherwise(empty)
    return out.withColumn(name, v).select(*outer.columns, name)
