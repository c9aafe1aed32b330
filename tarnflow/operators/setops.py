"""Set operations on whole tuples; nulls are equal. Columns align by position, with the left names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise ValueError("each side must have the same number of columns")
    return right.toDF(*left.columns)


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionAll(_aligned(left, right))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return union_all(left, right).distinct()


def intersect(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    right = _aligned(left, right)
    return left.intersectAll(right) if all else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    right = _aligned(left, right)
    return left.exceptAll(right) if all else left.subtract(right)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def weighted(left: DataFrame, right: DataFrame, rule: str) -> DataFrame:
    """The same operations with one aggregate over both inputs, map-side combined: counts L and R per tuple, then a rule."""
    cols = left.columns
    both = left.withColumn("__l", F.lit(1)).unionAll(_aligned(left, right).withColumn("__l", F.lit(0)))
    n = both.groupBy(*cols).agg(F.sum("__l").alias("l"), F.sum(1 - F.col("__l")).alias("r"))
    count = {"union all": F.col("l") + F.col("r"), "union": F.lit(1), "intersect all": F.least("l", "r"), "intersect": F.least("l", "r", F.lit(1)), "except all": F.greatest(F.col("l") - F.col("r"), F.lit(0)), "except": F.when(F.col("r") == 0, 1).otherwise(0)}[rule]
    return n.withColumn("__n", count).where("__n > 0").select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))).alias("__n")).drop("__n")
