"""Z-sets: DataFrames with a weight column. Whole tuples are identity; nulls are equal to each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.changes import WEIGHT


def columns(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != WEIGHT]


def of(df: DataFrame, weight: int = 1) -> DataFrame:
    """A bag as a Z-set."""
    return df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def consolidate(z: DataFrame) -> DataFrame:
    """One row for each tuple with a weight other than zero; weights are added exactly (an overflow is an error)."""
    return z.groupBy(*[F.col(f"`{c}`") for c in columns(z)]).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(WEIGHT, -F.col(WEIGHT))


def add(*zs: DataFrame) -> DataFrame:
    """Signed UNION ALL."""
    return reduce(lambda a, b: a.unionByName(b), zs)


def bag(z: DataFrame) -> DataFrame:
    """Physical duplicates instead of weights; a negative weight is an error."""
    low = F.when(F.col(WEIGHT) < 0, F.raise_error(F.lit("a bag has no negative rows")).cast("long")).otherwise(F.col(WEIGHT))
    return z.select(*columns(z), F.explode(F.sequence(F.lit(1).cast("long"), low)).alias("__n")).drop("__n")


def join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join; weights multiply."""
    r = right.withColumnRenamed(WEIGHT, "__w2")
    out = left.join(r, keys) if keys else left.crossJoin(r)
    return out.withColumn(WEIGHT, F.col(WEIGHT) * F.col("__w2")).drop("__w2")


def join_delta(left: DataFrame | None, dl: DataFrame, right: DataFrame, dr: DataFrame, keys: list[str]) -> DataFrame:
    """Change of a join: L x dR + dL x R, from left's state before the change (None: empty) and right's after it."""
    out = join(dl, right, keys)
    return out if left is None else add(out, join(left, dr, keys))


def _among(z: DataFrame, keys: DataFrame, same) -> DataFrame:
    names = keys.columns
    k = keys.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(names)])
    on: Column = reduce(lambda a, b: a & b, [same(F.col(c), F.col(f"__k{n}")) for n, c in enumerate(names)])
    return z.join(k, on, "left_semi")


def restrict(z: DataFrame, keys: DataFrame, dealt: bool = False, null: bool = True) -> DataFrame:
    """Rows whose key columns are among `keys`, nulls included.

    If `z` is `dealt` by these keys, most of it is compared where it lies: a comparison in which nulls are equal would move all of it, so rows
    with nulls go apart, or aren't looked for if it is known that no key has any (`null` is false).
    """
    names = keys.columns
    if not names:
        return z
    if not dealt:
        return _among(z, keys, Column.eqNullSafe)
    plain = _among(z, keys.hint("shuffle_hash"), Column.__eq__)
    if not null:
        return plain
    some = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    return plain.unionByName(_among(z.where(some), keys.where(some), Column.eqNullSafe))


def file_bytes(df: DataFrame, as_read: bool = False) -> int:
    """Bytes of the files that a DataFrame reads; `as_read`: about those of its own columns, where Spark can tell."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    found = [p for p in (leaves.apply(k) for k in range(leaves.size())) if p.getClass().getSimpleName() == "LogicalRelation"]
    size = sum(int(str(p.stats().sizeInBytes())) for p in found)
    return min(size, int(str(plan.stats().sizeInBytes()))) if as_read else size


def spread(z: DataFrame, bytes_a_task: int) -> DataFrame:
    """Rows dealt by the whole tuple to tasks of about so many bytes of its files, where Spark would take fewer."""
    need = file_bytes(z) // bytes_a_task
    return z.repartition(need, *[F.col(f"`{c}`") for c in columns(z)]) if need > int(z.sparkSession.conf.get("spark.sql.shuffle.partitions")) else z
