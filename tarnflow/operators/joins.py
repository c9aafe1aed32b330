"""Joins. Null keys never match unless said otherwise; Catalyst picks the physical join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal


def using(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: one merged column per key (the non-null side's), then the rest of left and right."""
    return left.join(right, keys, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on all common names, in left order; a cross join if there are none."""
    keys = [c for c in left.columns if c in right.columns]
    return left.join(right, keys, how) if keys else left.crossJoin(right)


def on(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Equi, theta, band and residual conditions alike. Equality conjuncts become the join's keys."""
    return left.join(right, condition, how)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def semi(left: DataFrame, right: DataFrame, condition) -> DataFrame:
    """EXISTS; left rows keep their multiplicity."""
    return left.join(right, condition, "left_semi")


def anti(left: DataFrame, right: DataFrame, condition) -> DataFrame:
    """NOT EXISTS."""
    return left.join(right, condition, "left_anti")


def band(left: DataFrame, right: DataFrame, keys: list[str], at: str, low: str, high: str, width: int, slices: int = 1) -> DataFrame:
    """Rows of `left` whose whole number `at` lies in right's low..high, both included, for equal keys.

    The range is cut into buckets of `width`, so this is an equi-join on keys and bucket instead of a comparison of all pairs;
    choose `width` about the usual high - low. A right row is copied to each bucket it touches, a left row goes to one.

    Where keys and buckets are few and meet in very many pairs, left's rows of each are dealt to `slices` and right's are copied to all of them, so
    that the pairs are made by several times as many tasks as there are cores, however small the inputs. Neither side is held as a whole.
    """
    l = left.withColumn("__b", F.floor(F.col(at) / width))
    r = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    r = r.where(F.col(low) <= F.col(high))
    on = [*keys, "__b"]
    if slices > 1:
        on.append("__s")
        l = l.withColumn("__s", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(slices)).cast("int"))
        r = r.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).hint("merge")
        spark = left.sparkSession
        l = l.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *on)
    return l.join(r, on).where(F.col(at).between(F.col(low), F.col(high))).drop("__b", "__s")


def predecessor(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tie: list[str], take: dict[str, str], strict: bool = False, bucket_us: int = temporal.DAY) -> DataFrame:
    """As-of left join: each left row with the last right row of its keys at or before (`strict`: before) its time.

    Of right rows at one time the first by `tie` (the right side's key) counts. `take` maps right columns to names in the
    result; they are null without a predecessor, and left rows keep their multiplicity. Both sides are cut
    into (keys, time bucket) groups: within a group a window carries the last right row forward, and a
    second window, over one row for each group, brings in the last row of earlier buckets. So a hot key is
    as many tasks as it has buckets. Rows with null keys or times match nothing.
    """
    value = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    bucket = lambda c: F.floor(temporal.micros(c) / bucket_us)
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, right_at]])
    ranked = right.where(usable).select(*keys, F.col(right_at).alias("__t"), *[F.col(t).alias(f"__k{n}") for n, t in enumerate(tie)], value.alias("__v"))
    one = ranked.groupBy(*keys, "__t").agg(F.min_by("__v", F.struct(*[f"__k{n}" for n in range(len(tie))])).alias("__v"))
    one = one.withColumn("__b", bucket("__t"))
    last = one.groupBy(*keys, "__b").agg(F.max_by("__v", "__t").alias("__v"))
    l = left.withColumn("__b", bucket(left_at)).withColumn("__left", F.struct(*left.columns))
    marks = l.select(*keys, "__b").distinct().withColumn("__v", F.lit(None).cast(last.schema["__v"].dataType)).withColumn("__o", F.lit(0))
    marks = marks.unionByName(last.withColumn("__o", F.lit(1)))
    # in a bucket, left's mark stands before right's last row, so it sees earlier buckets only
    seen = marks.withColumn("__p", F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__b", "__o").rowsBetween(Window.unboundedPreceding, -1))).where("__o = 0")
    rows = l.select(*keys, "__b", F.col(left_at).alias("__t"), "__left", F.lit(None).cast(last.schema["__v"].dataType).alias("__v"), F.lit(0 if strict else 1).alias("__o"))
    rows = rows.unionByName(one.select(*keys, "__b", "__t", F.lit(None).cast(l.schema["__left"].dataType).alias("__left"), "__v", F.lit(1 if strict else 0).alias("__o")))
    carried = rows.withColumn("__n", F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys, "__b").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__left").isNotNull())
    seen = seen.select(*[F.col(k).alias(f"__s{n}") for n, k in enumerate(keys)], F.col("__b").alias("__sb"), "__p")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__s{n}")) for n, k in enumerate(keys)] + [F.col("__b").eqNullSafe(F.col("__sb"))])
    out = carried.join(seen, same, "left").withColumn("__r", F.coalesce("__n", "__p"))
    fits = reduce(lambda a, b: a & b, [F.col(f"__left.{k}").isNotNull() for k in [*keys, left_at]])
    return out.select("__left.*", *[F.when(fits, F.col(f"__r.{n}")).alias(n) for n in take.values()])
