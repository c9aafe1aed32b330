"""Window functions and frames that Spark's SQL lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_rank(by: list, keys: list[Column]) -> Column:
    """Number of the peer group; a RANGE frame over it is a GROUPS frame."""
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(*keys))


def with_groups_frame(df: DataFrame, by: list, keys: list[Column], start: int, end: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND end (negative: preceding; Window.unbounded... allowed)."""
    w = Window.partitionBy(*by).orderBy("__g").rangeBetween(start, end)
    return df.withColumn("__g", groups_rank(by, keys)).select(*df.columns, *[a.over(w).alias(n) for n, a in aggregates.items()])


def exclude(df: DataFrame, by: list, keys: list[Column], start: int, end: int, what: str, value: str, names: tuple[str, str] = ("n", "total"), frame: str = "rows") -> DataFrame:
    """COUNT(value) and SUM(value) over a ROWS or GROUPS frame with EXCLUDE CURRENT ROW, GROUP or TIES.

    The excluded rows' share is subtracted, so both are running sums and no frame is collected. Peers are cut to the
    frame: with ROWS a row's peers are subtracted only as far as the frame reaches.
    """
    by = by or [F.lit(1)]
    order = Window.partitionBy(*by).orderBy(*keys)
    own = df.withColumn("__v", F.col(value)).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*keys, *[F.col(c).asc_nulls_first() for c in df.columns]))).withColumn("__g", F.dense_rank().over(order))
    pos = "__r" if frame == "rows" else "__g"
    w = Window.partitionBy(*by).orderBy(pos).rangeBetween(start, end)
    in_frame = F.lit(start <= 0 <= end)
    n, s = F.count("__v").over(w), F.sum("__v").over(w)
    one_n, one_s = F.when(in_frame & F.col("__v").isNotNull(), 1).otherwise(0), F.when(in_frame, F.coalesce("__v", F.lit(0))).otherwise(0)
    if frame == "rows":
        peers = Window.partitionBy(*by, "__g").orderBy("__r").rangeBetween(start, end)
        peer_n, peer_s = F.count("__v").over(peers), F.coalesce(F.sum("__v").over(peers), F.lit(0))
    else:
        peers = Window.partitionBy(*by, "__g")
        peer_n, peer_s = F.when(in_frame, F.count("__v").over(peers)).otherwise(0), F.when(in_frame, F.coalesce(F.sum("__v").over(peers), F.lit(0))).otherwise(0)
    less = {"current row": (one_n, one_s), "group": (peer_n, peer_s), "ties": (peer_n - one_n, peer_s - one_s), "no others": (F.lit(0), F.lit(0))}[what]
    out = own.withColumn("__n", n - less[0]).withColumn("__s", F.coalesce(s, F.lit(0)) - less[1])
    return out.select(*df.columns, F.col("__n").alias(names[0]), F.when(F.col("__n") > 0, F.col("__s")).alias(names[1]))


def ntile(df: DataFrame, by: list, keys: list[Column], n: Column, name: str = "tile") -> DataFrame:
    """NTILE with a number per partition, taken from its first row with a non-null one."""
    by = by or [F.lit(1)]
    w = Window.partitionBy(*by).orderBy(*keys)
    whole = Window.partitionBy(*by)
    own = df.withColumn("__k", F.row_number().over(w) - 1).withColumn("__c", F.count(F.lit(1)).over(whole))
    own = own.withColumn("__b", F.first(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    size, rest = F.floor(F.col("__c") / F.col("__b")), F.col("__c") % F.col("__b")
    big = rest * (size + 1)
    tile = F.when(F.col("__k") < big, F.floor(F.col("__k") / (size + 1))).otherwise(rest + F.floor((F.col("__k") - big) / F.greatest(size, F.lit(1)))) + 1
    return own.withColumn(name, tile.cast("int")).drop("__k", "__c", "__b")


def shifted(df: DataFrame, by: list[str], keys: list[Column], value: str, offset: Column, default: Column | None = None, name: str = "shifted") -> DataFrame:
    """LAG with an offset of each row's own (negative: LEAD), by a join on row numbers.

    A null offset gives null; beyond the partition the default.
    """
    own = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).withColumn("__o", offset)
    other = own.select(*[F.col(c).alias(f"__p{k}") for k, c in enumerate(by)], F.col("__r").alias("__t"), F.col(value).alias("__x"), F.lit(True).alias("__hit"))
    on = F.col("__r") - F.col("__o") == F.col("__t")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{k}"))
    out = own.join(other, on, "left")
    got = F.when(F.col("__o").isNull(), F.lit(None)).when(F.col("__hit"), F.col("__x"))
    got = got if default is None else got.otherwise(default)
    return out.select(*df.columns, got.alias(name))


def nth_value(df: DataFrame, by: list[str], keys: list[Column], value: str, n: Column, name: str = "nth") -> DataFrame:
    """NTH_VALUE over the default frame with a position of each row's own: the row's frame ends with its last peer."""
    w = Window.partitionBy(*by).orderBy(*keys)
    own = df.withColumn("__r", F.row_number().over(w)).withColumn("__e", F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__n", n)
    other = own.select(*[F.col(c).alias(f"__p{k}") for k, c in enumerate(by)], F.col("__r").alias("__t"), F.col(value).alias("__x"))
    on = (F.col("__n") == F.col("__t")) & (F.col("__n") <= F.col("__e"))
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{k}"))
    return own.join(other, on, "left").select(*df.columns, F.col("__x").alias(name))


def sessions(df: DataFrame, by: list[str], at: str, gap_us: int, tie: list[str], name: str = "session") -> DataFrame:
    """Numbers the sessions of each group: a row starts one unless it is less than `gap_us` after the row before it."""
    w = Window.partitionBy(*by).orderBy(at, *tie)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    start = F.when(us - F.lag(us).over(w) < gap_us, 0).otherwise(1)
    return df.withColumn("__s", start).withColumn(name, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
