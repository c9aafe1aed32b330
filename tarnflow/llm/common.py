"""Shared parts of the corpus operators: durable intermediates, components, worker settings."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a worker process keeps from task to task, of one operator at a time.
_kept: dict[str, object] = {}
#: Paths that this driver has written and not deleted.
_written: set[str] = set()


def kept(owner: str, make: Callable[[], object]):
    """What a worker process keeps for the operator `owner`; what another operator has left there is freed first."""
    if owner not in _kept:
        _kept.clear()
        release()
        _kept[owner] = make()
    return _kept[owner]


def release() -> None:
    """Gives freed memory of this process back to the system, as far as its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; in local mode alone one of our own if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints/tarnflow"
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back.

    This cuts lineage without depending on any executor's local disk, and unlike a
    checkpoint the copy is columnar and compressed.
    """
    return _write(df, name)[0]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    _written.add(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
    _written.discard(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this driver's operators have written to the shared folder; their DataFrames can't be read any more."""
    for path in list(_written):
        delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `edges(a, b)` as `(node, component)`, component = smallest node.

    Alternating large-star and small-star rounds: each round only joins and aggregates with
    map-side combine on node ids, so no component is ever gathered in one task, and the
    number of rounds grows with the logarithm of a component's size. Every round is written to the
    shared folder. Stops when a round changes nothing. Self loops and nulls are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    # kept as child -> smaller neighbour
    e, path = _write(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(d: DataFrame):
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest of the closed neighbourhood
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour and the node itself are linked to the smallest
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old = path
        e, path = _write(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        delete(spark, old)  # nothing reads the round before any more
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))


def tokenizer_path(name: str) -> str:
    """`name` itself if it is a file, else the file of that name among the installed public vocabularies."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def filter_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of `docs`, all columns as they are whatever their names; `keep` gets record batches and the text's place and yields parts of them."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(lambda batches: keep(batches, at), plain.schema).toDF(*docs.columns)
