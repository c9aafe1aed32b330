"""Structured Streaming: a change log of files drives views, a micro-batch a tick."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.changes import WEIGHT
from .graph import Source, View

#: Columns of a log file: the source's name, the row as JSON, and its weight.
LOG_SCHEMA = f"source string, row string, {WEIGHT} bigint"
#: The source's name in a log row that stands for a folder of log rows, whose path is the row.
FOLDER = "__folder"


def encode_log(deltas: dict[str, DataFrame]) -> DataFrame:
    """The changes of one transaction as log rows; `append` writes them so that they are read in one tick."""
    out = None
    for name, d in deltas.items():
        part = d.select(F.lit(name).alias("source"), F.to_json(F.struct(*[c for c in d.columns if c != WEIGHT]), {"ignoreNullFields": "false"}).alias("row"), WEIGHT)
        out = part if out is None else out.union(part)
    return out


def decode_log(log: DataFrame, sources: list[Source]) -> dict[str, DataFrame]:
    """The rows of each source with their declared types."""
    return {s.name: log.where(F.col("source") == s.name).select(F.from_json("row", s.schema, {"mode": "FAILFAST"}).alias("r"), WEIGHT).select("r.*", WEIGHT) for s in sources}


def append(spark: SparkSession, log_dir: str, log: DataFrame) -> None:
    """Adds a transaction to a log folder: its rows in as many files as they have tasks, and then the one file that counts, which names them."""
    rows = f"{log_dir.rstrip('/')}/_rows/{uuid.uuid4().hex}"  # streams don't look into folders of such names
    log.write.partitionBy("source").parquet(rows)
    spark.range(1).select(F.lit(FOLDER).alias("source"), F.lit(rows).alias("row"), F.lit(None).cast("long").alias(WEIGHT)).coalesce(1).write.mode("append").parquet(log_dir)


def unfolded(spark: SparkSession, batch: DataFrame) -> DataFrame:
    """The log rows of a batch, those in folders included."""
    folders = [r.row for r in batch.where(F.col("source") == FOLDER).select("row").collect()]  # a row each transaction
    if not folders:
        return batch
    parts = [spark.read.schema(LOG_SCHEMA).parquet(f) for f in folders]
    own = batch.where(F.col("source") != FOLDER)
    return reduce(DataFrame.unionByName, parts if own.isEmpty() else [*parts, own])


def start(spark: SparkSession, log_dir: str, views: list[View], checkpoint: str, files_per_tick: int = 1, available_now: bool = False, on_change=None) -> StreamingQuery:
    """Follows a log folder. The batch id is the tick, and a batch that is replayed after a failure finds its tick committed.

    There is no watermark: late inserts, updates and deletes revise earlier results. `on_change(view, tick, delta)` is
    called after each commit.
    """

    def run(batch: DataFrame, tick: int) -> None:
        batch.persist()
        try:
            log = unfolded(spark, batch)
            for view in views:
                own = [n for n in view.nodes if isinstance(n, Source)]
                delta = view.step(tick, decode_log(log, own))
                if on_change:
                    on_change(view, tick, delta)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_tick).parquet(log_dir)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
