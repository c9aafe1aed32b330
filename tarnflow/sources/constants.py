"""Constant relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a constant series at most.
SERIES_ROWS = 1024


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """VALUES with declared column types."""
    return spark.createDataFrame(rows, schema)


def single_row(spark: SparkSession, **columns) -> DataFrame:
    """SELECT without FROM."""
    return spark.range(1).select(*[(c if hasattr(c, "alias") else F.lit(c)).alias(n) for n, c in columns.items()])


def generate_series(spark: SparkSession, start: int | None, stop: int | None, step: int | None = 1, name: str = "generate_series", ordinality: str | None = None) -> DataFrame:
    """Whole numbers from start to stop, both included. A null bound gives no rows, as does a step away from stop; step 0 is an error."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    none = start is None or stop is None or step is None or (stop - start) * step < 0
    n = 0 if none else (stop - start) // step + 1
    if n > SERIES_ROWS:
        raise ValueError(f"a constant series has at most {SERIES_ROWS} rows")
    rows = spark.range(n).select((F.lit(start or 0) + F.col("id") * (step or 1)).alias(name), *([(F.col("id") + 1).alias(ordinality)] if ordinality else []))
    return rows
