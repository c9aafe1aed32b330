"""Change logs: committed transactions of inserts, updates and deletes as weighted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHT = "__w"


def as_updates(log: DataFrame) -> DataFrame:
    """A log of `(op, old, new, ...)` with op one of insert, update, delete to weighted rows.

    An update is the old row with weight -1 and the new one with +1; complete old and new rows are required.
    """
    sides = F.filter(
        F.array(F.struct(F.lit(-1).cast("long").alias("w"), F.col("old").alias("row")), F.struct(F.lit(1).cast("long").alias("w"), F.col("new").alias("row"))),
        lambda s: s["row"].isNotNull(),
    )
    bad = F.when(((F.col("op") == "insert") & F.col("new").isNull()) | ((F.col("op") == "delete") & F.col("old").isNull()) | ((F.col("op") == "update") & (F.col("old").isNull() | F.col("new").isNull())), F.raise_error(F.lit("incomplete row image")).cast("boolean"))
    rest = [c for c in log.columns if c not in ("op", "old", "new")]
    return log.where(F.coalesce(bad, F.lit(True))).select(*rest, F.explode(sides).alias("s")).select(*rest, "s.row.*", F.col("s.w").alias(WEIGHT))


def change_log(table: DataFrame, key: str, ticks: int = 7, changed: dict | None = None) -> list[DataFrame]:
    """A deterministic history of a static table: the bootstrap and six deltas, which end in the table itself.

    Rows are dealt by their key modulo 10: below 6 at first, then 6 and 7 are inserted; 0 is updated and 1 deleted; keys
    of 2 move; an empty tick; 3 and 4 go; at last everything else comes and what was changed or deleted is restored.
    `changed` maps columns to their expression in an updated row.
    """
    k = F.pmod(F.col(key), F.lit(10))
    new = table.withColumns(changed or {})
    plus = lambda df: df.withColumn(WEIGHT, F.lit(1).cast("long"))
    minus = lambda df: df.withColumn(WEIGHT, F.lit(-1).cast("long"))
    part = lambda df, *r: df.where(k.isin(*r))
    return [
        plus(part(table, 0, 1, 2, 3, 4, 5)),
        plus(part(table, 6, 7)),
        minus(part(table, 0)).unionByName(plus(part(new, 0))).unionByName(minus(part(table, 1))),
        minus(part(table, 2)).unionByName(plus(part(new, 2))),
        plus(table.limit(0)),
        minus(part(table, 3, 4)),
        plus(part(table, 8, 9, 1, 3, 4)).unionByName(minus(part(new, 0, 2))).unionByName(plus(part(table, 0, 2))),
    ][:ticks]
