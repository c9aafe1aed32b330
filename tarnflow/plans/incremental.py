"""Views kept up to date by change, on a history that ends in the static tables; each must equal its SQL there.

`view_*` queries are the plain DataFrames of the same graphs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import setops as S
from ..sources import SCHEMAS, change_log, load
from ..streaming import Aggregate, Join, Keyed, Linear, Source, Union, View

QUERIES: dict = {}
SQL: dict[str, str] = {}

ORDERS, LINES, EVENTS, CUSTOMERS = (Source(n, SCHEMAS[n]) for n in ("orders", "lineitem", "events", "customer"))
#: The graph of each view by name.
GRAPHS: dict = {}


def _history(spark: SparkSession, d: str, names: list[str]) -> list[dict[str, DataFrame]]:
    changed = {
        "orders": ("o_orderkey", {"o_custkey": F.col("o_custkey") % 7 + 1, "o_totalprice": F.lit(1.0)}),
        "lineitem": ("l_orderkey", {"l_quantity": F.col("l_quantity") + 1, "l_suppkey": F.lit(3).cast("long")}),
        "events": ("event_id", {"value": F.lit(50.0), "user_id": F.lit(5).cast("long")}),
        "customer": ("c_custkey", {"c_mktsegment": F.lit(None).cast("string"), "c_nationkey": (F.col("c_nationkey") + 1) % 25}),
        "pages": ("page_id", {"url": F.lit("https://m.example.org/a/b?x=1&page=7")}),
    }
    logs = {n: change_log(load(spark, d, n), *changed[n][:1], changed=changed[n][1]) for n in names}
    return [{n: logs[n][t] for n in names} for t in range(7)]


def scratch_dir(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/checkpoints/tarnflow"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def maintained(spark: SparkSession, d: str, out, names: list[str], name: str) -> DataFrame:
    """The view after the whole history, one step for each tick."""
    view = View(spark, out, scratch_dir(spark, name))
    for tick, deltas in enumerate(_history(spark, d, names)):
        view.step(tick, deltas)
    return view.read()


def both(name: str, out, names: list[str], sql: str) -> None:
    GRAPHS[name] = out
    QUERIES[f"view_{name}"] = lambda spark, d: View(spark, out).batch({n: load(spark, d, n) for n in names})
    QUERIES[f"incremental_{name}"] = lambda spark, d: maintained(spark, d, out, names, name)
    SQL[f"view_{name}"] = SQL[f"incremental_{name}"] = sql


both(
    "filter_project",
    Linear(LINES, lambda df: df.where("l_quantity > 40").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"), *[c for c in df.columns if c == "__w"])),
    ["lineitem"],
    "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 40",
)

both(
    "grouped_join",
    Aggregate(
        Join(
            Linear(ORDERS, lambda df: df.select(F.col("o_orderkey").alias("k"), "o_custkey", *[c for c in df.columns if c == "__w"])),
            Linear(LINES, lambda df: df.select(F.col("l_orderkey").alias("k"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), *[c for c in df.columns if c == "__w"])),
            ["k"],
        ),
        ["o_custkey"],
        {"cents": "cents"},
        {"n": "n", "cents": "cents"},
    ),
    ["orders", "lineitem"],
    "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)

both(
    "count_sum_by_supplier",
    Aggregate(LINES, ["l_suppkey"], {"q": "CAST(l_quantity AS DECIMAL(18,2))"}, {"n": "n", "quantity": "CAST(q AS DOUBLE)"}),
    ["lineitem"],
    "SELECT l_suppkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS quantity FROM lineitem GROUP BY 1",
)

both(
    "min_max",
    Keyed([EVENTS], ["user_id"], lambda e: e.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("value").alias("hi"), F.count_distinct("event_type").alias("kinds"))),
    ["events"],
    "SELECT user_id, min(ts) AS lo, max(value) AS hi, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1",
)

both(
    "running_window",
    Keyed([EVENTS], ["user_id"], lambda e: e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))),
    ["events"],
    "SELECT user_id, event_id, row_number() OVER w AS rn, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)

both(
    "topk",
    Keyed([EVENTS], ["user_id"], lambda e: e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("n <= 3").select("user_id", "event_id", "n")),
    ["events"],
    "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3",
)


def _customers(c: str):
    return Linear(CUSTOMERS, lambda df: df.select(F.col("c_custkey").alias(c), "c_mktsegment", *[x for x in df.columns if x == "__w"]))


def _orders(c: str):
    return Linear(ORDERS, lambda df: df.where("o_totalprice > 200000").select(F.col("o_custkey").alias(c), "o_orderkey", *[x for x in df.columns if x == "__w"]))


both(
    "left_join",
    Keyed([_customers("k"), _orders("k")], ["k"], lambda c, o: c.join(o, "k", "left")),
    ["customer", "orders"],
    "SELECT c_custkey AS k, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
)

both(
    "full_join",
    Keyed([_customers("k"), Linear(_orders("k"), lambda df: df.withColumn("k", F.col("k") + 100))], ["k"], lambda c, o: c.join(o, "k", "full")),
    ["customer", "orders"],
    "SELECT k, c_mktsegment, o_orderkey FROM (SELECT c_custkey AS k, c_mktsegment FROM customer) FULL JOIN (SELECT o_custkey + 100 AS k, o_orderkey FROM orders WHERE o_totalprice > 200000) USING (k)",
)

both(
    "anti_join",
    Keyed([_customers("k"), _orders("k")], ["k"], lambda c, o: c.join(o, "k", "left_anti")),
    ["customer", "orders"],
    "SELECT c_custkey AS k, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
)

_k1 = Linear(ORDERS, lambda df: df.select((F.col("o_custkey") % 100).alias("k"), *[x for x in df.columns if x == "__w"]))
_k2 = Linear(EVENTS, lambda df: df.select((F.col("user_id") % 130).alias("k"), *[x for x in df.columns if x == "__w"]))

both("union_all", Union(_k1, _k2), ["orders", "events"], "SELECT o_custkey % 100 AS k FROM orders UNION ALL SELECT user_id % 130 FROM events")
both("except_all", Keyed([_k1, _k2], ["k"], lambda a, b: S.except_(a, b, True)), ["orders", "events"], "SELECT o_custkey % 100 AS k FROM orders EXCEPT ALL SELECT user_id % 130 FROM events")
both("distinct", Keyed([_k1], ["k"], lambda a: a.distinct()), ["orders"], "SELECT DISTINCT o_custkey % 100 AS k FROM orders")
both(
    "expand",
    Linear(EVENTS, lambda df: df.select("event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("g"), *[x for x in df.columns if x == "__w"]).where("event_id % 3 < g")),
    ["events"],
    "SELECT event_id, g FROM events, (SELECT unnest(generate_series(1, 3)) AS g) WHERE event_id % 3 < g",
)
both(
    "global_limit",
    Keyed([ORDERS], [], lambda o: o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)),
    ["orders"],
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The grouped join view by Structured Streaming over log files, stopped and restarted half way."""
    from ..streaming import append, encode_log, start

    root = scratch_dir(spark, "stream")
    view = View(spark, GRAPHS["grouped_join"], f"{root}/view")
    history = _history(spark, d, ["orders", "lineitem"])
    for part in (history[:4], history[4:]):
        for deltas in part:
            # an empty transaction has no rows to log, and no effect
            append(spark, f"{root}/log", encode_log(deltas))
        start(spark, f"{root}/log", [view], f"{root}/checkpoint", available_now=True).awaitTermination()
    return view.read()


QUERIES["streamed_grouped_join"] = _streamed
SQL["streamed_grouped_join"] = SQL["view_grouped_join"]
