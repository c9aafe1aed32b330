"""The Nexmark queries as maintained views, on the history of `incremental`; each must equal its SQL at the end.

Row-wise queries are linear nodes, the others joins, additive aggregates, and nodes keyed by what their groups share, which
run the batch query over the rows of touched keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal as D
from ..operators import joins as J
from ..operators import ordering as O
from ..sources import SCHEMAS, load
from ..sources.changes import WEIGHT
from ..streaming import Aggregate, Join, Keyed, Linear, Source, Union, columns_read, compile_sql, restored
from . import nexmark as N
from .incremental import maintained

QUERIES: dict = {}
SQL: dict[str, str] = {}

SOURCES = {n: Source(n, SCHEMAS[n]) for n in ("orders", "lineitem", "events", "customer", "pages")}
HOUR = 3_600_000_000


def _put(name: str, names: list[str], make) -> None:
    """Registers the view that `make(spark, sf_dir)` gives a graph of; static tables are read from sf_dir."""
    QUERIES[f"incremental_{name}"] = lambda spark, d: maintained(spark, d, make(spark, d), names, name)
    SQL[f"incremental_{name}"] = N.SQL[name]


def _linear(name: str, table: str) -> None:
    fn = N.QUERIES[name]
    _put(name, [table], lambda spark, d: Linear(SOURCES[table], lambda df: fn(df.sparkSession, {table: df})))


def _keyed_node(spark, keys: dict[str, list], run):
    """`run` over the tables, for the keys that each table's expressions (SQL text, or a function that makes a column) give; key columns are called k0, k1, ...

    Columns that `run` never reads aren't kept. A key that is a column of the table is kept once, so Spark knows that `run` groups by it.
    """
    read = columns_read(spark, lambda dfs: run(spark, dfs), {t: SCHEMAS[t] for t in keys})
    names = [f"k{n}" for n in range(len(next(iter(keys.values()))))]

    def narrow(table, exprs):
        own = [c for c in read[table] if c not in exprs]
        return lambda df: _weighted(df, *[(F.expr(e) if isinstance(e, str) else e()).alias(k) for k, e in zip(names, exprs, strict=True)], *own)

    def whole(df, table):
        return restored(df.withColumnsRenamed({k: e for k, e in zip(names, keys[table], strict=True) if e in read[table]}), SCHEMAS[table])

    return Keyed([Linear(SOURCES[t], narrow(t, e)) for t, e in keys.items()], names, lambda *dfs: run(dfs[0].sparkSession, {t: whole(df, t) for t, df in zip(keys, dfs, strict=True)}))


def _keyed(name: str, keys: dict[str, list]) -> None:
    _put(name, list(keys), lambda spark, d: _keyed_node(spark, keys, N.QUERIES[name]))


def _weighted(df: DataFrame, *columns) -> DataFrame:
    return N.pick(df, *columns)


for _name, _table in (("nexmark_q0", "lineitem"), ("nexmark_q1", "lineitem"), ("nexmark_q2", "lineitem"), ("nexmark_q10", "events"), ("nexmark_q14", "events"), ("nexmark_q21", "pages"), ("nexmark_q22", "pages")):
    _linear(_name, _table)


def _bids(df: DataFrame) -> DataFrame:
    return N.bid(df.sparkSession, {"lineitem": df})


def _auctions(df: DataFrame) -> DataFrame:
    return N.auction(df.sparkSession, {"orders": df})


def _q3(spark, d):
    few = load(spark, d, "nation").where("n_nationkey < 5")  # a static table
    p = Linear(SOURCES["customer"], lambda df: _weighted(df.join(F.broadcast(few), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("city"), F.col("n_name").alias("state")))
    a = Linear(SOURCES["orders"], lambda df: _weighted(_auctions(df).where("category = 3"), F.col("seller").alias("k"), "id"))
    return Linear(Join(p, a, ["k"]), lambda df: df.drop("k"))


_put("nexmark_q3", ["customer", "orders"], _q3)


def _q20(spark, d):
    b = Linear(SOURCES["lineitem"], lambda df: _weighted(_bids(df), F.col("auction").alias("k"), "bidder", "price"))
    a = Linear(SOURCES["orders"], lambda df: _weighted(_auctions(df).where("category = 1"), F.col("id").alias("k"), "seller", "category"))
    return Linear(Join(b, a, ["k"]), lambda df: df.withColumnRenamed("k", "auction"))


_put("nexmark_q20", ["lineitem", "orders"], _q20)


def _winners(spark):
    """The highest valid bid of each auction, by auction."""
    return _keyed_node(spark, {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"]}, N._winners)


_put("nexmark_q4", ["orders", "lineitem"], lambda spark, d: Aggregate(_winners(spark), ["category"], {"s": "final"}, {"mean": "round(s / n, 4)"}))


def _q6(spark, d):
    dates = Aggregate(Linear(SOURCES["orders"], lambda df: _weighted(df, "o_orderdate")), ["o_orderdate"], {}, {})
    clock = Keyed([dates], [], lambda o: o.agg(F.max("o_orderdate").alias("now")))
    ended = Linear(_winners(spark), lambda df: _weighted(df, "id", "seller", "expires", "final"))
    closed = Linear(Join(ended, clock, []), lambda df: df.where("expires <= now").drop("now"))
    w = Window.partitionBy("seller").orderBy("expires", "id").rowsBetween(-10, 0)
    return Keyed([closed], ["seller"], lambda df: df.select("seller", "id", F.round(F.avg("final").over(w), 3).alias("mean")))


_put("nexmark_q6", ["orders", "lineitem"], _q6)


def _q5(spark, d):
    hops = Linear(SOURCES["events"], lambda df: df.select("event_type", F.explode(D.hops("ts", 10 * HOUR, 2 * HOUR)).alias("start"), *[c for c in df.columns if c == WEIGHT]))
    counts = Aggregate(hops, ["start", "event_type"], {}, {"n": "n"})
    return Keyed([counts], ["start"], lambda df: O.top_per_group(df, ["start"], [O.key("n", True)], 1, ties=True).select("start", "event_type", "n"))


_put("nexmark_q5", ["events"], _q5)


def _q12(spark, d):
    e = Linear(SOURCES["events"], lambda df: _weighted(df, "user_id", D.date_bin(10_000_000, D.plus_micros("ts", 3_000_000)).alias("start")))
    return Aggregate(e, ["user_id", "start"], {}, {"n": "n"})


_put("nexmark_q12", ["events"], _q12)
_DAY = "CAST(ts AS DATE)"
_keyed("nexmark_q7", {"events": [lambda: D.date_bin(HOUR, "ts")]})
_keyed("nexmark_q8", {"events": ["user_id", _DAY]})
_keyed("nexmark_q9", {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"]})
_keyed("nexmark_q11", {"events": ["user_id"]})
_keyed("nexmark_q15", {"events": [_DAY]})
_keyed("nexmark_q16", {"events": ["event_type", _DAY]})
_keyed("nexmark_q17", {"events": ["user_id", _DAY]})


def _q13(spark, d):
    """The lookup is kept for times of bids instead of bids: a change of orders moves the few bids whose times it answers otherwise."""
    side = Linear(SOURCES["orders"], lambda df: _weighted(df, (F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("t"), "o_orderkey"))
    first = Keyed([side], ["k", "t"], lambda o: o.groupBy("k", "t").agg(F.min("o_orderkey").alias("o_orderkey")))
    bids = Linear(SOURCES["lineitem"], lambda df: _weighted(_bids(df), (F.col("bidder") % 100).alias("k"), F.col("date_time").alias("at"), "auction", "id"))
    known = Linear(bids, lambda df: df.where("k IS NOT NULL AND at IS NOT NULL"))
    times = Aggregate(known, ["k", "at"], {}, {})
    found = Keyed([times, first], ["k"], lambda b, o: J.predecessor(b, o, ["k"], "at", "t", ["o_orderkey"], {"o_orderkey": "side"}, bucket_us=90 * D.DAY))
    never = Linear(bids, lambda df: _weighted(df.where("k IS NULL OR at IS NULL"), "auction", "id", F.lit(None).cast("long").alias("side")))
    return Union(Linear(Join(known, found, ["k", "at"]), lambda df: _weighted(df, "auction", "id", "side")), never)


_put("nexmark_q13", ["orders", "lineitem"], _q13)

#: Parts of a group whose first rows are kept, so that a group with very many rows is as many tasks.
SLICES = 16


def _tops(by: list[str], order: list, k: int, columns: list[str]):
    """The first k bids of each group, out of the first k of each of its slices."""
    bids = Linear(SOURCES["lineitem"], lambda df: _weighted(_bids(df), *columns, F.pmod(F.xxhash64("auction"), F.lit(SLICES)).cast("int").alias("slice")))
    slices = Keyed([bids], [*by, "slice"], lambda df: O.top_per_group(df, [*by, "slice"], order, k))
    return Keyed([Linear(slices, lambda df: df.drop("slice"))], by, lambda df: O.top_per_group(df, by, order, k).select("auction", "bidder", "price", "id"))


_put("nexmark_q18", ["lineitem"], lambda spark, d: _tops(["bidder", "channel"], [O.key("date_time", True), O.key("auction"), O.key("id")], 1, ["auction", "bidder", "price", "date_time", "id", "channel"]))
_put("nexmark_q19", ["lineitem"], lambda spark, d: _tops(["bidder"], [O.key("price", True), O.key("auction"), O.key("id")], 10, ["auction", "bidder", "price", "id"]))


#: Views from SQL text, with the way that each is maintained.
STATEMENTS = {
    "sql_filter": ("SELECT event_id, value * 2 AS twice FROM events WHERE event_type = 'purchase' AND value > 10", "linear"),
    "sql_union_all": ("WITH low AS (SELECT event_id, 'low' AS kind FROM events WHERE value < 20) SELECT * FROM low UNION ALL SELECT event_id, 'high' FROM events WHERE value > 90", "linear"),
    "sql_group": ("SELECT user_id, event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE value > 5 GROUP BY user_id, event_type HAVING count(*) > 1", "keyed"),
    "sql_top": ("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) AS t WHERE n <= 2", "keyed"),
    "sql_join": ("SELECT c.c_custkey, count(*) AS n, count(o.o_orderkey) AS orders FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000 GROUP BY c.c_custkey", "whole"),
    "sql_exists": ("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "whole"),
    "sql_limit": ("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20", "whole"),
}


def _statement(name: str, sql: str) -> None:
    names = [n for n in SOURCES if re.search(rf"\b{n}\b", sql)]
    QUERIES[f"incremental_{name}"] = lambda spark, d: maintained(spark, d, compile_sql(spark, sql, [SOURCES[n] for n in names])[0], names, name)
    SQL[f"incremental_{name}"] = sql


for _name, (_sql, _) in STATEMENTS.items():
    _statement(_name, _sql)
