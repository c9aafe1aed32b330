"""Joins, aggregates, windows, ordering, set operations, CTEs and subqueries, one query for each operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import numbers as N
from ..functions import temporal as D
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import setops as S
from ..operators import subqueries as Q
from ..operators import windows as W
from ..sources import generate_series, load, single_row, values

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def _dbl(c, n=2):
    return F.round(c.cast("double"), n)


# ---- sources


@query("SELECT * FROM (VALUES (1, 'a', NULL), (2, NULL, 2.5), (2, NULL, 2.5)) t(k, s, x)")
def values_rows(spark, d):
    return values(spark, [(1, "a", None), (2, None, 2.5), (2, None, 2.5)], "k int, s string, x double")


@query("SELECT 1 + 2 AS three, 'x' AS s, NULL::INT AS nothing")
def select_without_from(spark, d):
    return single_row(spark, three=F.lit(1) + 2, s="x", nothing=F.lit(None).cast("int"))


@query("SELECT v, o FROM (SELECT unnest(generate_series(10, -7, -3)) AS v, generate_subscripts(generate_series(10, -7, -3), 1) AS o)")
def series_with_ordinality(spark, d):
    return generate_series(spark, 10, -7, -3, "v", "o")


@query("SELECT n_nationkey, g FROM nation, (SELECT unnest(generate_series(0, 2)) AS g) WHERE n_nationkey % 3 = g")
def series_lateral(spark, d):
    return load(spark, d, "nation").crossJoin(generate_series(spark, 0, 2, 1, "g")).where(F.col("n_nationkey") % 3 == F.col("g")).select("n_nationkey", "g")


@query("SELECT n_nationkey FROM nation WHERE false")
def empty_relation(spark, d):
    return load(spark, d, "nation").where("false").select("n_nationkey")


# ---- joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark, d):
    c = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return J.on(load(spark, d, "orders"), c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_linenumber = p_size % 7 + 1")
def join_two_keys(spark, d):
    return J.on(load(spark, d, "lineitem"), load(spark, d, "part"), (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_linenumber") == F.col("p_size") % 7 + 1)).select("l_orderkey", "l_linenumber", "p_partkey")


@query("SELECT a.n_name AS x, b.r_name AS y FROM nation a CROSS JOIN region b")
def join_cross(spark, d):
    return J.cross(load(spark, d, "nation"), load(spark, d, "region")).select(F.col("n_name").alias("x"), F.col("r_name").alias("y"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_theta(spark, d):
    n = load(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return J.on(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def join_left_residual(spark, d):
    return J.on(load(spark, d, "customer"), load(spark, d, "orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 250000), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def join_right(spark, d):
    return J.on(load(spark, d, "orders"), load(spark, d, "customer"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F"), "right").select("o_orderkey", "c_custkey")


_FULL = "WITH a AS (SELECT nullif(n_nationkey % 12, 3) AS k, n_name AS x FROM nation), b AS (SELECT nullif(s_nationkey % 17, 5) AS k, s_name AS y FROM supplier) "


def _full_sides(spark, d):
    a = load(spark, d, "nation").select(N.nullif(F.col("n_nationkey") % 12, 3).alias("k"), F.col("n_name").alias("x"))
    b = load(spark, d, "supplier").select(N.nullif(F.col("s_nationkey") % 17, 5).alias("k"), F.col("s_name").alias("y"))
    return a, b


@query(_FULL + "SELECT k, x, y FROM a FULL JOIN b USING (k)")
def join_full_using(spark, d):
    return J.using(*_full_sides(spark, d), ["k"], "full").select("k", "x", "y")


@query(_FULL + "SELECT k, x, y FROM a NATURAL LEFT JOIN b")
def join_natural(spark, d):
    return J.natural(*_full_sides(spark, d), "left").select("k", "x", "y")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    return J.semi(load(spark, d, "customer"), load(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 100000)")
def join_anti(spark, d):
    return J.anti(load(spark, d, "customer"), load(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_suppkey % 40 AND s_suppkey % 40 + 3 AND p_partkey % 5 = s_nationkey % 5")
def join_band(spark, d):
    l = load(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("k"), "p_size")
    r = load(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).cast("long").alias("k"), (F.col("s_suppkey") % 40).alias("lo"), (F.col("s_suppkey") % 40 + 3).alias("hi"))
    # 5 keys and 13 buckets hold all pairs, which are 1.6 % of the product
    return J.band(l, r, ["k"], "p_size", "lo", "hi", 4, slices=32).select("p_partkey", "s_suppkey")


_ASOF = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, min(event_id) AS rid FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)
SELECT l.event_id, r.rid FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {} r.ts"""


def _asof(spark, d, strict):
    e = load(spark, d, "events")
    l = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    r = e.where("event_type <> 'purchase'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("r_id"))
    return J.predecessor(l, r, ["user_id"], "ts", "rts", ["r_id"], {"r_id": "rid"}, strict).select("event_id", "rid")


@query(_ASOF.format(">="))
def join_predecessor(spark, d):
    return _asof(spark, d, False)


@query(_ASOF.format(">"))
def join_predecessor_strict(spark, d):
    return _asof(spark, d, True)


# ---- aggregates


@query("""SELECT l_suppkey, count(*) AS n, count(nullif(l_returnflag, 'N')) AS flagged, round(sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE, 2) AS total, round(avg(l_quantity), 4) AS mean, min(l_shipdate) AS lo, max(l_shipdate) AS hi,
       min(l_returnflag) AS lf, bool_and(l_quantity > 1) AS al, bool_or(l_quantity > 49) AS an FROM lineitem GROUP BY l_suppkey""")
def aggregates_grouped(spark, d):
    return G.group(load(spark, d, "lineitem"), ["l_suppkey"], [
        F.count("*").alias("n"), F.count(N.nullif("l_returnflag", "N")).alias("flagged"), _dbl(A.sum_exact("l_quantity", 2)).alias("total"), _dbl(A.avg_exact("l_quantity", 2, 4), 4).alias("mean"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"),
        F.min("l_returnflag").alias("lf"), A.bool_and(F.col("l_quantity") > 1).alias("al"), A.bool_or(F.col("l_quantity") > 49).alias("an"),
    ])


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, max(l_orderkey) AS m FROM lineitem WHERE l_quantity < 0")
def aggregates_empty(spark, d):
    return G.group(load(spark, d, "lineitem").where("l_quantity < 0"), [], [F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.max("l_orderkey").alias("m")])


@query("SELECT o_custkey % 10 AS k, count(DISTINCT o_orderpriority) AS c, sum(DISTINCT o_custkey)::BIGINT AS s, round(avg(DISTINCT o_custkey), 4) AS a, min(DISTINCT o_orderkey) AS lo FROM orders GROUP BY 1")
def aggregates_distinct(spark, d):
    return load(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("k")).agg(F.count_distinct("o_orderpriority").alias("c"), F.sum_distinct("o_custkey").alias("s"), F.round(F.expr("avg(DISTINCT o_custkey)"), 4).alias("a"), F.min("o_orderkey").alias("lo"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, round(sum(l_quantity) FILTER (WHERE l_linenumber = 1), 2) AS s, max(l_orderkey) FILTER (WHERE false) AS nothing FROM lineitem GROUP BY 1")
def aggregates_filter(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("n"), F.round(F.sum(A.where(F.col("l_quantity"), F.col("l_linenumber") == 1)), 2).alias("s"), F.max(A.where(F.col("l_orderkey"), F.lit(False))).alias("nothing"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 1), '' ORDER BY left(n_name, 1)) AS firsts, string_agg(n_name, '|' ORDER BY n_nationkey DESC) FILTER (WHERE n_nationkey > 5) AS late FROM nation GROUP BY 1")
def aggregates_string(spark, d):
    return load(spark, d, "nation").groupBy("n_regionkey").agg(A.string_agg("n_name", ", ").alias("names"), A.string_agg(F.substring("n_name", 1, 1), "", distinct=True).alias("firsts"), A.string_agg("n_name", "|", [-F.col("n_nationkey")], filter=F.col("n_nationkey") > 5).alias("late"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def group_only(spark, d):
    return load(spark, d, "part").select("p_brand", "p_size").distinct()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 200000")
def having_hidden(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).where("n > 12 AND m > 200000").select("o_custkey", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, grouping(l_returnflag, l_linestatus) AS \"grouping\" FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (), ())")
def grouping_sets(spark, d):
    return G.grouping_sets(load(spark, d, "lineitem"), [("l_returnflag", "l_linestatus"), ("l_returnflag",), (), ()], [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")], ("l_returnflag", "l_linestatus"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS \"grouping\" FROM lineitem WHERE l_quantity < 0 GROUP BY ROLLUP (l_returnflag, l_linestatus) UNION ALL SELECT NULL, NULL, 0, 3 WHERE NOT EXISTS (SELECT 1 FROM (SELECT 1 FROM lineitem WHERE l_quantity < 0 GROUP BY ROLLUP (l_returnflag)))")
def grouping_rollup_empty(spark, d):
    return G.grouping_sets(load(spark, d, "lineitem").where("l_quantity < 0"), G.rollup("l_returnflag", "l_linestatus"), [F.count("*").alias("n")], ("l_returnflag", "l_linestatus"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus), ROLLUP (l_linenumber)")
def grouping_products(spark, d):
    return G.grouping_sets(load(spark, d, "lineitem"), G.products(G.cube("l_returnflag", "l_linestatus"), G.rollup("l_linenumber")), [F.count("*").alias("n")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def grouping_distinct_sets(spark, d):
    sets = G.products(G.rollup("l_returnflag", "l_linestatus"), G.rollup("l_returnflag")) + [("l_linestatus",)]
    return G.grouping_sets(load(spark, d, "lineitem"), sets, [F.count("*").alias("n")], distinct=True)


# ---- windows

def _ev(spark, d):
    return load(spark, d, "events")


@query("""SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, ntile(4) OVER w AS nt
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)""")
def window_ranking(spark, d):
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("event_type")
    return _ev(spark, d).select("event_id", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"), F.ntile(4).over(w).alias("nt"))


@query("""SELECT event_id, lag(event_id) OVER w AS l1, lag(event_id, 3, -1) OVER w AS l3, lead(event_id, 2) OVER w AS f2, first_value(event_id) OVER w AS fv, last_value(event_id) OVER w AS lv, nth_value(event_id, 3) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_navigation(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = F.col("event_id")
    return _ev(spark, d).select("event_id", F.lag(e).over(w).alias("l1"), F.lag(e, 3, -1).over(w).alias("l3"), F.lead(e, 2).over(w).alias("f2"), F.first(e).over(w).alias("fv"), F.last(e).over(w).alias("lv"), F.nth_value(e, 3).over(w).alias("n3"))


@query("""SELECT event_id, lag(event_id, CAST(event_id % 4 - 1 AS INT), -5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shifted FROM events""")
def window_lag_column(spark, d):
    return W.shifted(_ev(spark, d), ["user_id"], [F.col("ts"), F.col("event_id")], "event_id", F.col("event_id") % 4 - 1, F.lit(-5)).select("event_id", "shifted")


@query("""SELECT event_id, nth_value(event_id, CAST(event_id % 3 + 1 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events""")
def window_nth_column(spark, d):
    return W.nth_value(_ev(spark, d), ["user_id"], [F.col("ts"), F.col("event_id")], "event_id", F.col("event_id") % 3 + 1).select("event_id", "nth")


@query("""SELECT event_id, CAST(CASE WHEN k < r * (q + 1) THEN k // (q + 1) ELSE r + (k - r * (q + 1)) // greatest(q, 1) END + 1 AS INT) AS tile FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) // (user_id % 5 + 2) AS q, count(*) OVER (PARTITION BY user_id) % (user_id % 5 + 2) AS r FROM events)""")
def window_ntile_column(spark, d):
    return W.ntile(_ev(spark, d), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("user_id") % 5 + 2).select("event_id", "tile")


@query("""SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 2) AS s, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS a,
       max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, bool_or(value > 90) OVER w AS b, count(*) FILTER (WHERE event_type = 'click') OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    r = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _ev(spark, d).select(
        "event_id", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(r.rowsBetween(-3, 1)), 2).alias("s"), F.round(F.avg("value").over(r.rowsBetween(-3, 0)), 4).alias("a"),
        F.max("value").over(r.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.bool_or(F.col("value") > 90).over(w).alias("b"), F.count(F.when(F.col("event_type") == "click", 1)).over(w).alias("f"),
    )


@query("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 100 FOLLOWING) AS i, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) RANGE BETWEEN 1000.5 PRECEDING AND CURRENT ROW) AS m,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90 days' PRECEDING AND CURRENT ROW) AS t FROM orders""")
def window_range_distances(spark, d):
    o = load(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return o.select(
        "o_orderkey", F.count("*").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-500, 100)).alias("i"),
        F.expr("count(*) OVER (PARTITION BY o_custkey ORDER BY price RANGE BETWEEN 1000.5 PRECEDING AND CURRENT ROW)").alias("m"),
        F.expr("count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)").alias("t"),
    )


@query("""SELECT event_id, round(sum(value) OVER w, 2) AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(ts AS DATE) GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def window_groups(spark, d):
    out = W.with_groups_frame(_ev(spark, d), ["user_id"], [F.col("ts").cast("date")], -2, 1, {"s": F.sum("value"), "n": F.count("*")})
    return out.select("event_id", F.round("s", 2).alias("s"), "n")


def _add_exclusions():
    for what in ("current row", "group", "ties", "no others"):
        _exclude_query(what, "groups")
        _exclude_query(what, "rows")


def _exclude_query(what: str, frame: str) -> None:
    order = "day" if frame == "groups" else "day, event_id"
    name = f"window_exclude_{what.replace(' ', '_')}_{frame}"
    SQL[name] = f"""SELECT event_id, count(v) OVER w AS n, CAST(sum(v) OVER w AS BIGINT) AS total FROM (SELECT *, CAST(ts AS DATE) AS day, nullif(CAST(floor(value) AS BIGINT), 7) AS v FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY {order} {frame.upper()} BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {what.upper()})"""

    def run(spark, d):
        e = _ev(spark, d).withColumn("v", N.nullif(F.floor("value").cast("long"), 7)).withColumn("day", F.col("ts").cast("date"))
        return W.exclude(e, ["user_id"], [F.col(c) for c in order.split(", ")], -3, 2, what, "v", frame=frame).select("event_id", "n", "total")

    QUERIES[name] = run


_add_exclusions()


@query("SELECT k, round(max(run), 2) AS top FROM (SELECT user_id % 10 AS k, sum(total) OVER (PARTITION BY user_id ORDER BY day) AS run FROM (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2)) GROUP BY 1")
def window_group_chain(spark, d):
    daily = _ev(spark, d).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("total"))
    run = daily.withColumn("run", F.sum("total").over(Window.partitionBy("user_id").orderBy("day")))
    return run.groupBy((F.col("user_id") % 10).alias("k")).agg(F.round(F.max("run"), 2).alias("top"))


# ---- ordering


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_custkey % 50, 7) AS k FROM orders) ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 20")
def order_limit_offset(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", N.nullif(F.col("o_custkey") % 50, 7).alias("k"))
    return O.limit(o, [O.key("k", True), O.key("o_orderkey")], 50, 20)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, rank() OVER (ORDER BY o_custkey) AS r FROM orders) WHERE r <= 40")
def order_with_ties(spark, d):
    return O.with_ties(load(spark, d, "orders").select("o_orderkey", "o_custkey"), [("o_custkey",)], 40)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, rank() OVER (ORDER BY o_custkey DESC) AS r, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS n FROM orders) WHERE r <= 33 AND n > 13")
def order_with_ties_offset(spark, d):
    return O.with_ties(load(spark, d, "orders").select("o_orderkey", "o_custkey"), [("o_custkey", True)], 20, 13)


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(spark, d):
    return O.distinct_on(load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], [O.key("o_orderdate", True), O.key("o_orderkey")])


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def topk_per_group(spark, d):
    l = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return O.top_per_group(l, ["l_suppkey"], [O.key("l_extendedprice", True), O.key("l_orderkey"), O.key("l_linenumber")], 3).drop("l_extendedprice")


# ---- set operations

_SA, _SB = "SELECT l_suppkey % 20 AS k FROM lineitem WHERE l_linenumber = 1 AND l_orderkey < 400", "SELECT l_partkey % 30 FROM lineitem WHERE l_linenumber = 2 AND l_orderkey < 400"


def _sides(spark, d):
    l = load(spark, d, "lineitem").where("l_orderkey < 400")
    return l.where("l_linenumber = 1").select((F.col("l_suppkey") % 20).alias("k")), l.where("l_linenumber = 2").select((F.col("l_partkey") % 30).alias("k"))


for _name, _sql, _fn in (
    ("union_all", "UNION ALL", S.union_all), ("union", "UNION", S.union), ("intersect", "INTERSECT", S.intersect), ("intersect_all", "INTERSECT ALL", lambda a, b: S.intersect(a, b, True)),
    ("except", "EXCEPT", S.except_), ("except_all", "EXCEPT ALL", lambda a, b: S.except_(a, b, True)),
):
    QUERIES[f"setop_{_name}"] = lambda spark, d, fn=_fn: fn(*_sides(spark, d))
    SQL[f"setop_{_name}"] = f"{_SA} {_sql} {_SB}"
    QUERIES[f"setop_weighted_{_name}"] = lambda spark, d, rule=_sql.lower(): S.weighted(*_sides(spark, d), rule)
    SQL[f"setop_weighted_{_name}"] = SQL[f"setop_{_name}"]


@query("SELECT DISTINCT p_brand FROM part")
def select_distinct(spark, d):
    return S.distinct(load(spark, d, "part").select("p_brand"))


@query("(SELECT n_nationkey AS k FROM nation ORDER BY 1 LIMIT 5) UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation ORDER BY 1")
def setop_precedence(spark, d):
    first = O.limit(load(spark, d, "nation").select(F.col("n_nationkey").alias("k")), [O.key("k")], 5)
    return S.union_all(first, S.intersect(load(spark, d, "region").select("r_regionkey"), load(spark, d, "nation").select("n_regionkey")))


# ---- common table expressions and subqueries


@query("WITH big AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), top(k) AS (SELECT max(n) FROM big) SELECT o_custkey, n FROM big, top WHERE n >= k - 2")
def cte_chain(spark, d):
    big = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return big.crossJoin(F.broadcast(big.agg(F.max("n").alias("k")))).where("n >= k - 2").select("o_custkey", "n")


@query("SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS above FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subquery_scalar(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = Q.scalar(o, o.agg(F.avg("o_totalprice").alias("m")), "m", "mean")
    return out.where("o_totalprice > mean").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("mean"), 2).alias("above"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS m FROM customer")
def subquery_correlated(spark, d):
    f = load(spark, d, "orders").where("o_orderstatus = 'F'")
    c = load(spark, d, "customer").select("c_custkey")
    c = Q.correlated_aggregate(c, f, F.count("*"), "n", {"c_custkey": "o_custkey"}, F.lit(0))
    return Q.correlated_aggregate(c, f, F.max("o_orderkey"), "m", {"c_custkey": "o_custkey"})


_MARK = "WITH o AS (SELECT c_custkey AS id, nullif(c_nationkey, 3) AS p, c_nationkey % 4 AS g FROM customer), i AS (SELECT nullif(s_nationkey % 11, 4) AS v, s_nationkey % 3 AS g FROM supplier) "


def _mark_sides(spark, d):
    o = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), N.nullif("c_nationkey", 3).alias("p"), (F.col("c_nationkey") % 4).alias("g"))
    return o, load(spark, d, "supplier").select(N.nullif(F.col("s_nationkey") % 11, 4).alias("v"), (F.col("s_nationkey") % 3).alias("g"))


@query(_MARK + "SELECT id, p IN (SELECT v FROM i) AS a, p NOT IN (SELECT v FROM i WHERE v IS NOT NULL) AS b, p IN (SELECT v FROM i WHERE v > 99) AS c, p IN (SELECT v FROM i WHERE i.g = o.g) AS e, p NOT IN (SELECT v FROM i WHERE i.g = o.g) AS f FROM o")
def subquery_in_marks(spark, d):
    o, i = _mark_sides(spark, d)
    o = Q.mark_in(o, "p", i, "v", "a")
    o = Q.mark_in(o, "p", i.where("v is not null"), "v", "b", True)
    o = Q.mark_in(o, "p", i.where("v > 99"), "v", "c")
    o = Q.mark_in(o, "p", i, "v", "e", False, {"g": "g"})
    return Q.mark_in(o, "p", i, "v", "f", True, {"g": "g"}).select("id", "a", "b", "c", "e", "f")


_QUANT = [("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>")]


@query(_MARK + "SELECT id, " + ", ".join(f"p {op} ANY (SELECT v FROM i) AS {n}_any, p {op} ALL (SELECT v FROM i) AS {n}_all, p {op} ALL (SELECT v FROM i WHERE v IS NOT NULL) AS {n}_all2" for n, op in _QUANT) + " FROM o")
def subquery_any_all(spark, d):
    o, i = _mark_sides(spark, d)
    for n, op in _QUANT:
        o = Q.quantified(o, "p", op, "any", i, "v", f"{n}_any")
        o = Q.quantified(o, "p", op, "all", i, "v", f"{n}_all")
        o = Q.quantified(o, "p", op, "all", i.where("v is not null"), "v", f"{n}_all2")
    return o.drop("p", "g")


@query(_MARK + "SELECT id, EXISTS (SELECT 1 FROM i WHERE i.g = o.g) AS a, NOT EXISTS (SELECT 1 FROM i WHERE i.g = o.g) AS b, (SELECT count(*) FROM i WHERE i.g = o.g) >= 31 AS c FROM o")
def subquery_exists(spark, d):
    o, i = _mark_sides(spark, d)
    o = Q.exists(o, i, "a", {"g": "g"})
    o = Q.exists(o, i, "b", {"g": "g"}, negate=True)
    return Q.exists(o, i, "c", {"g": "g"}, at_least=31).select("id", "a", "b", "c")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice / 3 AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size < 10))")
def subquery_nested_exists(spark, d):
    small = J.semi(load(spark, d, "lineitem"), load(spark, d, "part").where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey"))
    return J.semi(load(spark, d, "orders"), small, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_extendedprice") > F.col("o_totalprice") / 3)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT 'R', 'F' UNION ALL SELECT 'N', 'O') AND l_quantity > 48")
def subquery_row_in(spark, d):
    pairs = values(spark, [("R", "F"), ("N", "O")], "f string, s string")
    return J.semi(load(spark, d, "lineitem").where("l_quantity > 48"), pairs, (F.col("l_returnflag") == F.col("f")) & (F.col("l_linestatus") == F.col("s"))).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n, count(DISTINCT day) AS days FROM (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-01') AS day FROM events)")
def derived_table(spark, d):
    return _ev(spark, d).select(D.date_bin(D.DAY, "ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


@query("SELECT o_orderkey, o_totalprice, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice")
def group_functional_dependency(spark, d):
    """o_totalprice depends on the primary key o_orderkey, so it needs no place in the group key."""
    j = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.first("o_totalprice").alias("o_totalprice"), F.count("*").alias("n"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, s")
def group_ordinals_labels(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, bool_and(c_acctbal > -1000) AS e, string_agg(left(c_mktsegment, 1), '' ORDER BY c_custkey) FILTER (WHERE c_custkey < 20) AS s FROM customer HAVING count(*) > 1")
def group_global_having(spark, d):
    c = load(spark, d, "customer")
    return G.group(c, [], [F.count("*").alias("n"), A.every(F.col("c_acctbal") > -1000).alias("e"), A.string_agg(F.substring("c_mktsegment", 1, 1), "", [F.col("c_custkey")], filter=F.col("c_custkey") < 20).alias("s")], F.col("n") > 1)


@query("SELECT event_id, sum(event_id) OVER w AS s, string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS kinds FROM (SELECT * FROM events) WINDOW v AS (PARTITION BY user_id), w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_string_agg(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _ev(spark, d).select("event_id", F.sum("event_id").over(w).alias("s"), F.array_join(F.collect_list("event_type").over(w.rowsBetween(-2, 0)), ",").alias("kinds"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
def order_limit_zero(spark, d):
    return O.limit(load(spark, d, "orders").select("o_orderkey"), [O.key("o_orderkey")], 0)


@query("SELECT p_name FROM part WHERE p_size < 5 ORDER BY p_name COLLATE \"C\" LIMIT 20".replace('COLLATE "C" ', ""))
def order_bytewise(spark, d):
    return O.limit(load(spark, d, "part").where("p_size < 5").select("p_name"), [O.key("p_name")], 20)


@query("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20) AS n FROM customer c")
def subquery_residual_correlation(spark, d):
    """The residual goes into the join; groups without a match count 0."""
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    j = c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 20), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
