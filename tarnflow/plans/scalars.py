"""Projection, predicates and the scalar functions, one query for each family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as V
from ..functions import numbers as N
from ..functions import predicates as P
from ..functions import temporal as D
from ..functions import text as X
from ..sources import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


_KEY = "l_orderkey, l_linenumber"


def _line(spark, d):
    return load(spark, d, "lineitem")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_shipdate FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def project_filter(spark, d):
    return _line(spark, d).where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"), "l_shipdate")


@query("SELECT * FROM nation")
def project_star(spark, d):
    return load(spark, d, "nation")


@query("""
WITH t AS (SELECT event_id, nullif(user_id % 5, 0) AS a, nullif(event_id % 3, 0) AS b FROM events)
SELECT event_id, a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge,
       a IS NULL AS isnull, (a = b) IS TRUE AS istrue, (a = b) IS FALSE AS isfalse, (a = b) IS NULL AS isunknown,
       a IS DISTINCT FROM b AS dist, a IS NOT DISTINCT FROM b AS notdist,
       a BETWEEN 1 AND 3 AS btw, a NOT BETWEEN b AND 3 AS nbtw, a IN (1, NULL, 3) AS inl, a NOT IN (1, 3) AS nin,
       (a = 1 AND b = 2) AS conj, (a = 1 OR b = 2) AS disj, NOT (a = 1) AS neg
FROM t""")
def predicates_three_valued(spark, d):
    t = load(spark, d, "events").select("event_id", N.nullif(F.col("user_id") % 5, 0).alias("a"), N.nullif(F.col("event_id") % 3, 0).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.select(
        "event_id", (a == b).alias("eq"), (a != b).alias("ne"), (a < b).alias("lt"), (a <= b).alias("le"), (a > b).alias("gt"), (a >= b).alias("ge"),
        a.isNull().alias("isnull"), P.is_true(a == b).alias("istrue"), P.is_false(a == b).alias("isfalse"), P.is_unknown(a == b).alias("isunknown"),
        P.distinct_from(a, b).alias("dist"), P.not_distinct_from(a, b).alias("notdist"),
        a.between(1, 3).alias("btw"), (~a.between(b, F.lit(3))).alias("nbtw"), P.in_list(a, 1, None, 3).alias("inl"), (~P.in_list(a, 1, 3)).alias("nin"),
        ((a == 1) & (b == 2)).alias("conj"), ((a == 1) | (b == 2)).alias("disj"), (~(a == 1)).alias("neg"),
    )


@query(r"""SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_type LIKE 'S%' AS starts, p_brand LIKE 'Brand__1' AS one, p_name NOT LIKE '%e%' AS no_e,
       p_name ILIKE '%A%' AS folded, replace(p_name, 'a', '%') LIKE '%!%%' ESCAPE '!' AS escaped FROM part""")
def predicates_like(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", P.like("p_name", "%a%").alias("has_a"), P.like("p_type", "S%").alias("starts"), P.like("p_brand", "Brand__1").alias("one"), (~P.like("p_name", "%e%")).alias("no_e"),
        P.ilike("p_name", "%A%").alias("folded"), P.like(F.replace(F.col("p_name"), F.lit("a"), F.lit("%")), "%!%%", "!").alias("escaped"),
    )


@query("""SELECT l_orderkey, l_linenumber, (l_linenumber, l_quantity) < (3, 20.0) AS lt, (l_linenumber, l_quantity) >= (3, 20.0) AS ge, (l_linenumber, l_returnflag) = (1, 'R') AS eq FROM lineitem""")
def predicates_rows(spark, d):
    return _line(spark, d).select("l_orderkey", "l_linenumber", P.row_compare("<", ["l_linenumber", "l_quantity"], [3, 20.0]).alias("lt"), P.row_compare(">=", ["l_linenumber", "l_quantity"], [3, 20.0]).alias("ge"), P.row_compare("=", ["l_linenumber", "l_returnflag"], [1, "R"]).alias("eq"))


@query("""SELECT c_custkey, length(c_name)::INT AS n, strlen(c_name)::INT AS octets, strlen(c_name)::INT * 8 AS bits, ascii(c_name) AS code, chr((65 + c_custkey % 26)::INT) AS letter,
       lower(c_mktsegment) AS low, upper(c_name) AS up, left(c_name, 3) AS l3, left(c_name, -3) AS lm3, right(c_name, 4) AS r4, right(c_name, -4) AS rm4, reverse(c_name) AS rev,
       replace(c_name, 'u', 'oo') AS rep, translate(c_name, 'Cus', 'xy') AS tra, repeat(left(c_name, 2), 3) AS rpt, lpad(c_name, 25, '*-') AS lp, rpad(c_name, 5, 'x') AS rp FROM customer""")
def text_functions(spark, d):
    c = "c_name"
    return load(spark, d, "customer").select(
        "c_custkey", X.length(c).alias("n"), X.octet_length(c).alias("octets"), X.bit_length(c).alias("bits"), X.ascii(c).alias("code"), X.chr(65 + F.col("c_custkey") % 26).alias("letter"),
        X.lower("c_mktsegment").alias("low"), X.upper(c).alias("up"), X.left(c, 3).alias("l3"), X.left(c, -3).alias("lm3"), X.right(c, 4).alias("r4"), X.right(c, -4).alias("rm4"), X.reverse(c).alias("rev"),
        X.replace(c, "u", "oo").alias("rep"), X.translate(c, "Cus", "xy").alias("tra"), X.repeat(X.left(c, 2), 3).alias("rpt"), X.lpad(c, 25, "*-").alias("lp"), X.rpad(c, 5, "x").alias("rp"),
    )


@query("""SELECT c_custkey, ltrim('  ' || c_name) AS lt, rtrim(c_name, '0123456789') AS rt, trim(c_name, 'C0') AS bt, ltrim(c_name, 'Cu') AS lc, instr(c_name, '#')::INT AS pos, starts_with(c_name, 'Cust') AS st,
       split_part(c_name, '#', 1) AS f1, split_part(c_name, '#', 2) AS f2, split_part(c_name, '#', 9) AS f9, split_part(c_name, '#', -1) AS fm1,
       substr(c_name, 2, 3) AS s23, substr(c_name, 3) AS s3, left(c_name, 1) AS s02, c_name || '/' || c_mktsegment AS cc,
       concat(nullif(c_mktsegment, 'BUILDING'), '-', c_name) AS con, concat_ws(',', nullif(c_mktsegment, 'BUILDING'), c_name) AS cws, to_hex(c_custkey * 977) AS hex, left(c_name, 6) AS vc FROM customer""")
def text_search(spark, d):
    c, seg = F.col("c_name"), N.nullif("c_mktsegment", "BUILDING")
    return load(spark, d, "customer").select(
        "c_custkey", X.ltrim(F.concat(F.lit("  "), c)).alias("lt"), X.rtrim(c, "0123456789").alias("rt"), X.btrim(c, "C0").alias("bt"), X.ltrim(c, "Cu").alias("lc"), X.strpos(c, "#").alias("pos"), X.starts_with(c, "Cust").alias("st"),
        X.split_part(c, "#", 1).alias("f1"), X.split_part(c, "#", 2).alias("f2"), X.split_part(c, "#", 9).alias("f9"), X.split_part(c, "#", -1).alias("fm1"),
        X.substr(c, 2, 3).alias("s23"), X.substr(c, 3).alias("s3"), X.substr(c, 0, 2).alias("s02"), X.concat_op(c, F.lit("/"), "c_mktsegment").alias("cc"),
        X.concat(seg, F.lit("-"), c).alias("con"), X.concat_ws(",", seg, c).alias("cws"), X.lower(X.to_hex(F.col("c_custkey") * 977)).alias("hex"), X.varchar(c, 6).alias("vc"),
    )


SQL["text_search"] = SQL["text_search"].replace("to_hex(c_custkey * 977)", "lower(to_hex(c_custkey * 977))")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 37 - 20000)::BIGINT AS a, (l_linenumber + 2)::BIGINT AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, abs(a) AS abs_a, a + b AS plus, a - b AS minus, a * b AS times, a // b AS quot, a % b AS rest, a & b AS band, a | b AS bor, xor(a, b) AS bxor, ~a AS bnot, b << 3 AS shl, a >> 2 AS shr,
       CASE WHEN a > 0 THEN 1 WHEN a < 0 THEN -1 ELSE 0 END AS sgn FROM t""")
def integer_math(spark, d):
    t = _line(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 37 - 20000).alias("a"), (F.col("l_linenumber") + 2).cast("long").alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.select("l_orderkey", "l_linenumber", F.abs(a).alias("abs_a"), (a + b).alias("plus"), (a - b).alias("minus"), (a * b).alias("times"), N.int_div(a, b).alias("quot"), N.mod(a, b).alias("rest"), N.bit_and(a, b).alias("band"), N.bit_or(a, b).alias("bor"), N.bit_xor(a, b).alias("bxor"), N.bit_not(a).alias("bnot"), N.shift_left(b, 3).alias("shl"), N.shift_right(a, 2).alias("shr"), N.sign(a).alias("sgn"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice - 30000 AS DECIMAL(18,2)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(v, 1)::DOUBLE + 0.0 AS r1, round(v)::DOUBLE + 0.0 AS r0, trunc(v)::DOUBLE + 0.0 AS t0, ceil(v)::DOUBLE + 0.0 AS up, floor(v)::DOUBLE AS down, abs(v)::DOUBLE AS mag, sign(v)::INT AS sgn, trunc(v / 7)::DOUBLE + 0.0 AS d7, round(v)::BIGINT AS whole FROM t""")
def numeric_math(spark, d):
    v = F.col("v")
    t = _line(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 30000).cast("decimal(18,2)").alias("v"))
    dbl = lambda c: c.cast("double")
    return t.select("l_orderkey", "l_linenumber", dbl(N.round_half_away(v, 1)).alias("r1"), dbl(N.round_half_away(v)).alias("r0"), dbl(N.trunc(v)).alias("t0"), dbl(N.ceil(v)).alias("up"), dbl(N.floor(v)).alias("down"), dbl(F.abs(v)).alias("mag"), N.sign(v).cast("int").alias("sgn"), dbl(N.div(v, 7)).alias("d7"), N.to_int(v, "long").alias("whole"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code,
       coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) AS co, nullif(o_orderkey % 4, 1) AS nu, greatest(o_orderkey, o_custkey, nullif(o_custkey % 7, 0)) AS gr, least(o_orderkey, o_custkey, nullif(o_custkey % 7, 0)) AS le FROM orders""")
def conditionals(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low").alias("band"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).alias("code"),
        F.coalesce(N.nullif("o_orderstatus", "F"), "o_orderpriority").alias("co"), N.nullif(F.col("o_orderkey") % 4, 1).alias("nu"), N.greatest("o_orderkey", "o_custkey", N.nullif(F.col("o_custkey") % 7, 0)).alias("gr"), N.least("o_orderkey", "o_custkey", N.nullif(F.col("o_custkey") % 7, 0)).alias("le"),
    )


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS txt, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS back, CAST(o_orderkey % 2 AS BOOLEAN) AS flag, CAST(CAST(o_totalprice AS DECIMAL(18,1)) AS DOUBLE) AS dec1, CAST(o_orderdate AS DATE) AS day,
       left(o_orderpriority, 3) AS vc, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS midnight FROM orders""")
def casts(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("txt"), F.col("o_orderkey").cast("string").cast("long").alias("back"), (F.col("o_orderkey") % 2).cast("boolean").alias("flag"), F.col("o_totalprice").cast("decimal(18,1)").cast("double").alias("dec1"), F.col("o_orderdate").cast("date").alias("day"),
        X.varchar("o_orderpriority", 3).alias("vc"), F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("midnight"),
    )


@query("""SELECT event_id, time_bucket(INTERVAL '10 seconds', ts, TIMESTAMP '2000-01-01') AS b10, time_bucket(INTERVAL '7 hours', ts, TIMESTAMP '2024-01-15 03:00:00') AS b7h, ts + INTERVAL '90 minutes' AS later, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00') AS gap,
       ts + INTERVAL '1 month' AS next_month, CAST(ts AS DATE) + 3 AS in3, CAST(ts AS DATE) - DATE '2024-01-01' AS days FROM events""")
def time_arithmetic(spark, d):
    ts = F.col("ts")
    return load(spark, d, "events").select(
        "event_id", D.date_bin(10_000_000, ts).alias("b10"), D.date_bin(7 * 3_600_000_000, ts, "2024-01-15 03:00:00").alias("b7h"), D.plus_micros(ts, 90 * 60_000_000).alias("later"), D.gap_micros(ts, F.lit("2024-01-10 12:00:00")).alias("gap"),
        D.plus_months(ts, 1).alias("next_month"), D.date_plus(ts.cast("date"), 3).alias("in3"), D.date_minus(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"),
    )


_FIELDS = ("year", "month", "day", "quarter", "hour", "minute", "microseconds", "week", "isoyear", "dow", "isodow", "doy", "decade", "century", "millennium")


@query("SELECT o_orderkey, " + ", ".join(f"extract({f} FROM o_orderdate)::BIGINT AS f_{f}" for f in _FIELDS) + ", round(epoch(o_orderdate), 3) AS f_epoch, round(second(o_orderdate) + (extract(microseconds FROM o_orderdate) % 1000000) / 1e6, 6) AS f_second, round(extract(microseconds FROM o_orderdate) / 1e3, 3) AS f_milliseconds FROM orders")
def extract_fields(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", *[D.extract(f, t).alias(f"f_{f}") for f in _FIELDS], *[D.extract(f, t).cast("double").alias(f"f_{f}") for f in ("epoch", "second", "milliseconds")])


_UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")


@query("SELECT event_id, " + ", ".join({"century": "make_date((year(ts) - 1) // 100 * 100 + 1, 1, 1)::TIMESTAMP AS t_century", "millennium": "make_date((year(ts) - 1) // 1000 * 1000 + 1, 1, 1)::TIMESTAMP AS t_millennium"}.get(u, f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS t_{u}") for u in _UNITS) + " FROM events")
def truncate_dates(spark, d):
    return load(spark, d, "events").select("event_id", *[D.date_trunc(u, "ts").alias(f"t_{u}") for u in _UNITS])


@query("""SELECT o_orderkey, o_orderdate + INTERVAL '1 month' * (o_orderkey % 14) + INTERVAL '1 day' * (o_custkey % 40) + INTERVAL '3 hours' AS moved, epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-02-29 12:00:00') < 0 AS early,
       ((o_orderkey % 14) * 30 + o_custkey % 40) * 86400000000 + 10800000000 AS k FROM orders""")
def interval_arithmetic(spark, d):
    x = V.plus(V.times(V.interval(1), F.col("o_orderkey") % 14), V.interval(0, F.col("o_custkey") % 40, 3 * 3_600_000_000))
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate", x.alias("x"))
    early = V.duration_key(V.gap("o_orderdate", F.lit("1996-02-29 12:00:00"))) < 0
    return o.select("o_orderkey", V.shift("o_orderdate", "x").alias("moved"), early.alias("early"), V.duration_key("x").cast("long").alias("k"))


@query("""SELECT event_id, floor(epoch(ts))::BIGINT AS sec, CAST(NULL AS TIMESTAMP) AS nothing, time_bucket(INTERVAL '1 second', ts + INTERVAL '500 milliseconds', TIMESTAMP '2000-01-01') AS p0 FROM events""")
def timestamp_precision(spark, d):
    return load(spark, d, "events").select("event_id", F.floor(D.extract("epoch", "ts")).cast("long").alias("sec"), F.lit(None).cast("timestamp_ntz").alias("nothing"), D.at_precision("ts", 0).alias("p0"))
