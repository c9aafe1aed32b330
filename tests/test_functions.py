"""Values PostgreSQL gives, where Spark's own functions differ."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import aggregates as A
from tarnflow.functions import numbers as N
from tarnflow.functions import predicates as P
from tarnflow.functions import temporal as D
from tarnflow.functions import text as X

T = dt.datetime


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    return value


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: X.chr(8364), "€"), (lambda: X.chr(65), "A"), (lambda: X.ascii(lit("€x")), 8364), (lambda: X.ascii(lit("")), 0),
        (lambda: X.initcap(lit("foo-bar BAZ 1a")), "Foo-Bar Baz 1a"), (lambda: X.upper(lit("aé")), "Aé"), (lambda: X.lower(lit("AÉ")), "aÉ"),
        (lambda: X.left(lit("abcde"), -2), "abc"), (lambda: X.left(lit("abc"), -9), ""), (lambda: X.right(lit("abcde"), -2), "cde"), (lambda: X.right(lit("abc"), 0), ""), (lambda: X.right(lit("abc"), 9), "abc"),
        (lambda: X.ltrim(lit("xxaxx"), "x"), "axx"), (lambda: X.rtrim(lit("xxaxx"), "x"), "xxa"), (lambda: X.btrim(lit("xyaxy"), "xy"), "a"),
        (lambda: X.substr(lit("abc"), 0, 2), "a"), (lambda: X.substr(lit("abc"), -1, 3), "a"), (lambda: X.substr(lit("abc"), 2), "bc"), (lambda: X.substr(lit("abc"), 3, 0), ""),
        (lambda: X.strpos(lit("abc"), ""), 1), (lambda: X.strpos(lit("abc"), "z"), 0), (lambda: X.split_part(lit("a/b/c"), "/", -1), "c"), (lambda: X.replace(lit("abc"), "", "x"), "abc"),
        (lambda: X.to_hex(lit(-1), 32), "ffffffff"), (lambda: X.to_hex(lit(-1)), "f" * 16), (lambda: X.concat(lit("a"), lit(None), lit("b")), "ab"), (lambda: X.concat(lit(None)), ""), (lambda: X.concat_op(lit("a"), lit(None)), None),
        (lambda: X.concat_ws(",", lit(None), lit("b")), "b"), (lambda: X.varchar(lit("abcdef"), 3), "abc"), (lambda: X.lpad(lit("abc"), -1), ""), (lambda: X.repeat(lit("ab"), -2), ""),
        (lambda: N.int_div(lit(-7), lit(2)), -3), (lambda: N.mod(lit(-7), lit(2)), -1), (lambda: N.trunc(lit(Decimal("-1.567")), 2), Decimal("-1.56")), (lambda: N.trunc(lit(Decimal("-1567")), -2), Decimal("-1500")),
        (lambda: N.to_int(lit(Decimal("2.5"))), 3), (lambda: N.to_int(lit(Decimal("-2.5"))), -3), (lambda: N.div(lit(Decimal("-7.5")), lit(Decimal("2"))), Decimal("-3")), (lambda: N.sign(lit(Decimal("-3"))), -1), (lambda: N.greatest(lit(None), lit(2), lit(1)), 2),
        (lambda: N.bit_xor(lit(6), lit(3)), 5), (lambda: N.shift_right(lit(-8), 1), -4),
        (lambda: P.ilike(lit("É"), "é"), False), (lambda: P.ilike(lit("ABC"), "a_c"), True), (lambda: P.in_list(lit(1), 2, None), None), (lambda: P.in_list(lit(2), 2, None), True),
        (lambda: P.row_compare("<", [lit(1), lit(None)], [lit(2), lit(1)]), True), (lambda: P.row_compare("<", [lit(1), lit(None)], [lit(1), lit(1)]), None),
        (lambda: D.date_bin(15 * 60_000_000, lit(T(1999, 12, 31, 23, 50)).cast("timestamp_ntz")), T(1999, 12, 31, 23, 45)),
        (lambda: D.plus_months(lit(T(2024, 1, 31, 5, 6, 7, 8)).cast("timestamp_ntz"), 1), T(2024, 2, 29, 5, 6, 7, 8)),
        (lambda: D.date_trunc("century", lit(T(2000, 5, 5)).cast("timestamp_ntz")), T(1901, 1, 1)), (lambda: D.date_trunc("decade", lit(T(1999, 5, 5)).cast("timestamp_ntz")), T(1990, 1, 1)),
        (lambda: D.extract("isoyear", lit(T(2021, 1, 1)).cast("timestamp_ntz")), 2020), (lambda: D.extract("dow", lit(T(2021, 1, 3)).cast("timestamp_ntz")), 0), (lambda: D.extract("isodow", lit(T(2021, 1, 3)).cast("timestamp_ntz")), 7),
        (lambda: D.extract("second", lit(T(2021, 1, 3, 1, 2, 3, 456789)).cast("timestamp_ntz")), Decimal("3.456789")), (lambda: D.extract("julian", lit(T(2000, 1, 1, 12)).cast("timestamp_ntz")), Decimal("2451545.500000")),
        (lambda: D.at_precision(lit(T(2021, 1, 3, 1, 2, 3, 456500)).cast("timestamp_ntz"), 3), T(2021, 1, 3, 1, 2, 3, 457000)),
        (lambda: F.size(D.hops(lit(T(2021, 1, 3)).cast("timestamp_ntz"), 10_000_000, 2_000_000)), 5),
    ],
)
def test_value(one, make, want):
    assert one(make()) == want


def test_zero_division_raises(one):
    with pytest.raises(Exception, match="ZERO"):
        one(N.int_div(lit(1), lit(0)))


def test_string_agg(spark):
    df = spark.createDataFrame([(1, "b", "-"), (1, "a", ","), (1, None, "!"), (1, "a", None), (2, None, ",")], "k int, v string, d string")
    got = {r.k: (r.x, r.y, r.z) for r in df.groupBy("k").agg(A.string_agg("v", F.col("d")).alias("x"), A.string_agg("v", ";", [F.col("d")]).alias("y"), A.string_agg("v", "+", distinct=True).alias("z")).collect()}
    assert got == {1: ("a,a-b", "a;a;b", "a+b"), 2: (None, None, None)}


def test_exact_aggregates(spark):
    df = spark.createDataFrame([(2**62,), (2**62,), (2**62,), (None,)], "v long")
    r = df.agg(A.sum_exact("v").alias("s"), A.avg_exact("v").alias("a")).first()
    assert (int(r.s), int(r.a)) == (3 * 2**62, 2**62)
