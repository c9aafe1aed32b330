"""Intervals of months, days and microseconds, which Spark can't hold in one value: structs of the three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import DAY, from_micros, micros
from .text import _c, _i


def interval(months=0, days=0, us=0) -> Column:
    """Null if a part is."""
    parts = [_i(x).cast("long") for x in (months, days, us)]
    whole = F.struct(*[p.alias(n) for p, n in zip(parts, ("months", "days", "micros"), strict=True)])
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), whole)


def duration_key(x) -> Column:
    """What intervals compare by: a month counts 30 days, a day 24 hours."""
    x = _c(x)
    return (x["months"] * 30 + x["days"]).cast("decimal(20,0)") * F.lit(DAY).cast("decimal(12,0)") + x["micros"].cast("decimal(20,0)")


def plus(a, b) -> Column:
    a, b = _c(a), _c(b)
    return interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def negate(x) -> Column:
    x = _c(x)
    return interval(-x["months"], -x["days"], -x["micros"])


def times(x, n) -> Column:
    """Multiplication by a whole number."""
    x, n = _c(x), _i(n)
    return interval(x["months"] * n, x["days"] * n, x["micros"] * n)


def shift(ts, x) -> Column:
    """Timestamp + interval: months first, with the day cut to the month's length, then days, then microseconds."""
    ts, x = _c(ts), _c(x)
    day = F.date_trunc("day", ts)
    moved = F.date_add(F.add_months(day.cast("date"), x["months"].cast("int")), x["days"].cast("int"))
    return from_micros(micros(moved) + (micros(ts) - micros(day)) + x["micros"])


def gap(a, b) -> Column:
    """Timestamp - timestamp: whole days and the rest."""
    us = micros(a) - micros(b)
    days = F.when(us >= 0, F.floor(us / DAY)).otherwise(-F.floor(-us / DAY))
    return interval(0, days, us - days * DAY)


def justify(x) -> Column:
    """At most 24 hours go to days, and 30 days to months."""
    x = _c(x)
    days = x["days"] + F.floor(x["micros"] / DAY)
    return interval(x["months"] + F.floor(days / 30), F.pmod(days, F.lit(30)), F.pmod(x["micros"], F.lit(DAY)))
