"""Dates, timestamps and their parts. Timestamps are without zone (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, _i

DAY = 86_400_000_000


def micros(ts) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n).cast("timestamp_ntz")


def date_bin(stride_us: int, ts, origin: str = "2000-01-01 00:00:00") -> Column:
    """Start of the stride that holds ts; strides are counted from `origin`, also backwards."""
    if stride_us <= 0:
        raise ValueError("stride must be greater than zero")
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    return from_micros(micros(ts) - F.pmod(micros(ts) - start, F.lit(stride_us)))


def plus_micros(ts, n) -> Column:
    return from_micros(micros(ts) + _i(n))


def gap_micros(a, b) -> Column:
    """a - b as microseconds."""
    return micros(a) - micros(b)


def plus_months(ts, n: int) -> Column:
    """Calendar addition: the day is cut to the length of the month, the time of day stays."""
    ts = _c(ts)
    day = F.date_trunc("day", ts)
    return from_micros(micros(F.add_months(ts, n)) + (micros(ts) - micros(day)))


def date_plus(d, days) -> Column:
    return F.date_add(_c(d), _i(days))


def date_minus(a, b) -> Column:
    """Days from b to a."""
    return F.date_diff(_c(a), _c(b))


def extract(field: str, ts) -> Column:
    """Parts of a timestamp; whole ones as bigint, those with fractions as decimal(20,6)."""
    ts = _c(ts)
    us = F.pmod(micros(ts), F.lit(60_000_000))
    year = F.year(ts).cast("long")
    week = F.date_trunc("week", ts)
    whole = {
        "year": year,
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "quarter": F.quarter(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "microseconds": us,
        "week": F.weekofyear(ts),
        "isoyear": F.year(F.date_add(week.cast("date"), 3)),
        "dow": F.dayofweek(ts) - 1,
        "isodow": F.weekday(ts) + 1,
        "doy": F.dayofyear(ts),
        "decade": F.floor(year / 10),
        "century": F.floor((year + 99) / 100),
        "millennium": F.floor((year + 999) / 1000),
    }
    if field in whole:
        return whole[field].cast("long")
    part = {
        "second": us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"),
        "milliseconds": us.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)"),
        "epoch": micros(ts).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"),
        "julian": (F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")) + 2_440_588).cast("decimal(20,0)") + F.pmod(micros(ts), F.lit(DAY)).cast("decimal(20,0)") / F.lit(DAY).cast("decimal(12,0)"),
    }
    if field in ("timezone", "timezone_hour", "timezone_minute"):
        return F.when(ts.isNotNull(), 0).cast("long")
    return part[field].cast("decimal(20,6)")


def date_trunc(field: str, ts) -> Column:
    """Also for decade, century and millennium, which Spark answers with null."""
    ts = _c(ts)
    if field in ("decade", "century", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[field]
        shift = 0 if field == "decade" else 1
        year = F.year(ts) - F.pmod(F.year(ts) - shift, F.lit(n))
        return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    if field in ("microseconds", "milliseconds"):
        return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(1 if field == "microseconds" else 1000)))
    return F.date_trunc(field, ts).cast("timestamp_ntz")


def at_precision(ts, digits: int) -> Column:
    """A cast to timestamp(p): rounds to so many digits of a second, half up."""
    unit = 10 ** (6 - digits)
    return from_micros(F.floor((micros(ts) + unit // 2) / unit) * unit)


def hops(ts, size_us: int, slide_us: int, origin: str = "2000-01-01 00:00:00") -> Column:
    """Starts of all windows of `size_us`, one every `slide_us`, that hold ts."""
    last = date_bin(slide_us, ts, origin)
    n = (size_us + slide_us - 1) // slide_us
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: from_micros(micros(last) - k * F.lit(slide_us)))
    return F.filter(starts, lambda s: micros(ts) - micros(s) < size_us)
