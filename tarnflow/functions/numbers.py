"""Integer, bitwise and exact numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, _i

EXACT = "decimal(38,{})"


def int_div(a, b) -> Column:
    """Integer division cut off towards zero; division by zero raises in ANSI mode."""
    a, b = _c(a).cast("decimal(19,0)"), _i(b).cast("decimal(19,0)")
    return ((a - a % b) / b).cast("long")


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend."""
    return _c(a) % _i(b)


def bit_and(a, b) -> Column:
    return _c(a).bitwiseAND(_i(b))


def bit_or(a, b) -> Column:
    return _c(a).bitwiseOR(_i(b))


def bit_xor(a, b) -> Column:
    """The # operator."""
    return _c(a).bitwiseXOR(_i(b))


def bit_not(a) -> Column:
    return F.bitwise_not(_c(a))


def shift_left(a, n: int) -> Column:
    return F.shiftleft(_c(a), n)


def shift_right(a, n: int) -> Column:
    """Arithmetic shift."""
    return F.shiftright(_c(a), n)


def exact(x, scale: int = 2) -> Column:
    """numeric(38, scale)."""
    return _c(x).cast(EXACT.format(scale))


def round_half_away(x, n: int = 0) -> Column:
    return F.round(_c(x), n)


def round_double(x, n: int = 0) -> Column:
    """A double times 10^n, rounded half away from zero and divided again, as DuckDB does it; F.round goes by the digits that are printed."""
    return F.round(_c(x) * 10.0**n) / 10.0**n


def trunc(x, n: int = 0) -> Column:
    """Digits behind the n-th decimal place are cut off."""
    x = _c(x)
    if n < 0:
        return x - x % F.lit(10**-n).cast("decimal(20,0)")
    scaled = F.abs(x) * F.lit(10**n).cast("decimal(20,0)")
    return (F.when(x < 0, -1).otherwise(1).cast("decimal(1,0)") * F.floor(scaled) / F.lit(10**n).cast("decimal(20,0)")).cast(f"decimal(38,{n})")


def ceil(x) -> Column:
    return F.ceil(_c(x))


ceiling = ceil


def floor(x) -> Column:
    return F.floor(_c(x))


def sign(x) -> Column:
    return F.when(_c(x) > 0, 1).when(_c(x) < 0, -1).when(_c(x) == 0, 0)


def div(a, b) -> Column:
    """Numeric quotient cut off to a whole number."""
    a, b = _c(a), _i(b)
    return ((a - a % b) / b).cast("decimal(38,0)")


def to_int(x, kind: str = "int") -> Column:
    """A cast from numeric rounds half away from zero."""
    return F.round(_c(x), 0).cast(kind)


def greatest(*xs) -> Column:
    """Nulls are skipped."""
    return F.greatest(*[_c(x) for x in xs])


def least(*xs) -> Column:
    return F.least(*[_c(x) for x in xs])


def nullif(a, b) -> Column:
    """Keeps the type of `a`."""
    a = _c(a)
    return F.when(a == _i(b), None).otherwise(a)
