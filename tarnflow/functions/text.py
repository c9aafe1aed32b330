"""Text functions. Each returns a Column and takes Columns (or column names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _i(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(x) -> Column:
    """Number of characters."""
    return F.char_length(_c(x))


char_length = character_length = length


def octet_length(x) -> Column:
    return F.octet_length(_c(x))


def bit_length(x) -> Column:
    return F.bit_length(_c(x))


def ascii(x) -> Column:
    """Code point of the first character, 0 for an empty text."""
    x = _c(x)
    first = F.hex(F.encode(F.substring(x, 1, 1), "UTF-32"))
    return F.when(x == "", 0).otherwise(F.conv(first, 16, 10).cast("int"))


def chr(n) -> Column:
    """The character of a code point (Spark's own function wraps at 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(_i(n).cast("long")), 8, "0")), "UTF-32")


def lower(x) -> Column:
    """ASCII letters only, as under the C collation."""
    return F.translate(_c(x), UPPER, LOWER)


def upper(x) -> Column:
    return F.translate(_c(x), LOWER, UPPER)


def initcap(x) -> Column:
    """A letter is upper case if what precedes it is neither letter nor digit."""
    x = lower(x)
    cs = F.split(x, "")
    at = F.transform(cs, lambda c, k: F.when((k == 0) | ~F.element_at(cs, F.greatest(k, F.lit(1))).rlike("^[A-Za-z0-9]$"), F.translate(c, LOWER, UPPER)).otherwise(c))
    return F.array_join(at, "")


def left(x, n) -> Column:
    """First n characters; a negative n drops so many from the end."""
    x, n = _c(x), _i(n)
    return F.substring(x, F.lit(1), F.greatest(F.lit(0), F.when(n >= 0, n).otherwise(F.char_length(x) + n)))


def right(x, n) -> Column:
    x, n = _c(x), _i(n)
    k = F.greatest(F.lit(0), F.when(n >= 0, F.least(n, F.char_length(x))).otherwise(F.char_length(x) + n))
    return F.substring(x, F.char_length(x) - k + 1, k)


def ltrim(x, chars=None) -> Column:
    return F.ltrim(_c(x)) if chars is None else F.ltrim(_c(x), _i(chars))


def rtrim(x, chars=None) -> Column:
    return F.rtrim(_c(x)) if chars is None else F.rtrim(_c(x), _i(chars))


def btrim(x, chars=None) -> Column:
    return F.btrim(_c(x)) if chars is None else F.btrim(_c(x), _i(chars))


def replace(x, old, new) -> Column:
    """An empty search text changes nothing."""
    return F.when(_i(old) == "", _c(x)).otherwise(F.replace(_c(x), _i(old), _i(new)))


def translate(x, old: str, new: str) -> Column:
    return F.translate(_c(x), old, new)


def reverse(x) -> Column:
    return F.reverse(_c(x))


def repeat(x, n) -> Column:
    return F.repeat(_c(x), F.greatest(F.lit(0), _i(n)))


def lpad(x, n, fill=" ") -> Column:
    return F.when(_i(n) <= 0, "").otherwise(F.lpad(_c(x), _i(n), _i(fill)))


def rpad(x, n, fill=" ") -> Column:
    return F.when(_i(n) <= 0, "").otherwise(F.rpad(_c(x), _i(n), _i(fill)))


def strpos(x, part) -> Column:
    """1-based place of `part`, 0 if absent, 1 for an empty part."""
    return F.locate(part, _c(x)) if isinstance(part, str) else F.position(part, _c(x))


def starts_with(x, part) -> Column:
    return F.startswith(_c(x), _i(part))


def split_part(x, delimiter, n) -> Column:
    """The n-th field, counted from the end if negative; an empty text beyond."""
    return F.split_part(_c(x), _i(delimiter), _i(n))


def substr(x, start, count=None) -> Column:
    """Characters start .. start + count - 1; places before the first count but hold nothing."""
    x, start = _c(x), _i(start)
    first = F.greatest(F.lit(1), start)
    if count is None:
        return F.substring(x, first, F.char_length(x) + 1)
    return F.substring(x, first, F.greatest(F.lit(0), start + _i(count) - first))


substring = substr


def to_hex(x, bits: int = 64) -> Column:
    """Lower-case hexadecimal of the two's complement in 32 or 64 bits."""
    x = _c(x).cast("long")
    return F.lower(F.hex(x if bits == 64 else x.bitwiseAND(F.lit(0xFFFFFFFF))))


def concat(*xs) -> Column:
    """Skips nulls; an empty text if all are null."""
    return F.concat_ws("", *[_c(x).cast("string") for x in xs])


def concat_ws(separator, *xs) -> Column:
    """Skips nulls; null only if the separator is."""
    if isinstance(separator, str):
        return F.concat_ws(separator, *[_c(x).cast("string") for x in xs])
    parts = F.filter(F.array(*[_c(x).cast("string") for x in xs]), lambda x: x.isNotNull())
    return F.array_join(parts, separator)


def concat_op(*xs) -> Column:
    """The || operator: null if any part is."""
    return F.concat(*[_c(x).cast("string") for x in xs])


def varchar(x, n: int) -> Column:
    """An explicit cast to varchar(n) cuts off."""
    return F.substring(_c(x).cast("string"), 1, n)
