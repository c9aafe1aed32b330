"""Format-preserving pseudonyms for personal numbers, addresses and dates, in Spark expressions alone.

A value is found by its pattern, validated, and replaced by another valid value of the same format: a keyed
Feistel permutation over its digits, with separators kept and check digits made anew. The permutation
depends on the key, the kind and the number of digits only (for mail names, on the classes of their characters and the
domain), so equal values stay linked across documents, and whoever holds the key can undo it.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATE = r"(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?![\d/-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
#: A card as it is commonly written, nothing after it.
_USUAL_CARD = r"(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![ -]?\d)"
#: A number with a country code, of 8 to 15 digits, that takes no part of an address or a dotted date. The count is spelt
#: out, as Java's lookbehind takes no such repetition.
_GENERAL = rf"(?<![\d+])\+\d{{1,3}}[ -]?\(?\d{{2,4}}\)?(?:[ -]?(?!{_IP}|\d\d[./]\d\d[./])\d{{2,4}}){{2,4}}(?!\d)" + r"(?<=\+\d" + r"[ ()-]{0,3}\d" * 7 + r"(?:[ ()-]{0,3}\d)?" * 7 + ")"
#: North American numbers have ten digits and end there. Others end before a date, a social security number or a card;
#: a plain number of 2 to 4 digits after one of these cannot be told from its last digits and is replaced with it.
_PHONE = "|".join([
    r"(?<![\d+])\+1[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}(?!\d)",
    rf"{_GENERAL}(?=[ -](?:{_DATE}|{_SSN}|{_USUAL_CARD}))",
    _GENERAL,
    r"(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
])
#: Patterns of the kinds (Java regular expressions, one alternative each); order settles overlaps.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "date": _DATE,
    "ssn": _SSN,
    "phone": _PHONE,
    "ip": _IP,
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]?\d)",
}
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31; of these, the number of those up to the 12th of a month and of later ones, each with the
#: sides of an oblong of hardly more.
DAYS = 73_049
EARLY, LATE = (28_800, 170, 170), (44_249, 211, 210)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Numbers of valid (area, group) pairs and of valid serials of social security numbers.
AREA_GROUPS, SERIALS = 898 * 99, 9999
#: The setting that holds the key, and the key of a session without it: it hides nothing from a reader of this file.
KEY_SETTING, OPEN_KEY = "spark.tarnflow.pii.key", "tarnflow"


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING; without it the open one, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with an open key and anyone can undo them", stacklevel=2)
    return key or OPEN_KEY


def feistel(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Permutes the strings of n digits, for any n from 2 to 36; shorter ones are kept.

    The digits are cut into halves of n // 2 and n - n // 2; every round adds a keyed function of one half to the other,
    modulo ten to the power of its length, and the roles change.
    """
    n = F.length(digits)
    a0, b0 = F.floor(n / 2).cast("int"), n - F.floor(n / 2).cast("int")
    sizes = (F.pow(F.lit(10.0), a0).cast("long"), F.pow(F.lit(10.0), b0).cast("long"))
    state = F.struct(F.substring(digits, F.lit(1), a0).cast("long").alias("a"), F.substring(digits, a0 + 1, b0).cast("long").alias("b"))

    def step(s: Column, k: Column) -> Column:
        even = F.pmod(k, F.lit(2)) == 0
        half, size = F.when(even, s["b"]).otherwise(s["a"]), F.when(even, sizes[0]).otherwise(sizes[1])
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), n.cast("string"), half.cast("string")), 256)
        add = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)
        change = lambda x: F.pmod(x - add if undo else x + add, size)
        return F.struct(F.when(even, change(s["a"])).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(change(s["b"])).alias("b"))

    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    done = F.aggregate(F.array(*[F.lit(k) for k in order]), state, step)
    return F.when(n < 2, digits).otherwise(F.concat(F.lpad(done["a"].cast("string"), a0, "0"), F.lpad(done["b"].cast("string"), b0, "0")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, its last digit counted once."""
    cs = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    return F.aggregate(F.transform(cs, lambda c, k: F.when(F.pmod(k, F.lit(2)) == 0, c).otherwise(F.when(c > 4, 2 * c - 9).otherwise(2 * c))), F.lit(0), lambda s, c: s + c)


def _in_format(value: Column, digits: Column) -> Column:
    """`value` with its digits replaced, in order, by those of `digits`."""
    cs = F.split(value, "")
    done = F.aggregate(
        cs,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return done["out"]


def _card(v: Column, key: str) -> Column:
    d = _digits(v)
    body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _in_format(v, F.concat(body, check.cast("string"))))


def _phone(v: Column, key: str) -> Column:
    """The country code (or, without one, nothing) stays."""
    code = F.regexp_extract(v, r"^\+\d{1,3}(?=[ (-])", 0)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    d = _digits(rest)
    return F.when(F.length(_digits(v)).between(8, 15), F.concat(code, _in_format(rest, feistel(d, key, "phone"))))


def permute_ssn(digits: Column, key: str, undo: bool = False) -> Column:
    """Permutes the valid numbers among themselves: a Feistel network over (area and group, serial), which are a full oblong."""
    area, group, serial = (F.substring(digits, *x).cast("long") for x in ((1, 3), (4, 2), (6, 4)))
    state = F.struct(((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1).alias("a"), (serial - 1).alias("b"))

    def step(s: Column, k: Column) -> Column:
        even = F.pmod(k, F.lit(2)) == 0
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("ssn"), k.cast("string"), F.when(even, s["b"]).otherwise(s["a"]).cast("string")), 256)
        add = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        change = lambda x, size: F.pmod(x - F.pmod(add, F.lit(size)) if undo else x + add, F.lit(size))
        return F.struct(F.when(even, change(s["a"], AREA_GROUPS)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(change(s["b"], SERIALS)).alias("b"))

    def written(s: Column) -> Column:
        area = F.floor(s["a"] / 99) + 1
        parts = (area + F.when(area >= 666, 1).otherwise(0), F.pmod(s["a"], F.lit(99)) + 1, s["b"] + 1)
        return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in zip(parts, (3, 2, 4), strict=True)])

    return F.aggregate(F.array(*[F.lit(k) for k in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS))]), state, step, written)


def _ssn(v: Column, key: str) -> Column:
    """Area, group and serial of a valid number."""
    d = _digits(v)
    return F.when(~d.rlike("^(?:000|666|9)|^...00|0000$"), _in_format(v, permute_ssn(d, key)))


def _ip(v: Column, key: str) -> Column:
    """An address as a 32-bit number: a Feistel network over its 16-bit halves."""
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    hi, lo = octets[0] * 256 + octets[1], octets[2] * 256 + octets[3]

    def step(s: Column, k: Column) -> Column:
        add = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip"), k.cast("string"), s["b"].cast("string")), 256), 1, 15), 16, 10).cast("long"), F.lit(65536))
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + add, F.lit(65536)).alias("b"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(hi.alias("a"), lo.alias("b")), step)
    out = F.concat_ws(".", *[F.floor(s[h] / 256).cast("string") if top else F.pmod(s[h], F.lit(256)).cast("string") for h in ("a", "b") for top in (True, False)])
    return F.when(F.forall(octets, lambda x: x <= 255), out)


def permute_days(day: Column, key: str, undo: bool = False) -> Column:
    """Permutes the numbers below DAYS, the first 12 days of months and the later ones each among themselves.

    So a date that can only be read month first keeps that order, and its pseudonym can be read in no other. Either kind is
    counted through and permuted by a Feistel network over an oblong of hardly more, walked until it is back in
    range. The oblongs have 100 and 61 numbers too many, so a walk has at most 101 steps.
    """
    first = F.lit("1900-01-01").cast("date")
    date = F.date_add(first, day.cast("int"))
    month = (F.year(date) - 1900) * 12 + F.month(date) - 1
    early = F.dayofmonth(date) <= 12
    n, a, b = (F.when(early, x).otherwise(y).cast("long") for x, y in zip(EARLY, LATE, strict=True))
    x = F.when(early, month * 12 + F.dayofmonth(date) - 1).otherwise(day - 12 * (month + 1)).cast("long")

    def once(x: Column, t: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            even = F.pmod(k, F.lit(2)) == 0
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("date"), t["n"].cast("string"), k.cast("string"), F.when(even, s["b"]).otherwise(s["a"]).cast("string")), 256)
            add = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
            change = lambda x, size: F.pmod(x - F.pmod(add, size) if undo else x + add, size)
            return F.struct(F.when(even, change(s["a"], t["a"])).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(change(s["b"], t["b"])).alias("b"))

        order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
        start = F.struct(F.floor(x / t["b"]).cast("long").alias("a"), F.pmod(x, t["b"]).alias("b"))
        return F.aggregate(F.array(*[F.lit(k) for k in order]), start, step, lambda s: s["a"] * t["b"] + s["b"])

    def walked(t: Column) -> Column:
        spare = max(p * q - m for m, p, q in (EARLY, LATE))
        return F.struct(t["n"].alias("n"), F.aggregate(F.sequence(F.lit(1), F.lit(spare)), once(t["x"], t), lambda s, _: F.when(s < t["n"], s).otherwise(once(s, t))).alias("x"))

    def number(t: Column) -> Column:
        days = lambda m: F.date_diff(F.add_months(first, m), first)
        m, x = F.floor(t["x"] / 12).cast("int"), t["x"]
        # no month begins as much as one from where it would if all were equal
        near = F.floor(x * 2400 / LATE[0]).cast("int")
        late = F.array_max(F.filter(F.transform(F.array(near - 1, near, near + 1), lambda m: F.when(days(m) - 12 * m <= x, m)), lambda m: m.isNotNull()))
        return F.when(t["n"] == EARLY[0], days(m) + F.pmod(x, F.lit(12))).otherwise(x + 12 * (late + 1))

    one = F.array(F.struct(x.alias("x"), n.alias("n"), a.alias("a"), b.alias("b")))
    return F.transform(F.transform(one, walked), number)[0]


def _date(v: Column, key: str) -> Column:
    """A calendar date from 1900 to 2099 as its number of days, permuted among those days.

    With slashes or dots it is read day first, or else month first, and its pseudonym has the same order.
    """
    first, sep = F.lit("1900-01-01").cast("date"), F.substring(v, 3, 1)
    read = lambda form: F.try_to_timestamp(F.regexp_replace(v, "[./]", "-"), F.lit(form)).cast("date")
    forms = F.array(*[F.struct(read(f).alias("d"), F.lit(k).alias("k")) for k, f in enumerate(("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy"))])

    def written(t: Column) -> Column:
        new = F.date_add(first, permute_days(F.date_diff(t["d"], first), key).cast("int"))
        split = lambda d, *fs: F.concat(F.date_format(d, fs[0]), sep, F.date_format(d, fs[1]), sep, F.date_format(d, "yyyy"))
        return F.transform(F.array(new), lambda d: F.when(t["k"] == 0, F.date_format(d, "yyyy-MM-dd")).when(t["k"] == 1, split(d, "dd", "MM")).otherwise(split(d, "MM", "dd")))[0]

    return F.get(F.transform(F.filter(forms, lambda t: t["d"].isNotNull()), written), F.lit(0))


def permute_name(local: Column, domain: Column, key: str, undo: bool = False) -> Column:
    """Permutes the names of a domain that have the same classes (digit, small letter, capital, the character itself) at each place.

    A Feistel network whose halves are the front and the back of the name: every round moves each letter and digit of one half
    within its class, by bytes of a keyed digest of the other half. Capitals go the way of their small letters.
    """
    n = F.length(local)
    half = F.floor(n / 2).cast("int")
    state = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, n).alias("b"))

    def moved(x: Column, other: Column, k: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), k.cast("string"), F.lower(domain), F.lower(other)), 256)

        def swap(c: Column, place: Column) -> Column:
            by = F.conv(F.substring(digest, F.pmod(place, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            by = -by if undo else by
            letter = F.substring(F.lit(_LETTERS), F.pmod(F.instr(F.lit(_LETTERS), F.lower(c)) - 1 + by, F.lit(26)) + 1, F.lit(1))
            return F.when(c.rlike("^[0-9]$"), F.pmod(c.try_cast("int") + by, F.lit(10)).cast("string")).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)

        return F.array_join(F.transform(F.split(x, ""), swap), "")

    def step(s: Column, k: Column) -> Column:
        even = F.pmod(k, F.lit(2)) == 0
        new = moved(F.when(even, s["a"]).otherwise(s["b"]), F.when(even, s["b"]).otherwise(s["a"]), k)
        return F.struct(F.when(even, new).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new).alias("b"))

    return F.aggregate(F.array(*[F.lit(k) for k in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS))]), state, step, lambda s: F.concat(s["a"], s["b"]))


def _email(v: Column, key: str) -> Column:
    """The part before the @ is permuted; the domain stays."""
    at = F.instr(v, "@")
    local, domain = F.substring(v, F.lit(1), at - 1), F.substring(v, at, F.length(v))
    return F.concat(permute_name(local, domain, key), domain)


_MAKERS = {"email": _email, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}


def _pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of a match of any kind, or the match itself if it fails validation."""
    tried = [F.when(v.rlike(f"^(?:{PATTERNS[k]})$"), F.coalesce(make(v, key), v)) for k, make in _MAKERS.items()]
    return F.coalesce(*tried, v)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with personal values of `text_col` replaced, and `n_pii` long, the number replaced.

    Kinds: payment cards (Luhn), telephone numbers, US social security numbers (range rules), IPv4 addresses
    (octets), calendar dates, and the names of mail addresses. What fails validation stays as it is, and so does
    the rare value that a permutation maps to itself (about one of a kind's, which one depends on the key).
    Nothing is shuffled, and rows without a digit or an @ skip the patterns. A null text
    stays null with n_pii 0, an empty one stays empty, and a very long one is searched as a whole. Null ids, repeated rows and
    empty tables need no care, as each row stands for itself. Other columns pass through; a column that is
    already called n_pii is replaced.
    """
    pattern = "|".join(f"(?:{p})" for p in PATTERNS.values())
    found_c, new_c = (_free(docs, x) for x in ("found", "new"))
    text, found, new = F.col(f"`{text_col}`"), F.col(found_c), F.col(new_c)
    # each step is its own projection, so that matches and pseudonyms are made once
    own = docs.withColumn(found_c, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))))
    own = own.withColumn(new_c, F.when(F.size(found) > 0, F.transform(found, lambda v: _pseudonym(v, key))))
    woven = F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda r, v: F.concat(r, F.coalesce(v, F.lit("")))), "")
    n = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    out = {text_col: F.when(F.size(found) > 0, woven).otherwise(text), "n_pii": F.when(F.size(found) > 0, n).otherwise(0).cast("long")}
    names = [*docs.columns, *(["n_pii"] if "n_pii" not in docs.columns else [])]
    return own.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in names])


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
