"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found values are first validated: card numbers by issuer prefix and Luhn digit, dates by the calendar,
social security numbers by their reserved blocks, IPv4 addresses by octet. A valid value is turned into
symbols with a radix for each place, run through a keyed Feistel permutation over those symbols,
and written back into the very layout it was found in. The permutation is a bijection on each
format and depends on key, kind and value only, so equal values stay equal across documents
however they are punctuated, and different ones stay different.

=======  ==============================================================================
kind     symbols
=======  ==============================================================================
email    letters and digits of the local part, each within its class; the domain stays
ip       four octets
card     digits after the first four, and the Luhn digit computed anew
phone    the ten national digits; the country code stays
ssn      area (without 000, 666, 9xx), group (not 00), serial (not 0000)
date     day number in 1800-2199, one whole Gregorian cycle of 146,097 = 189 x 773 days
secret   quoted hexadecimal strings of 32 to 64 digits, case kept
=======  ==============================================================================

Nulls: a null text stays null with no findings. Rows are mapped one by one: repeated rows give
repeated rows, an empty table none; a very long text is searched whole. Columns other than text stay as they are, whatever
their names: work columns get a name no column has, and where ``pii_kinds`` is taken the new column has an underscore more.
A local part of one symbol has no other half, so its class is permuted as a whole, by the order of keyed hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)"
PHONE = r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d-]|\.\d)"
SECRET = r"(?<=[\"'])[0-9A-Fa-f]{32,64}(?=[\"'])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IP, DATE, SSN, PHONE, CARD))
#: Issuer prefixes of payment cards.
ISSUER = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)|3[47]|3(?:0[0-5]|[689])|35|6(?:011|4[4-9]|5))"
CYCLE, CYCLE_START, LONG, SHORT = 146097, "1800-01-01", 773, 189


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(value, r"\D", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _luhn(payload: Column) -> Column:
    """The digit that makes the digits before it valid."""
    doubled = F.transform(F.reverse(payload), lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return _let(F.aggregate(doubled, F.lit(0), lambda a, x: a + x), lambda total: (F.lit(10) - total % 10) % 10)


def _calendar(value: Column) -> Column:
    """The date a string names, or null. With slashes, month first unless that can't be."""
    month_first = F.substring(value, 1, 2) <= "12"
    slashed = F.when(month_first, F.try_to_timestamp(value, F.lit("MM/dd/yyyy"))).otherwise(F.try_to_timestamp(value, F.lit("dd/MM/yyyy")))
    return (
        F.when(value.contains("/"), slashed).when(value.contains("."), F.try_to_timestamp(value, F.lit("dd.MM.yyyy"))).otherwise(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
    ).cast("date")


def _kind(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    digits = F.regexp_replace(m, r"\D", "")
    card = digits.rlike(ISSUER) & _let(_digits(m), lambda d: _luhn(F.slice(d, F.lit(1), F.size(d) - 1)) == F.element_at(d, -1))
    ssn = ~m.rlike(r"^(?:000|666|9)") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    day = F.datediff(_calendar(m), F.lit(CYCLE_START).cast("date"))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9A-Fa-f]{32,64}$"), "secret")
        .when(whole(IP), "ip")
        .when(whole(DATE), F.when((day >= 0) & (day < CYCLE), "date"))
        .when(whole(SSN), F.when(ssn, "ssn"))
        .when(whole(PHONE), "phone")
        .when(card, "card")
    )


def _class(c: Column) -> Column:
    """First code of a character's class: its symbol is its distance from that."""
    return F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)


def _symbols(kind: Column, m: Column) -> Column:
    """(value, radix) of each symbol."""
    pair = lambda v, r: F.struct(v.cast("int").alias("v"), r.cast("int").alias("r"))
    ten = lambda a: F.transform(a, lambda d: pair(d, F.lit(10)))
    local = F.filter(F.split(F.substring_index(m, "@", 1), ""), lambda c: c.rlike("^[0-9A-Za-z]$"))
    letters = F.transform(local, lambda c: pair(F.ascii(c) - _class(c), F.when(c.rlike("[0-9]"), 10).otherwise(26)))
    octets = F.transform(F.split(m, r"\."), lambda o: pair(o.cast("int"), F.lit(256)))
    card = _let(_digits(m), lambda d: ten(F.slice(d, F.lit(5), F.size(d) - 5)))
    phone = _let(_digits(m), lambda d: ten(F.slice(d, F.lit(-10), F.lit(10))))
    area = F.substring(m, 1, 3).cast("int")
    ssn = F.array(
        pair(area - 1 - F.when(area > 666, 1).otherwise(0), F.lit(898)), pair(F.substring(m, 5, 2).cast("int") - 1, F.lit(99)), pair(F.substring(m, 8, 4).cast("int") - 1, F.lit(9999))
    )
    date = _let(F.datediff(_calendar(m), F.lit(CYCLE_START).cast("date")), lambda d: F.array(pair(F.floor(d / LONG), F.lit(SHORT)), pair(d % LONG, F.lit(LONG))))
    hexed = F.transform(F.filter(F.split(F.lower(m), ""), lambda c: c != ""), lambda c: pair(F.instr(F.lit("0123456789abcdef"), c) - 1, F.lit(16)))
    by = {"email": letters, "ip": octets, "card": card, "phone": phone, "ssn": ssn, "date": date, "secret": hexed}
    return reduce(lambda w, k: w.when(kind == k, by[k]), by, F.when(F.lit(False), letters))


def feistel(kind: Column, symbols: Column, key: str) -> Column:
    """The symbols' values after ROUNDS rounds: halves in turn shifted by a keyed hash of the other half."""
    values, radix = F.transform(symbols, lambda s: s["v"]), F.transform(symbols, lambda s: s["r"])
    half = F.floor(F.size(symbols) / 2).cast("int")

    def shift(i: Column, j: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), kind, i.cast("string"), j.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % r

    def turn(v: Column, i: Column) -> Column:
        left, right = F.slice(v, F.lit(1), half), F.slice(v, half + 1, F.size(v) - half)
        moved_left = F.transform(left, lambda x, j: _mod(x, shift(i, j, right, F.get(radix, j)), F.get(radix, j)))
        moved_right = F.transform(right, lambda x, j: _mod(x, shift(i, j, left, F.get(radix, half + j)), F.get(radix, half + j)))
        return F.when(i % 2 == 0, F.concat(moved_left, right)).otherwise(F.concat(left, moved_right))

    alone = lambda v, r: F.get(F.array_sort(F.transform(F.sequence(F.lit(0), r - 1), lambda x: F.struct(F.sha2(F.concat_ws(":", F.lit(key), kind, x.cast("string")), 256), x.alias("x")))), v)["x"]
    single = F.transform(symbols, lambda s: alone(s["v"], s["r"]))
    return F.when(F.size(symbols) == 1, single).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn))


def _mod(x: Column, by: Column, radix: Column) -> Column:
    return ((x + by) % radix).cast("int")


def _refill(layout: Column, wanted: str, fill: Column) -> Column:
    """``layout`` with its characters of a class replaced in order by the elements of ``fill``."""
    chars = F.filter(F.split(layout, ""), lambda c: c != "")
    return _let(chars, lambda cs: F.array_join(F.transform(cs, lambda c, i: F.when(c.rlike(wanted), F.get(fill, F.size(F.filter(F.slice(cs, F.lit(1), i), lambda b: b.rlike(wanted))))).otherwise(c)), ""))


def _written(kind: Column, m: Column, v: Column) -> Column:
    """The permuted values in the layout of ``m``."""
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    chars = F.filter(F.split(F.substring_index(m, "@", 1), ""), lambda c: c.rlike("^[0-9A-Za-z]$"))
    email = F.concat(_refill(F.substring_index(m, "@", 1), "^[0-9A-Za-z]$", F.zip_with(chars, v, lambda c, x: F.char(_class(c) + x))), F.substring(m, F.instr(m, "@"), F.lit(1 << 20)))
    head = _let(_digits(m), lambda d: F.concat(F.slice(d, F.lit(1), F.lit(4)), v))
    card = _let(head, lambda p: _refill(m, "^[0-9]$", text(F.concat(p, F.array(_luhn(p))))))
    phone = _let(_digits(m), lambda d: _refill(m, "^[0-9]$", text(F.concat(F.slice(d, F.lit(1), F.size(d) - 10), v))))
    area = F.get(v, 0) + 1 + F.when(F.get(v, 0) >= 665, 1).otherwise(0)
    ssn = F.format_string("%03d-%02d-%04d", area, F.get(v, 1) + 1, F.get(v, 2) + 1)
    day = F.date_add(F.lit(CYCLE_START).cast("date"), F.get(v, 0) * LONG + F.get(v, 1))
    slash = F.when(F.substring(m, 1, 2) <= "12", F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    date = F.when(m.contains("/"), slash).when(m.contains("."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    hexed = _let(F.array_join(F.transform(v, lambda x: F.substring(F.lit("0123456789abcdef"), x + 1, F.lit(1))), ""), lambda s: F.when(m.rlike("[A-F]"), F.upper(s)).otherwise(s))
    by = {"email": email, "ip": F.array_join(text(v), "."), "card": card, "phone": phone, "ssn": ssn, "date": date, "secret": hexed}
    return reduce(lambda w, k: w.when(kind == k, by[k]), by, F.when(kind.isNull(), m))


def _free(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    return _free(name + "_", taken) if name.lower() in {c.lower() for c in taken} else name


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``column`` replaced; adds ``pii_kinds``, in text order."""
    found, kind, given, drawn, new = (_free(c, docs.columns) for c in ("_pii", "_pii_kind", "_pii_in", "_pii_out", "_pii_new"))
    df = docs.withColumn(found, F.coalesce(F.regexp_extract_all(F.col(column), F.lit(ANY), F.lit(0)), F.array().cast("array<string>")))
    df = df.withColumn(kind, F.transform(found, _kind))
    df = df.withColumn(given, F.zip_with(kind, found, _symbols))
    df = df.withColumn(drawn, F.zip_with(kind, given, lambda k, s: F.when(k.isNotNull(), feistel(k, s, key))))
    df = df.withColumn(new, F.transform(drawn, lambda v, i: _written(F.get(F.col(kind), i), F.get(F.col(found), i), v)))
    rest = F.split(F.col(column), ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(rest, F.col(new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    df = df.withColumn(column, F.when(F.size(found) > 0, joined).otherwise(F.col(column)))
    df = df.withColumn(_free("pii_kinds", docs.columns), F.filter(kind, lambda k: k.isNotNull()))
    return df.drop(found, kind, given, drawn, new)
