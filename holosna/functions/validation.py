"""Checks of numerals, dates and identifiers: Catalyst expressions only; null for null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from holosna.functions import tables as T


def compact(text: Column) -> Column:
    """ASCII letters and digits, in upper case."""
    return F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def _values(text: Column, alphabet: str) -> Column:
    """Each character's place in the alphabet, -1 outside it."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def _weighted(values: Column, weights: list[int]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda v, w: v * w), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _digit(c: Column, at: int | Column) -> Column:
    """The digit at a place (from 1), an X as ten; text of digits only, else any number."""
    code = F.ascii(F.substring(c, F.lit(at) if isinstance(at, int) else at, F.lit(1)))
    return F.when(code == 88, 10).otherwise(code - 48)


def _place(n: Column, i: int) -> Column:
    """The digit of a long that has i digits behind it."""
    return (F.call_function("div", n, F.lit(10**i)) if i else n) % 10


def _weighted_digits(c: Column, weights: list[int]) -> Column:
    """A sum of weighted digits, by whole-number division of the text as one number, which compiles; the last may be an X.

    For texts of as many digits as there are weights, 18 at most; null or any number for others.
    """
    head, n = F.substring(c, 1, len(weights) - 1).try_cast("long"), len(weights) - 1
    terms = [_place(head, n - 1 - i) * w for i, w in enumerate(weights[:-1])]
    return reduce(lambda a, b: a + b, terms) + _digit(c, len(weights)) * weights[-1]


def roman_value(text: Column) -> Column:
    """The value of a Roman numeral; other characters count as zero, and a negative sum as none."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0)
    step = lambda s, v: F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).alias("sum"), v.alias("last"))
    values = F.transform(F.reverse(F.filter(F.split(text, ""), lambda c: c != "")), value)
    return F.greatest(F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda s: s["sum"]), F.when(text.isNotNull(), 0)).cast("long")


def valid_roman(text: Column) -> Column:
    """Of the classic shape; the empty string is."""
    return text.rlike(r"\AM{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\z")


def valid_date(day: Column, month: Column, year: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    most = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= most)


def valid_iso_week(year: Column, week: Column) -> Column:
    """Weeks 1 to 52, and 53 in years that begin on a Thursday, or on a Wednesday if leap."""
    p = year - 1
    div = lambda n: F.call_function("div", p, F.lit(n))
    first = (p + div(4) - div(100) + div(400) + 1) % 7
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return week.between(1, 52) | ((week == 53) & ((first == 4) | ((first == 3) & leap)))


def valid_isbn(text: Column) -> Column:
    c = compact(text)
    ten = c.rlike(r"\A[0-9]{9}[0-9X]\z") & (_weighted_digits(c, list(range(10, 0, -1))) % 11 == 0)
    thirteen = c.rlike(r"\A97[89][0-9]{10}\z") & (_weighted_digits(c, [1, 3] * 6 + [1]) % 10 == 0)
    return ten | thirteen


def valid_issn(text: Column) -> Column:
    c = compact(text)
    return c.rlike(r"\A[0-9]{7}[0-9X]\z") & (_weighted_digits(c, list(range(8, 0, -1))) % 11 == 0)


def valid_iban(text: Column) -> Column:
    """Shape, length by country where that is known, and the remainder of the rotated number by 97."""
    c = compact(text)
    lengths = F.create_map(*[F.lit(x) for pair in T.IBAN_LENGTHS.items() for x in pair])
    long_enough = F.coalesce(F.try_element_at(lengths, F.substring(c, 1, 2)), F.length(c)) == F.length(c)
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
    rest = F.aggregate(_values(turned, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(0), lambda r, v: F.when(v < 10, r * 10 + v).otherwise(r * 100 + v) % 97)
    return c.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & long_enough & (rest == 1)


def valid_luhn(text: Column) -> Column:
    """Digits, spaces and hyphens only, 12 to 19 digits, and their Luhn sum."""
    digits = F.translate(text, " -", "")
    size, filled = F.length(digits), F.lpad(digits, 20, "0")  # zeros before a number don't change its sum
    halves = [F.substring(filled, at, 10).try_cast("long") for at in (1, 11)]
    doubled = lambda d: d * 2 - F.call_function("div", d + 5, F.lit(10)) * 9
    total = reduce(lambda a, b: a + b, (_place(n, i) if i % 2 == 0 else doubled(_place(n, i)) for n in halves for i in range(10)))
    return text.rlike(r"\A[0-9 -]*\z") & size.between(12, 19) & (total % 10 == 0)


def valid_vin(text: Column) -> Column:
    """17 characters without I, O, Q; the check digit counts where the first character is 1 to 5."""
    c = compact(text)
    of = {ch: i % 9 + 1 for i, ch in enumerate("ABCDEFGH")} | {ch: i + 1 for i, ch in enumerate("JKLMN")} | {"P": 7, "R": 9} | {ch: i + 2 for i, ch in enumerate("STUVWXYZ")} | {str(d): d for d in range(10)}
    value = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    total = _weighted(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.try_element_at(value, x)), [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])
    check = F.when(total % 11 == 10, F.lit("X")).otherwise((total % 11).cast("string"))
    return c.rlike(r"\A[A-HJ-NPR-Z0-9]{17}\z") & (~F.substring(c, 1, 1).between("1", "5") | (F.substring(c, 9, 1) == check))


def valid_uuid(text: Column) -> Column:
    """32 hex digits, all zero or of a known version and variant."""
    return compact(text).rlike(r"\A(?:0{32}|[0-9A-F]{12}[1-8][0-9A-F]{3}[89AB][0-9A-F]{15})\z")


def valid_hash_length(algorithm: Column, text: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for pair in T.HASH_LENGTHS.items() for x in pair])
    c = compact(text)
    return F.when(algorithm.isNotNull() & text.isNotNull(), F.coalesce(F.try_element_at(lengths, compact(algorithm)) == F.length(c), F.lit(False)) & c.rlike(r"\A[0-9A-F]*\z"))
