"""Numbers as words: Catalyst expressions only. Tables are constant arrays and maps; no row leaves the JVM.

Each function takes a column of whole numbers (any numeric or numeral string type). Numbers over MAX_SPELLED_NUMBER are
read digit by digit, however long the numeral is; null, a negative number, and a text that is no numeral give null.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from holosna.functions import tables as T


def _list(values: list[str]) -> Column:
    return F.split(F.lit("|".join(values)), r"\|", -1)


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def _whole(n: Column) -> Column:
    """The number, if it is one of at most 20 digits and not negative."""
    whole = n.try_cast("decimal(20,0)")
    return F.when(whole >= 0, whole)


def plural_of(n: Column, one, few, many) -> Column:
    """The form of a counted noun that agrees with n."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    teens = (n % 100).between(11, 14)
    return F.when(~teens & (n % 10 == 1), lit(one)).when(~teens & (n % 10).between(2, 4), lit(few)).otherwise(lit(many))


def digit_words(text: Column) -> Column:
    """ASCII digits read one by one; other characters are left out."""
    names = _list([T.ZERO, *T.ONES[1:]])
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda d: F.get(names, d.cast("int"))), " ")


def _scales(k: Column, form: Callable[[str], str] = str) -> list[Column]:
    """Words of the thousands and up of a long, each part null where there are none; form changes single words."""
    each = lambda words: " ".join(map(form, words.split()))
    three = _list([each(T.below_thousand(i)) + " " for i in range(1000)])
    # one thousand goes without its number
    thousands = _list(["" if i == 1 else each(T.agreed(T.below_thousand(i), "f")) + " " for i in range(1000)])
    parts = []
    for value, forms in T.SCALES.items():
        count = _div(k, value) % 1000
        parts.append(F.when(count > 0, F.concat(F.get(thousands if value == 1000 else three, count.cast("int")), plural_of(count, *map(form, forms)))))
    return parts


def _below(k: Column, table: Callable[[int], str]) -> Column:
    """By a table of the last three digits; null where they are zeros."""
    low = k % 1000
    return F.when(low > 0, F.get(_list([table(i) for i in range(1000)]), low.cast("int")))


def _by_path(n: Column, integral: bool, spelled: Callable[[Column], Column], digits: Callable[[Column], Column]) -> Column:
    """spelled of n as a long, or digits of its numeral if it is over MAX_SPELLED_NUMBER. An integral column needs no casts."""
    if integral:
        return F.when(n.between(0, T.MAX_SPELLED_NUMBER), spelled(n.cast("long"))).when(n > T.MAX_SPELLED_NUMBER, digits(n.cast("string")))
    whole, numeral = _whole(n), n.cast("string")
    k = F.when(whole <= T.MAX_SPELLED_NUMBER, whole).cast("long")
    return F.when(k.isNotNull(), spelled(k)).when(whole.isNotNull(), digits(whole.cast("string"))).when(numeral.rlike(r"\A[0-9]{21,}\z"), digits(numeral))


def _in_row_gender(gender: str | Column, of: Callable[[str], Column]) -> Column:
    if isinstance(gender, str):
        return of(gender)
    return F.when(gender == "f", of("f")).when(gender == "n", of("n")).otherwise(of("m"))


def below_thousand_words(n: Column, gender: str | Column = "m") -> Column:
    """Cardinal words of a whole number from 0 to 999, by one look into a table."""
    return _in_row_gender(gender, lambda g: F.get(_list([T.agreed(T.below_thousand(i), g) or T.ZERO for i in range(1000)]), n.cast("int")))


def number_words(n: Column, gender: str | Column = "m", integral: bool = False) -> Column:
    """Cardinal words; the last word agrees with the gender m, f or n, of all rows or (a column) of each.

    integral: n is of a whole-number type, which spares casts and the reading of longer numerals.
    """

    def spelled(k: Column) -> Column:
        low = _in_row_gender(gender, lambda g: _below(k, lambda i: T.agreed(T.below_thousand(i), g)))
        return F.when(k == 0, F.lit(T.ZERO)).otherwise(F.concat_ws(" ", *_scales(k), low))

    return _by_path(n, integral, spelled, lambda numeral: _in_row_gender(gender, lambda g: in_gender(digit_words(numeral), g)))


def _div(k: Column, value: int) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", k, F.lit(value))


def in_gender(words: Column, gender: str) -> Column:
    """The last word of a cardinal in the gender m, f or n."""
    if gender == "f":
        return F.regexp_replace(F.regexp_replace(words, r"(^| )один\z", "$1одна"), r"(^| )два\z", "$1дві")
    return F.regexp_replace(words, r"(^| )один\z", "$1одне") if gender == "n" else words


def case_words(n: Column, case: str, gender: str = "m", integral: bool = False) -> Column:
    """Cardinal words in the case gen, dat, instr or prep; words without case forms stay as they are."""
    forms = {w: f[T.CASES.index(case)] for w, f in T.case_forms().items()}
    form = lambda w: forms.get(w, w)

    def spelled(k: Column) -> Column:
        low = _below(k, lambda i: " ".join(map(form, T.agreed(T.below_thousand(i), gender).split())))
        return F.when(k == 0, F.lit(form(T.ZERO))).otherwise(F.concat_ws(" ", *_scales(k, form), low))

    table = _map(forms)
    one_by_one = lambda numeral: F.array_join(F.transform(F.split(in_gender(digit_words(numeral), gender), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return _by_path(n, integral, spelled, one_by_one)


def ordinal_words(n: Column, form: str = "nom_m", integral: bool = False) -> Column:
    """Ordinal words in one of the forms of tables.HARD_ENDINGS, or nom_m."""
    stems = {w: T.inflected(s, form) for w, s in T.ORDINAL_STEMS.items()}
    ending = T.HARD_ENDINGS.get(form, "")
    round_ = _map({str(k * 1000): T.inflected(p + "тисячний", form) for k, p in T.ROUND_THOUSANDS.items()})

    def last_changed(words: Column) -> Column:
        parts = F.split(words, " ")
        last = F.element_at(parts, -1)
        changed = F.coalesce(F.try_element_at(_map(stems), last), F.concat(last, F.lit(ending)))
        return F.array_join(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(changed)), " ")

    def below(i: int) -> str:
        *head, last = T.below_thousand(i).split() or [T.ZERO]
        return " ".join([*head, stems.get(last, last + ending)])

    def spelled(k: Column) -> Column:
        rest = F.concat_ws(" ", *_scales(k))
        whole_thousands = F.coalesce(F.try_element_at(round_, k.cast("string")), last_changed(rest))
        return F.when(k == 0, F.lit(stems[T.ZERO])).when(k % 1000 > 0, F.concat_ws(" ", *_scales(k), _below(k, below))).otherwise(whole_thousands)

    digits = lambda numeral: last_changed(digit_words(numeral))
    # a numeral beyond 20 digits has no ordinal
    return _by_path(n, integral, spelled, digits) if integral else F.when(_whole(n).isNotNull(), _by_path(n, integral, spelled, digits))


def decimal_words(whole: Column, fraction: Column) -> Column:
    """A decimal from its digit strings, as ``дві цілих і п'ять десятих``.

    More than six places, an empty whole part (read as zero) and one that doesn't fit 64 bits are read as digits after ``кома``.
    """
    f, w = fraction, F.when(_whole(whole) < F.lit(Decimal(2**64)), whole)
    one = lambda x: (_whole(x) % 10 == 1) & (_whole(x) % 100 != 11)
    names = F.when(one(f), F.get(_list([a for a, _ in T.PLACES]), F.length(f) - 1)).otherwise(F.get(_list([b for _, b in T.PLACES]), F.length(f) - 1))
    spoken = F.concat_ws(" ", number_words(w, "f"), F.when(one(w), "ціла").otherwise("цілих"), F.lit("і"), number_words(f, "f"), names)
    digits = F.concat_ws(" ", number_words(F.when(whole == "", F.lit("0")).otherwise(whole)), F.lit("кома"), digit_words(f))
    return F.when(whole.isNotNull() & f.isNotNull(), F.when(w.isNotNull() & F.length(f).between(1, len(T.PLACES)), spoken).otherwise(digits))


def fraction_words(numerator: Column, denominator: Column) -> Column:
    """``три четвертих``; a numerator in one takes the singular."""
    n = _whole(numerator)
    single = (n % 10 == 1) & (n % 100 != 11)
    return F.concat_ws(" ", number_words(numerator, "f"), F.when(single, ordinal_words(denominator, "nom_f")).otherwise(ordinal_words(denominator, "pl")))


def counted(n: Column, one: str, few: str, many: str, gender: str = "m", integral: bool = False) -> Column:
    """A number with its noun, both agreeing."""
    return F.concat_ws(" ", number_words(n, gender, integral), plural_of(n if integral else _whole(n), one, few, many))


def hours_words(hour: Column, integral: bool = False) -> Column:
    return counted(hour, "година", "години", "годин", "f", integral)


def minutes_words(minute: Column, integral: bool = False) -> Column:
    return counted(minute, "хвилина", "хвилини", "хвилин", "f", integral)


def identifier_number(digits: Column) -> Column:
    """Digits inside an identifier: over four, or after a leading zero, one by one; else as a number."""
    return F.when((F.length(digits) > 4) | ((F.length(digits) > 1) & digits.startswith("0")), digit_words(digits)).otherwise(number_words(digits))
