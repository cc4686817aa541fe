"""Readers of typed columns: amounts of money, quantities, shares, dates and clock times, without a text to parse.

Numbers are decimals or whole numbers, not doubles, whose digits aren't what was written. Units and currencies are
tables: their forms are columns of a row, or literals of one unit. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holosna.functions import numbers
from holosna.functions import tables as T
from holosna.normal import dates
from holosna.normal.lexicon import CURRENCIES, UNIT, Currency, Unit
from holosna.normal.ranges import PERCENT
from holosna.normal.temperature import DEGREE, WRITTEN

MINUS = "мінус "
HOUR, MINUTE, SECOND = Unit("година", "години", "годин", "години", "f"), Unit("хвилина", "хвилини", "хвилин", "хвилини", "f"), Unit("секунда", "секунди", "секунд", "секунди", "f")


def unit_forms(unit: Unit) -> Column:
    """A unit's forms as a struct: one, few, many, decimal, gender."""
    return F.struct(*(F.lit(v).alias(k) for k, v in unit._asdict().items()))


def currencies(spark: SparkSession) -> DataFrame:
    """code, digits (of the subunit), main and sub (structs of forms) of the currencies that the lexicon knows."""
    rows = [(c.code, c.digits, tuple(c.main), tuple(c.sub)) for c in CURRENCIES]
    forms = "struct<one:string,few:string,many:string,decimal:string,gender:string>"
    return spark.createDataFrame(rows, f"code string, digits int, main {forms}, sub {forms}")


def units(spark: SparkSession) -> DataFrame:
    """key and forms of the units that the lexicon knows."""
    return spark.createDataFrame([(k, tuple(u)) for k, u in UNIT.items()], "key string, forms struct<one:string,few:string,many:string,decimal:string,gender:string>")


def _counted(n: Column, forms: Column) -> Column:
    """A long with its noun; the gender is the row's."""
    return F.concat(numbers.number_words(n, forms["gender"], integral=True), F.lit(" "), numbers.plural_of(n, forms["one"], forms["few"], forms["many"]))


def _few(n: Column, forms: Column) -> Column:
    """The same for a number under a thousand."""
    return F.concat(numbers.below_thousand_words(n, forms["gender"]), F.lit(" "), numbers.plural_of(n, forms["one"], forms["few"], forms["many"]))


def _whole_and_part(size: Column) -> tuple[Column, Column]:
    """A decimal that isn't negative as a long and the digits behind its point, zeros at the end left out (none: an empty text)."""
    text = size.cast("string")
    part = F.when(F.contains(text, F.lit(".")), F.rtrim(F.substring_index(text, ".", -1), F.lit("0"))).otherwise("")
    return F.floor(size).cast("long"), part


def _sign(value: Column) -> Column:
    return F.when(value < 0, F.lit(MINUS)).otherwise(F.lit(""))


def quantity_words(value: Column, forms: Column) -> Column:
    """A decimal with its unit: ``п'ять кілограмів``, ``дві цілих і п'ять десятих кілограма``."""
    whole, part = _whole_and_part(F.abs(value))
    said = F.when(part == "", _counted(whole, forms)).otherwise(F.concat(numbers.decimal_words(whole.cast("string"), part), F.lit(" "), forms["decimal"]))
    return F.concat(_sign(value), said)


def amount_words(value: Column, currency: Column) -> Column:
    """A decimal amount in whole and subunits; currency is a struct of digits, main and sub.

    An amount finer than the subunit has no reading (null). A currency without a subunit takes decimals.
    """
    size, digits = F.abs(value), currency["digits"]
    whole, part = _whole_and_part(size)
    cents = F.rpad(part, digits, "0").cast("long")
    main, sub = _counted(whole, currency["main"]), _few(cents, currency["sub"])
    decimal = F.concat(numbers.decimal_words(whole.cast("string"), part), F.lit(" "), currency["main"]["many"])
    said = F.when(part == "", main).when(digits == 0, decimal).when(F.length(part) <= digits, F.concat(main, F.lit(" "), sub))
    return F.concat(_sign(value), said)


def cents_words(whole: Column, cents: Column, currency: Currency) -> Column:
    """An amount in whole units (a long) and hundredths (an int), both not negative, of one currency that has hundredths; no cents, none said."""
    main, sub = currency.main, currency.sub
    said = F.concat(F.lit(" "), numbers.below_thousand_words(cents, sub.gender), F.lit(" "), numbers.plural_of(cents, sub.one, sub.few, sub.many))
    return F.concat(numbers.counted(whole, main.one, main.few, main.many, main.gender, integral=True), F.when(cents > 0, said).when(cents == 0, F.lit("")))


def with_amounts(df: DataFrame, value: str, code: str, out: str) -> DataFrame:
    """df with column out, the amounts in value in words, each in the currency that its row's code names; unknown codes give null.

    The table of currencies has as many rows as the lexicon, so it is broadcast. A column of df named out is replaced.
    """
    table = F.broadcast(currencies(df.sparkSession).select(F.col("code").alias("__code"), F.struct("digits", "main", "sub").alias("__currency")))
    joined = df.join(table, df[code] == F.col("__code"), "left")
    return joined.withColumn(out, F.when(F.col("__code").isNotNull(), amount_words(F.col(value), F.col("__currency")))).drop("__code", "__currency")


def with_quantities(df: DataFrame, value: str, unit: str, out: str) -> DataFrame:
    """df with column out, the quantities in value in words, each in the unit that its row names; unknown units give null."""
    table = F.broadcast(units(df.sparkSession).select(F.col("key").alias("__key"), F.col("forms").alias("__forms")))
    joined = df.join(table, df[unit] == F.col("__key"), "left")
    return joined.withColumn(out, F.when(F.col("__key").isNotNull(), quantity_words(F.col(value), F.col("__forms")))).drop("__key", "__forms")


def percent_words(value: Column) -> Column:
    return quantity_words(value, unit_forms(PERCENT))


def temperature_words(value: Column, scale: str = "Цельсія") -> Column:
    """Degrees of a scale by its name in the genitive, as ``п'ять градусів Цельсія``."""
    if scale not in (name for name, *_ in WRITTEN if name):
        raise ValueError(f"no scale {scale!r}")
    return F.concat(quantity_words(value, unit_forms(DEGREE)), F.lit(f" {scale}"))


def _month(of: Column, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.month(of) - 1)


def year_words(of: Column) -> Column:
    return F.concat(numbers.ordinal_words(F.year(of), "gen", integral=True), F.lit(" року"))


def date_words(of: Column, style: str = "formal") -> Column:
    """A date: ``п'яте травня дві тисячі двадцятого року``; spoken style has the day in the genitive."""
    if style not in ("formal", "spoken"):
        raise ValueError(f"style is formal or spoken, not {style!r}")
    day = numbers.ordinal_words(F.dayofmonth(of), "gen" if style == "spoken" else "nom_n", integral=True)
    return F.concat(day, F.lit(" "), _month(of, dates.GENITIVE), F.lit(" "), year_words(of))


def month_words(of: Column) -> Column:
    """The month of a year: ``травень дві тисячі двадцятого року``."""
    return F.concat(_month(of, dates.NOMINATIVE), F.lit(" "), year_words(of))


def clock_words(of: Column, after_o: bool = False, seconds: bool = False) -> Column:
    """The time of a timestamp: hours, and minutes and, if asked, seconds that aren't zero; midnight by name.

    after_o: as it stands after the preposition о, the hour as an ordinal in the locative.
    """
    h, m, s = F.hour(of), F.minute(of), F.second(of) if seconds else F.lit(0)
    hour = F.concat(numbers.ordinal_words(h, "loc_f", integral=True), F.lit(" годині")) if after_o else _few(h, unit_forms(HOUR))
    said = F.concat_ws(" ", hour, F.when(m > 0, _few(m, unit_forms(MINUTE))), F.when(s > 0, _few(s, unit_forms(SECOND))))
    return F.when((h == 0) & (m == 0) & (s == 0), F.lit("опівночі")).when(of.isNotNull(), said)
