"""Readers of typed columns against the kernel's readings of rendered texts, and of nulls, signs and unknown units."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from holosna.functions import numbers, structural, typed
from holosna.functions import tables as T
from holosna.normal import words as W
from holosna.normal.lexicon import CURRENCY, UNIT
from holosna.normal.money import amount_words


def test_amounts_as_the_kernel(spark):
    values = [Decimal(x) for x in ("0", "1", "2.00", "5.01", "21.5", "1000000.99", "111.12", "0.05", "-3.40", "12.3456", "999999999.10")]
    codes = ["UAH", "USD", "EUR", "JPY", "GBP", "PLN", "XXX", None]
    df = spark.createDataFrame([(v, c, 1) for v in [*values, None] for c in codes], "v decimal(18,4), c string, out int")
    for r in typed.with_amounts(df, "v", "c", "out").collect():
        if r.v is None or r.c not in CURRENCY:
            assert r.out is None
            continue
        plain = format(abs(r.v), "f").rstrip("0").rstrip(".")
        want = amount_words(plain.replace(".", ","), CURRENCY[r.c])
        assert r.out == (want and ("мінус " if r.v < 0 else "") + want), (r.v, r.c)


def test_quantities_as_the_kernel(spark):
    values = [Decimal(x) for x in ("0", "1", "2", "5.5", "0.25", "101", "-7", "1234.125")]
    df = spark.createDataFrame([(v, u) for v in values for u in ("кг", "см", "год", "?")], "v decimal(12,3), u string")
    for r in typed.with_quantities(df, "v", "u", "said").collect():
        assert r.said == (W.quantity(format(r.v, "f").rstrip("0").rstrip("."), UNIT[r.u]) if r.u in UNIT else None), (r.v, r.u)


def test_dates_and_times(spark):
    at = [datetime.datetime(2024, 5, 1, 0, 0, 0), datetime.datetime(1999, 12, 31, 13, 5, 9), None]
    df = spark.createDataFrame([(x,) for x in at], "at timestamp")
    t = F.col("at")
    got = df.select(typed.date_words(t).alias("a"), typed.date_words(t, "spoken").alias("b"), typed.month_words(t).alias("c"), typed.clock_words(t).alias("d"), typed.clock_words(t, True, True).alias("e")).collect()
    assert tuple(got[0]) == ("перше травня дві тисячі двадцять четвертого року", "першого травня дві тисячі двадцять четвертого року", "травень дві тисячі двадцять четвертого року", "опівночі", "опівночі")
    assert tuple(got[1])[3:] == ("тринадцять годин п'ять хвилин", "тринадцятій годині п'ять хвилин дев'ять секунд") and tuple(got[2]) == (None,) * 5
    with pytest.raises(ValueError):
        typed.date_words(t, "long")


def test_shares_and_degrees(spark):
    df = spark.createDataFrame([(Decimal("2.0"),), (Decimal("-1.5"),), (None,)], "v decimal(6,1)")
    got = [tuple(r) for r in df.select(typed.percent_words(F.col("v")), typed.temperature_words(F.col("v"))).collect()]
    assert got == [("два відсотки", "два градуси Цельсія"), ("мінус одна ціла і п'ять десятих відсотка", "мінус одна ціла і п'ять десятих градуса Цельсія"), (None, None)]


def test_numbers_by_either_path(spark):
    values = [0, 1, 2, 11, 21, 100, 999, 1000, 1001, 2000, 21000, 1_000_000, 2_000_001, 10**12 + 5, 10**18 - 1, 10**18, 2**63 - 1, -1, None]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    n, text = F.col("n"), F.col("n").cast("string")
    for g in "mfn":
        assert df.where(~numbers.number_words(n, g, integral=True).eqNullSafe(numbers.number_words(text, g))).isEmpty()
    for form in ("nom_m", "gen", "loc_f"):
        assert df.where(~numbers.ordinal_words(n, form, integral=True).eqNullSafe(numbers.ordinal_words(text, form))).isEmpty()
    for r in df.select("n", numbers.number_words(n, "f", integral=True).alias("f"), numbers.ordinal_words(n, "gen", integral=True).alias("g"), *(numbers.case_words(n, c, integral=True).alias(c) for c in T.CASES)).collect():
        if r.n is None or r.n < 0:
            assert tuple(r)[1:] == (None,) * 6
        else:
            assert r.f == W.cardinal(r.n, "f") and r.g == W.ordinal(r.n, "gen") and [r[c] for c in T.CASES] == [W.cased(r.n, c) for c in T.CASES], r.n


def test_digit_groups(spark):
    cases = {
        "1 234 567 і 12 345 6789 та 12345 678 901": "1234567 і 12345 6789 та 12345 678901", "a1 234 1 23 456": "a1 234 1 23456", "1,234,567 1,234 1,234,5678": "1234567 1,234 1,234,5678",
        "1.234.567 1.234.567.890 1.234": "1234567 1.234.567.890 1.234", ".5 і ,25": "0.5 і 0,25", "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [tuple(r) for r in df.select("t", structural.number_groups(F.col("t")).alias("got")).collect()] == list(cases.items())


def test_each_value_is_read_once(spark):
    """Equal to reading every row; of equal values, wherever they lie, one reaches the kernel."""
    from holosna.operators.normalization import normalized, normalized_by

    rows = spark.createDataFrame([(i, v) for i, v in enumerate([5, 7, None, 5, 5, None, 21] * 3)], "k long, n long").repartition(5)
    text = lambda c: F.concat(F.lit("Є "), F.col(c).cast("string"), F.lit(" книг"))
    got = normalized_by(rows, F.col("n"), {"said": text("value")})
    assert got.columns == ["k", "n", "said"]
    want = rows.withColumn("said", normalized(text("n")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    from holosna.plans.reading import ua_read_money

    plan = ua_read_money(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan[plan.index("ArrowEvalPython") :]


def test_check_digits_are_read_from_whole_numbers(spark):
    """Sums by division agree with those by character, at the bounds of a long too; the plan takes no text apart digit by digit."""
    from holosna.functions import validation
    from holosna.normal import checks

    texts = ["", "+23456789012", "-12345678901", "080442957X", "9780306406157", "0317-8471", "4111 1111-1111 1111", "9999999999999999999", "1234567890123456789", "99999999999999999999", "XXXXXXXXXX", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *(getattr(validation, f"valid_{k}")(F.col("t")).alias(k) for k in ("luhn", "isbn", "issn")))
    for r in got.collect():
        for k in ("luhn", "isbn", "issn"):
            assert r[k] == (None if r.t is None else getattr(checks, f"valid_{k}")(r.t)), (r.t, k)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ascii") <= 6
