import pytest
from pyspark.sql import functions as F

from holosna.functions import letters, numbers, validation
from holosna.operators import segmentation as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("n", "words"),
    [("0", "нуль"), ("1000", "тисяча"), ("21000", "двадцять одна тисяча"), ("2000000", "два мільйони"), ("111", "сто одинадцять"), ("1000000000000000000", "один " + " ".join(["нуль"] * 18)), (None, None)],
)
def test_number_words(spark, n, words):
    assert one(spark, numbers.number_words(F.lit(n))) == words


def test_genders_cases_ordinals(spark):
    assert one(spark, numbers.number_words(F.lit(32), "f")) == "тридцять дві"
    assert one(spark, numbers.number_words(F.lit(1), "n")) == "одне"
    assert one(spark, numbers.case_words(F.lit(245), "gen")) == "двохсот сорока п'яти"
    assert one(spark, numbers.ordinal_words(F.lit(2000))) == "двохтисячний"
    assert one(spark, numbers.ordinal_words(F.lit(23), "gen")) == "двадцять третього"
    assert one(spark, numbers.fraction_words(F.lit(3), F.lit(4))) == "три четвертих"
    assert one(spark, numbers.decimal_words(F.lit("1"), F.lit("5"))) == "одна ціла і п'ять десятих"
    assert one(spark, numbers.decimal_words(F.lit("1"), F.lit("1234567"))).startswith("один кома один два")


def test_letters(spark):
    assert one(spark, letters.transliterated(F.lit("shash Über"))) == "шаш юбер"
    assert one(spark, letters.spelled_acronyms(F.lit("СБР і НАТО"))) == "ес бе ер і НАТО"
    assert one(spark, letters.trimmed(F.lit("  a   b\t "))) == "a b\t"


def test_spelled_letters_query(spark, tmp_path):
    """Whole columns of varied letters, by the query and by its SQL."""
    import duckdb

    import __spark_entry__ as e

    names = [(1, "Quick zinc Box 7"), (2, "jovial WAX"), (3, "Їжак"), (4, None)]
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in e.queries()["ua_spelled_letters"](spark, str(tmp_path)).collect())
    assert got[1] == (2, "джей оу ві ай ей ел дабл ю ей екс") and got[2] == (3, "ї же а ка") and got[3] == (4, None)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        assert sorted(db.sql(e.oracle_sql()["ua_spelled_letters"]).fetchall()) == got


def test_validation(spark):
    good = [validation.valid_isbn(F.lit("978-3-16-148410-0")), validation.valid_issn(F.lit("2049-3630")), validation.valid_iban(F.lit("DE89 3704 0044 0532 0130 00")), validation.valid_luhn(F.lit("4111 1111 1111 1111"))]
    good += [validation.valid_vin(F.lit("1M8GDM9AXKP042788")), validation.valid_roman(F.lit("MCMXC")), validation.valid_date(F.lit(29), F.lit(2), F.lit(2000)), validation.valid_iso_week(F.lit(2020), F.lit(53))]
    bad = [validation.valid_isbn(F.lit("978-3-16-148410-1")), validation.valid_iban(F.lit("DE89 3704 0044 0532 0130 0")), validation.valid_luhn(F.lit("4111x")), validation.valid_date(F.lit(29), F.lit(2), F.lit(1900)), validation.valid_iso_week(F.lit(2021), F.lit(53))]
    assert all(one(spark, x) for x in good)
    assert not any(one(spark, x) for x in bad)
    assert one(spark, validation.roman_value(F.lit("MCMXC"))) == 1990


@pytest.mark.parametrize(
    ("text", "pieces"),
    [("Він живе на вул. Шевченка. Там тихо.", ["Він живе на вул. Шевченка.", "Там тихо."]), ("І т. д. і т. п.", ["І т. д. і т. п."]), ("", []), (" \n", []), ("Так!\nНі", ["Так!", "Ні"])],
)
def test_sentences(text, pieces):
    found = S.split_sentences(text)
    assert [x["text"] for x in found] == pieces
    raw = text.encode()
    assert all(raw[x["start"] : x["stop"]].decode() == x["text"] for x in found)


@pytest.mark.parametrize(
    ("text", "pieces"),
    [("П'ять зв’язків.", ["П'ять", "зв’язків", "."]), ("12,5 грн (50/64 см)", ["12,5", "грн", "(", "50/64", "см", ")"]), ("5кг :) test.user@example.com", ["5кг", ":)", "test.user@example.com"])],
)
def test_tokens(text, pieces):
    assert [x["text"] for x in S.tokenize(text)] == pieces


def test_segmentation_udf_and_nulls(spark):
    df = spark.createDataFrame([(1, "Раз. Два."), (2, None), (3, "")], "id int, text string")
    rows = {r[0]: r[1] for r in df.select("id", S.sentences(F.col("text"))).collect()}
    assert [x.text for x in rows[1]] == ["Раз.", "Два."] and rows[2] is None and rows[3] == []
    assert S.exploded(df, S.tokens(F.col("text"))).count() == 4


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_numerals_that_do_not_fit(spark):
    df = spark.createDataFrame([("1234567890123456789012345",), ("x1",), ("-5",), ("",), (None,), ("21",)], "n string")
    got = [r[0] for r in df.select(numbers.number_words(F.col("n"), "f")).collect()]
    assert got[0] == " ".join(["нуль один два три чотири п'ять шість сім вісім дев'ять".split()[int(c)] for c in "1234567890123456789012345"])
    assert got[1:] == [None, None, None, None, "двадцять одна"]
    decimals = spark.createDataFrame([("", "5"), ("2", "5"), ("123456789012345678901", "5"), (None, "5"), ("1", "1234567")], "w string, f string")
    said = [r[0] for r in decimals.select(numbers.decimal_words(F.col("w"), F.col("f"))).collect()]
    assert said[:2] == ["нуль кома п'ять", "дві цілих і п'ять десятих"] and said[2].endswith("один кома п'ять") and said[3] is None
    assert said[4] == "один кома один два три чотири п'ять шість сім"


def test_sentence_rows_by_steps(spark):
    """Rows by steps of bounded bytes are those of the column of spans; null and empty texts, nulls and shared keys as well."""
    from pyspark.sql import functions as F

    from holosna.operators import segmentation

    texts = ["Перше речення. Друге речення!", None, "", "Ціна 5 грн. за кг. Так?", " ", "Одне. " * 50]
    df = spark.createDataFrame([(i % 4 or None, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    got = segmentation.exploded_rows(df, "text", segmentation.split_sentences)
    want = segmentation.exploded(df, segmentation.sentences(F.col("text"))).drop("text")
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
