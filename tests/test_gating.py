"""Gated and ungated normalisation read every text alike; plain rows don't reach Python."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from holosna.normal.lexicon import ABBREVIATIONS, ACRONYMS, LATIN_WORDS
from holosna.operators import gating
from holosna.operators.normalization import exploded_spans, normalized
from holosna.options import Options

DATA = Path(__file__).parent / "data"


def texts():
    rng = random.Random(11)
    cases = [json.loads(x)[1] for x in (DATA / "readings.jsonl").read_text().splitlines()]
    parts = ["слово", "Київ", "the", "Étion", "I", "A", "USA", "II", "XIV", "sch", "tsh", "Übung", "ok.", "він.", "м'яч", "Ї", "ХХ", "ст.", "група", "квартал", "«так»", '"so"', "K", "Kиїв", "don't", "a.b", ".укр", "т.", "д.", "п", "(н.", "е.)", "в", "Х", "7", "/", "$", "-", "\t", "\n", " ", "  ", " ,", " .", "!", "?;", "ß", "ę", "ё", "’"]
    parts += [*ABBREVIATIONS, *list(ACRONYMS)[:15], *rng.sample(list(LATIN_WORDS), 10)]
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " ", "\n"]) for _ in range(rng.randint(1, 7))) for _ in range(2500)]
    plain = [p for p in parts if p.isalpha()] + [" ,", ".", "«так»", "\n"]
    made += [" ".join(rng.choice(plain) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    return [*cases, *made, "", None, " ", "слово " * 20_000, "word. " * 20_000]


@pytest.mark.parametrize("options", [None, "tts_friendly", "conservative"])
def test_gated_reads_alike(spark, options):
    df = spark.createDataFrame(list(enumerate(texts())), "i long, text string").repartition(4)
    gated = {r.i: r.spoken for r in gating.normalized_rows(df, "text", "spoken", options).collect()}
    whole = {r.i: r.spoken for r in df.select("i", normalized(F.col("text"), options).alias("spoken")).collect()}
    assert gated == whole
    n_plain = df.where(gating.plain(F.col("text"), options)).count()
    assert 300 < n_plain < len(whole) - 300


def python_rows(df):
    """Rows that the plan's Python nodes gave back, by the plan's metrics."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "EvalPython" in node.nodeName():
            found += node.metrics().apply("pythonNumRowsReceived").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName().endswith("QueryStage") or "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


def test_plain_rows_stay_in_the_jvm(spark):
    rows = [(i, "only words, and no more." if i % 10 else "7 кг") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, text string").repartition(4)
    assert python_rows(gating.normalized_rows(df, "text", "spoken")) == 50
    assert python_rows(df.withColumn("spoken", normalized(F.col("text")))) == 500


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "text string, spoken long")
    assert gating.normalized_rows(empty, "text", "spoken").count() == 0
    clash = spark.createDataFrame([("7", 1), ("so", 2), (None, 3)], "text string, spoken long")
    assert {(r.text, r.spoken) for r in gating.normalized_rows(clash, "text", "spoken").collect()} == {("7", "сім"), ("so", "со"), (None, None)}


def test_spans_alike(spark):
    rng = random.Random(3)
    parts = ["The", "USA", "LINUX", "linux", "don't", "'tis", "Étion", "vin", "VIN", "bic", "www.", "sh", "XIV", "I", "abcdef" * 6, "a.b", ".", ",", "!", "\n", "(so)", "«x»", "7", "слово", "м", "p.m.", "isbn rouge blanc", "x" * 40, "—", "@"]
    made = [" ".join(rng.choices(parts[:-8] if i % 2 else parts, k=rng.randint(1, 9))) for i in range(2500)]
    rows = list(enumerate([*made, "", None, "word. " * 20_000]))
    df = spark.createDataFrame(rows, "i long, text string").repartition(4)
    got = sorted(map(repr, gating.uncertain_rows(df, "text", "i").collect()))
    assert got == sorted(map(repr, exploded_spans(df, "text").collect()))
    assert 400 < df.where(gating.words_only(F.col("text"))).count() < 2200
    vocabulary = Options(vocabulary={"the": "зе"})
    got = sorted(map(repr, gating.uncertain_rows(df, "text", "i", options=vocabulary).collect()))
    assert got == sorted(map(repr, exploded_spans(df, "text", vocabulary).collect()))


def test_words_of_latin_texts_are_found_without_a_shuffle(spark):
    """Spans are those of the kernel, by bytes behind letters of two; the plan of plain Latin texts has no window."""
    from holosna.operators.gating import uncertain_rows
    from holosna.operators.normalization import exploded_spans

    texts = ["Some 'quoted' words don't stop", "café ñandú the ABC ABCDEFG O'", "''' a'b 'c", None, "", "Слово and word"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = uncertain_rows(df, "text", "id")
    assert sorted(map(str, got.collect())) == sorted(map(str, exploded_spans(df, "text").collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_amounts_read_alike(spark):
    """Amounts at the bounds of the plain ones are read as the kernel reads them, and plain ones, however many differ, don't reach Python."""
    from holosna.plans.reading import ua_read_money

    rng = random.Random(4)
    cents = [0, 1, 99, 100, 105, 1201, 3112, 80199, 80200, 80211, 80300, 99999, 100000, 100001, 111111, 202450, 1_000_000, 2_100_021, 10**8, 10**11 - 1, 10**11, 38067123456712]
    cents += [rng.randrange(10 ** rng.randint(2, 11)) for _ in range(300)]
    values = [*(f"{c // 100}.{c % 100:02d}" for c in cents), "-5.00", "-0.00", "null", "NaN", "Infinity", "", "1.5", "12.345", None]
    df = spark.createDataFrame(list(enumerate(values)), "k long, value string").repartition(3)
    value = F.col("value")
    texts = {
        "uah": F.concat(F.lit("Сума "), F.translate(value, ".", ","), F.lit(" грн")),
        "usd": F.concat(F.lit("Сума $"), value),
        "eur": F.concat(F.lit("Сума "), value, F.lit(" EUR")),
    }
    got = gating.amount_rows(df, "value", "Сума ", {k: (t, k.upper()) for k, t in texts.items()})
    want = df.select("k", "value", *(normalized(t).alias(k) for k, t in texts.items()))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    read = ua_read_money(spark, "/root/testdata/sf0.001")
    assert read.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert python_rows(read) == 0
