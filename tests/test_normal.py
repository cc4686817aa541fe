"""Normalisation and uncertainty: expected readings and spans, awkward inputs, columns, SQL functions, streams."""

import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from holosna.normal import words as W
from holosna.normal.pipeline import normalized
from holosna.normal.uncertainty import Inside, uncertain_spans
from holosna.operators import normalization as N
from holosna.options import PRESETS, Options

DATA = Path(__file__).parent / "data"


def rows(name):
    return [json.loads(line) for line in (DATA / f"{name}.jsonl").read_text("utf-8").splitlines()]


def options(changed):
    changed = dict(changed)
    return Options.preset(changed.pop("preset", "default"), **changed)


@pytest.mark.parametrize("name", ["readings", "defaults", "options"])
def test_readings(name):
    wrong = [(text, want, got) for changed, text, want in rows(name) if (got := normalized(text, options(changed))) != want]
    assert not wrong


def test_speech_is_a_fixed_point():
    speech = Options.preset("tts_friendly")
    for changed, _, want in rows("readings"):
        if changed:
            assert normalized(want, speech) == want


def test_spans():
    for changed, text, part, kind, want in rows("spans"):
        spans = uncertain_spans(text, None if changed is None else options(changed))
        own = [s for s in spans if s.text == part]
        if kind == "reason":
            assert any(want in s.reason for s in own), (text, spans)
        elif kind == "meta":
            assert any(f"{s.category}/{s.severity}" == want for s in own), (text, want, spans)
        elif kind == "none":
            assert not any(s.severity == want for s in own), (text, spans)
        else:
            assert not any(s.category == want for s in spans), (text, spans)


AWKWARD = [
    "", " \t  \n ", "Номер 1234567890123456789012345678901234567890", "Версія 999999999999999999999999.999999999999999999999999.1", "Дата 99.99.9999 і 2026-99-99", "Контакти https:// test@ @ _",
    "FooКиїв BarЛьвів АAАA", "Ціна ₴ $ € £ № + - / : ;", "Сума 1,234567890123456789 грн і $999999999999999999999999.99", "ч. ст. п. розд. № -- 910//1234///24", "IIII ст. VX розд. XIX-INVALID",
    "«Тест» – — … ½ ⅞ 50/0", "П'ять зв’язків мʼясо ІМ`Я", "BTC/UAH ETH/USD 000000000000000000000001 BTC", "999999999999999999999999 кг 1,23456789 мг/мл -999999999999999999999999%",
    "999999999999999999999999–1000000000000000000000000 °C, -5,5–+7,25 кг, 10:30–12:45, 1/0–3/4", "[" * 500 + "](" * 500, "{\\displaystyle " * 200, " 5 кг", "🙂 5 кг 😀" * 300, "слово " * 5000,
]


def test_awkward_texts():
    for text in AWKWARD:
        for preset in PRESETS:
            assert normalized(text, Options.preset(preset)) or not text.strip()
        raw = text.encode()
        for s in uncertain_spans(text):
            assert raw[s.start : s.stop].decode() == s.text


def test_number_readers():
    assert W.structured("910/12-а") == "дев'ятсот десять слеш дванадцять дефіс а" and W.dotted("1.02.3") == "один крапка нуль два крапка три"
    assert W.signed("-2,5", "gen") == "мінус двох цілих і п'яти десятих" and W.signed("1.2.3") is None and W.phone("5551", "grouped") == "5551"
    assert W.decimal_or_digits("", "5") == "нуль кома п'ять" and W.finance_amount("1", W.HOUR) == "одна година" and W.segment("XIV2") == "чотирнадцятий два"


def test_columns(spark):
    """Null, empty, repeated and clashing columns."""
    texts = [(1, "5 кг", "a"), (2, None, "b"), (3, "", "c"), (4, "5 кг", "d"), (4, "5 кг", "d")]
    df = spark.createDataFrame(texts, "id long, text string, start string").repartition(3)
    read = {None: None, "": "", "5 кг": "п'ять кілограмів"}
    assert sorted((r.id, r.spoken) for r in df.select("id", N.normalized(F.col("text")).alias("spoken")).collect()) == sorted((i, read[t]) for i, t, _ in texts)
    once = N.normalized_once(df, "text", "spoken")
    assert once.columns == ["id", "text", "start", "spoken"] and sorted((r.id, r.spoken) for r in once.collect()) == sorted((i, read[t]) for i, t, _ in texts)
    spans = N.exploded_spans(df.withColumn("text", F.lit("Дата 99.99.9999")), "text")
    assert spans.columns == ["id", "start", "stop", "text", "reason", "category", "severity"] and spans.where("category = 'date'").count() == 5
    assert N.normalized_once(df.limit(0), "text", "spoken").count() == 0 and N.exploded_spans(df.limit(0), "text").count() == 0
    speech = N.normalized(F.lit("«5–7»"), "tts_friendly")
    assert spark.range(1).select(speech.alias("t")).first().t == "від п'яти до семи"


def test_sql_functions(spark):
    N.register(spark)
    got = spark.sql(
        "SELECT ua_normalize('5 кг') AS a, ua_normalize_preset('5–7 кг', 'tts_friendly') AS b, ua_number(21L) AS c, ua_ordinal(3L, 'gen') AS d, ua_case(5L, 'dat') AS e, "
        "ua_uncertain('25:61')[0].category AS f, size(ua_sentences('Так. Ні.')) AS g, ua_normalize(CAST(NULL AS STRING)) AS h, ua_transliterate('shop') AS i"
    ).first()
    assert tuple(got) == ("п'ять кілограмів", "від п'яти до семи кілограмів", "двадцять один", "третього", "п'яти", "time", 2, None, "шоп")
    assert [r.text for r in spark.sql("SELECT * FROM ua_uncertain_spans('Дата 99.99.9999')").collect()] == ["99.99.9999"]


def test_stream_reads_as_batch(spark, tmp_path):
    from holosna.streaming.texts import started

    df = spark.createDataFrame([(i, f"{i} кг") for i in range(20)], "id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    step = lambda d: d.withColumn("text", N.normalized(F.col("text")))
    started(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", step, once=True).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, step(df).collect()))


@pytest.mark.parametrize("preset", PRESETS)
def test_any_number_of_kept_spans(preset):
    speech = Options.preset(preset)
    n = 50_000
    got = normalized("<b>слово</b> текст. " * n, speech)
    assert got == ("<b>слово</b> текст. " * n).strip() and got.count("<b>") == n
    links = "[ім'я](http://a.b/c(d)) " * 20_000
    assert normalized(links, speech).count("(http://a.b/c(d))") == 20_000


def test_private_use_characters_are_text():
    for mark in ("\ue000", "\ue001", "\ue000\ue100\ue001", "\uf8ff", "\ue100\ue8ff"):
        text = f"<b>слово</b> {mark} <i>і {mark}</i>"
        for preset in PRESETS:
            assert normalized(text, Options.preset(preset)) == text


def test_containment_is_as_by_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, a + rng.randint(0, 9)) for a in (rng.randrange(40) for _ in range(rng.randint(0, 12)))]
        inside = Inside(spans)
        for a in range(45):
            for b in range(a, a + 12):
                assert inside.has(a, b) == any(x <= a and b <= y for x, y in spans)
                assert inside.has(a, b, proper=True) == any(x <= a and b <= y and (x, y) != (a, b) for x, y in spans)


def test_many_spans_take_linear_time():
    began = time.process_time()
    assert len(uncertain_spans("12/05/2024 10.0.0.1 25:61 слово7 " * 8_000)) > 8_000
    assert time.process_time() - began < 30


def test_checks_in_sql(spark):
    N.register(spark)
    row = spark.sql("""SELECT ua_digits('a1b20') AS d, ua_valid_roman('XIV') AS a, ua_valid_isbn('978-3-16-148410-0') AS b, ua_valid_issn('2049-3631') AS c, ua_valid_iban('DE89 3704 0044 0532 0130 00') AS e,
      ua_valid_luhn('4111 1111 1111 1111') AS f, ua_valid_vin('1M8GDM9AXKP042788') AS g, ua_valid_uuid('x') AS h, ua_valid_hash('MD5', 'ab') AS i, ua_valid_date(29, 2, 2000) AS j, ua_valid_date(30, 2, 2000) AS k,
      ua_valid_isbn(CAST(NULL AS STRING)) AS l, ua_valid_date(NULL, 1, 2) AS m""").first()
    assert tuple(row) == ("один два нуль", True, True, False, True, True, True, False, False, True, False, None, None)
