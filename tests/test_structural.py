import json

import pytest
from pyspark.sql import functions as F

from holosna.functions import structural as S
from holosna.operators import segmentation
from holosna.options import Options
from holosna.sources import texts, vocabulary
from holosna.streaming import texts as streams


def each(spark, cases):
    """cases: (function, text, expected); all in one plan."""
    row = spark.range(1).select(*(f(F.lit(x)).alias(f"c{i}") for i, (f, x, _) in enumerate(cases))).first()
    assert list(row) == [e for _, _, e in cases]


def test_characters(spark):
    q = lambda s: lambda x: S.unicode_forms(x, s)
    each(spark, [
        (q("keep"), "знай Україна пʼять 5′ об′єкт «а»", "знай Україна п'ять 5′ об'єкт «а»"),
        (q("keep"), "знаи\u0306 Укрaі\u0308на", "знай Укрaїна"), (q("keep"), "10−3 110−3 −5 5－2 ＋7 а‑б", "10−3 110-3 -5 5-2 +7 а–б"),
        (q("straight"), "«а» „б“", '"а" "б"'), (q("guillemets"), "„б” ‹в›", "«б» «в»"), (q("strip"), "«а»б «в»", "а б в"),
        (q("strip"), None, None), (q("keep"), "", ""),
    ])
    with pytest.raises(ValueError):
        S.unicode_forms(F.lit(""), "none")


def test_typography(spark):
    each(spark, [
        (S.typography, "**так** ***ні*** __x__ `код` м’яч", "так ***ні*** x код м'яч"), (S.typography, "а , б . в .5 г .", "а, б . в.5 г."),
        (S.typography, "60 км / год, 5 м / c², A / B, 2 х 3", "60 км/год, 5 м/с², A/B, 2 × 3"), (S.typography, "м / cat", "м / cat"), (S.typography, "5 кг", "5 кг"),
        (S.output_spacing, "а , б .\tв !", "а, б.\tв!"),
    ])


def test_homoglyphs_groups_symbols_headings(spark):
    each(spark, [
        (S.homoglyphs, "cлово Kиїв wоrld шz тест-test", "слово Київ world шz тест-test"), (S.homoglyphs, "аb", "аb"), (S.homoglyphs, None, None),
        (S.number_groups, "1 234 567 і 12 34 та .5 (,7", "1234567 і 12 34 та 0.5 (0,7"), (S.number_groups, "1,234,567 1,234 1.234.567 1.2.3.4; 192.168.100.200", "1234567 1,234 1234567 1.2.3.4; 192.168.100.200"),
        (lambda x: S.number_groups(x, False), "1,234,567", "1,234,567"),
        (S.symbols, "5 °C ± 2 & №3", "5 градусів Цельсія плюс мінус 2 і номер 3"), (S.symbols, "x² 3\u212a K", "x у квадраті 3 кельвінів K"), (S.variables, "з α = 5", "з альфою, що дорівнює 5"),
        (S.headings, "== Назва ==\nтекст\n=== a ==\n ====б====\n====\n== =a= ==", "Назва\nтекст\n=== a ==\nб\n====\n=a="),
    ])


def test_vocabulary(spark, tmp_path):
    good = "\ufefflatin\tcyrillic\r\n# note\r\n\r\nGoogle\tгуголь\r\nAcme\tакме\n"
    (tmp_path / "v.tsv").write_text(good)
    found = vocabulary.load_vocabulary(spark, f"file://{tmp_path}/v.tsv")
    assert found == {"google": "гуголь", "acme": "акме"}
    each(spark, [(lambda x: S.english_words(x, found), "GOOGLE і Acme, Googles", "гуголь і акме, Googles"), (lambda x: S.english_words(x, {}), "a", "a")])
    head = "latin\tcyrillic\n"
    for bad in ("", "Google\tгуголь\n", head + "Google\tгуголь\textra\n", head + "Гугл\tгуголь\n", head + "Google\t\n", head + "Google\t гуголь \n", head + "Google\tгуголь\ngoogle\tгугл\n"):
        with pytest.raises(vocabulary.VocabularyError):
            vocabulary.parse_vocabulary(bad)


def test_options():
    assert Options.preset("default") == Options()
    assert Options.preset("tts_friendly").quote_style == "strip"
    assert not Options.preset("conservative").repair_homoglyphs
    assert Options.preset("search_indexing", quote_style="keep").symbol_style == "preserve"
    for wrong in (lambda: Options.preset("loud"), lambda: Options(quote_style="none")):
        with pytest.raises(ValueError):
            wrong()


def test_sources_and_stream(spark, tmp_path):
    rows = [(1, 'Один "два", три.\nЧотири.'), (2, None), (3, "м. Київ. Так.")]
    df = spark.createDataFrame(rows, "id long, text string")
    for kind in ("parquet", "orc", "json", "csv"):
        path = f"file://{tmp_path}/{kind}"
        texts.write(df, path, kind)
        assert sorted(map(tuple, texts.read(spark, path, kind, "id long, text string").collect())) == rows
    (tmp_path / "lines.txt").write_text("а\nб\n")
    assert [r.text for r in texts.read(spark, f"file://{tmp_path}/lines.txt", "text").collect()] == ["а", "б"]
    for wrong in (lambda: texts.read(spark, "x", "json"), lambda: texts.read(spark, "x", "xml"), lambda: texts.read(spark, "x", stream=True)):
        with pytest.raises(ValueError):
            wrong()
    step = lambda d: d.select("id", segmentation.sentences(S.typography(F.col("text"))).alias("s"))
    stream = texts.read(spark, f"file://{tmp_path}/parquet", schema="id long, text string", stream=True)
    streams.started(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", step, once=True).awaitTermination(60)
    got = {json.dumps(r.asDict(True)) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {json.dumps(r.asDict(True)) for r in step(df).collect()}


def test_windowed_counts(spark):
    at = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS kind UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'b'")
    assert sorted((r.window_start.hour, r.kind, r.n) for r in streams.counted(at, "ts", "kind").collect()) == [(0, "a", 2), (1, "b", 1)]
