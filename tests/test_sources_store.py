"""Lexicon files with their errors, and readings kept from run to run."""

import pytest
from pyspark.sql import functions as F

from holosna.normal.pipeline import normalized
from holosna.operators import relations, store
from holosna.options import Options
from holosna.sources import lexicons

HEADER = "latin\tcyrillic\n"


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿" + HEADER.strip() + "\r\n\r\n# a comment\r\nGoogle\tгуголь\r\n", "utf-8")
    (tmp_path / "b.tsv").write_text("# first\n" + HEADER + "Acme\tакме", "utf-8")
    got = lexicons.vocabulary(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("acme", "акме"), ("google", "гуголь")]
    rows, errors = lexicons.checked(spark, str(tmp_path), ["latin", "cyrillic"], "latin")
    assert sorted((r.line, r.latin) for r in rows.collect()) == [(3, "acme"), (4, "google")] and errors.isEmpty()
    texts = spark.createDataFrame([(1, "Google і Acme")], "i long, text string")
    assert relations.with_readings(texts, "text", "out", got, "[A-Za-z]+", "i").first().out == "гуголь і акме"


@pytest.mark.parametrize(
    ("content", "line"),
    [
        ("Google\tгуголь\n", 1), (HEADER + "Google\tгуголь\textra\n", 2), (HEADER + "Гугл\tгуголь\n", 2), (HEADER + "Google\t\n", 2), (HEADER + "Google\t гуголь \n", 2), (HEADER + "Google\tгуголь\n\ngoogle\tгугл\n", 4),
        ("", 0), ("# only\n\n", 0), (HEADER + "one\n", 2),
    ],
)
def test_lexicon_errors(spark, tmp_path, content, line):
    (tmp_path / "v.tsv").write_text(content, "utf-8")
    with pytest.raises(lexicons.LexiconError) as error:
        lexicons.vocabulary(spark, str(tmp_path / "v.tsv"))
    assert error.value.line == line and error.value.path.endswith("v.tsv")


def test_no_lexicon_file(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        lexicons.vocabulary(spark, str(tmp_path / "none.tsv"))


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("5 кг", 1), ("5 кг", 2), (None, 3), ("", 4), ("слово", 5)], "text string, key long")
    kept = store.ReadingStore(spark, str(tmp_path), "tts_friendly")
    assert kept.unread(df, "text", "1").count() == 3
    kept.add(df, "text", "1")
    assert kept.unread(df, "text", "2").count() == 0
    more = df.unionByName(spark.createDataFrame([("7 %", 6)], "text string, key long"))
    assert [r.text for r in kept.unread(more, "text", "2").collect()] == ["7 %"]
    kept.add(more, "text", "2")
    kept.add(more, "text", "2")  # again, as after a failure
    kept.add(df, "text", "1")
    assert kept.readings().groupBy("batch").count().orderBy("batch").collect() == [("1", 3), ("2", 1)]
    speech = Options.preset("tts_friendly")
    assert sorted((r.key, r.out) for r in kept.read(more, "text", "out").collect()) == sorted((r.key, None if r.text is None else normalized(r.text, speech)) for r in more.collect())
    # other options have readings of their own
    assert store.ReadingStore(spark, str(tmp_path)).unread(df, "text", "1").count() == 3


def test_a_stream_that_is_restarted(spark, tmp_path):
    kept = store.ReadingStore(spark, f"{tmp_path}/store")
    run = lambda: kept.started(spark.readStream.schema("i long, text string").parquet(f"{tmp_path}/in"), "text", "out", f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    put = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put("5 кг", "слово", "5 кг")
    run()
    put("5 кг", "6 кг")
    run()
    run()
    assert {(r.batch, r.reading) for r in kept.readings().collect()} == {("0", "п'ять кілограмів"), ("0", "слово"), ("1", "шість кілограмів")}
    got = spark.read.parquet(f"{tmp_path}/out").select("text", "out").collect()
    assert sorted(map(tuple, got)) == sorted([("5 кг", "п'ять кілограмів")] * 3 + [("6 кг", "шість кілограмів"), ("слово", "слово")])
