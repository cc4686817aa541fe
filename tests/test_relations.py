"""Spans, lexicons and tokens as relations, against loops and the kernels: nulls, empty and long texts, clashes."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from holosna.operators import relations, segmentation, token_rows

PARTS = [
    "слово", "м'яч", "Київ", "п’ять", "don't", "the", "10", "5", "7", "кг", "грн", "-", "–", "_", ".", ",", "/", "\\", "!", "?", "…", "=", ":", ";", "(", ")", "))", "*", "**", "--", "yahoo", "Yahoo", "@ім'я", "#тег", "№5",
    "№", "https://a.b/c.", "http://...", "a@b.ua.", "a@b.", "a@.", "x.y@z", "é", "ß", "ё", "α", " ", " ", "  ", "\n", "\t", '"', "«", "»", "'", "`", "ʼ", "a_b", "1.5", "1,000", "т.д.", "с.", "US$", "😀", "@", "#",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + ["", None, " ", "слово 5кг. " * 20_000]


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "i long, text string, place long").repartition(4)


def test_tokens_as_the_kernel(df):
    got = sorted(map(repr, token_rows.token_rows(df, "text", "i").collect()))
    rows = segmentation.exploded(df.select("i", "text"), segmentation.tokens(F.col("text"))).drop("text")
    assert got == sorted(map(repr, rows.collect())) and len(got) > 10_000


def test_matches(df, texts):
    got = {(r.i, r.place): (r.start, r.stop, r.match) for r in relations.exploded_matches(df, "text", "[0-9]+|[а-яі]+", "i").collect()}
    want = {}
    for i, t in enumerate(texts):
        for n, m in enumerate(re.finditer("[0-9]+|[а-яі]+", t or "")):
            start = len(t[: m.start()].encode()) if len(t) < 1000 else None
            want[i or None, n] = (start, m[0])
    assert got.keys() == want.keys()
    assert all(got[k][2] == m and (start is None or got[k][:2] == (start, start + len(m.encode()))) for k, (start, m) in want.items())


@pytest.mark.parametrize("proper", [False, True])
def test_spans_inside_others(spark, proper):
    rng = random.Random(9)
    span = lambda: (rng.choice([None, 1, 2, 3]), a := rng.randrange(60), a + rng.randint(0, 12))
    spans, larger = [span() for _ in range(400)] + [(1, None, 5), (2, 3, None)], [span() for _ in range(30)] + [(1, None, 99), (2, 0, None)]
    inside = lambda k, a, b: a is not None and b is not None and any(k == x and None not in (p, q) and p <= a and b <= q and not (proper and (p, q) == (a, b)) for x, p, q in larger)
    make = lambda rows: spark.createDataFrame(rows, "k long, start long, stop long").repartition(3)
    named = make(spans).select("k", "start", "stop", F.lit("x").alias("__tag"))
    got = relations.without_inside(named, make(larger), "k", proper=proper)
    assert got.columns == named.columns
    assert sorted(map(repr, (tuple(r)[:3] for r in got.collect()))) == sorted(map(repr, (s for s in spans if not inside(*s))))
    assert relations.without_inside(named, make(larger).limit(0), "k").count() == len(spans)
    assert relations.without_inside(named.limit(0), make(larger), "k").count() == 0


def test_lexicons_by_rank(spark):
    lexicon = lambda *rows: spark.createDataFrame(list(rows), "word string, reading string")
    got = relations.by_rank("word", lexicon(("a", "2"), ("a", "1"), (None, "x")), lexicon(("a", "9"), ("b", None)), lexicon(("b", "c"), ("c", "d")))
    assert sorted(map(tuple, got.collect())) == [("a", "1", 0), ("b", None, 1), ("c", "d", 2)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_vocabulary_as_a_table(spark, df, texts, monkeypatch, broadcast):
    monkeypatch.setattr(relations, "BROADCAST_ROWS", 100_000 if broadcast else 0)
    known = {"the": "зе", "yahoo": "яху", "us": "юес", "c": "сі"}
    vocabulary = spark.createDataFrame([*known.items(), ("the", "я"), (None, "x"), ("y", None)], "word string, reading string")
    twice = df.unionByName(df.limit(3))
    got = relations.with_readings(twice, "text", "place", vocabulary, "[A-Za-z]+", "i")
    assert got.columns == df.columns
    want = [(i or None, t and re.sub("[A-Za-z]+", lambda m: known.get(m[0].lower(), m[0]), t)) for i, t in enumerate(texts)]
    found = [(r.i, r.place) for r in got.collect()]
    assert set(map(repr, found)) == set(map(repr, want)) and len(found) == len(want) + 3


@pytest.mark.parametrize("broadcast", [True, False])
def test_long_text_of_known_words(spark, monkeypatch, broadcast):
    """A word costs one look-up, not one a known word of its text; with a small vocabulary nothing is shuffled."""
    monkeypatch.setattr(relations, "BROADCAST_ROWS", 100_000 if broadcast else 0)
    words = [chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(8000)]
    vocabulary = spark.createDataFrame([(w, w.upper() + "!") for w in words], "word string, reading string")
    texts = spark.createDataFrame([(1, " ".join(words * 20))], "i long, text string")
    began = time.time()
    got = relations.with_readings(texts, "text", "out", vocabulary, "[A-Za-z]+", "i")
    assert got.first().out == " ".join(w.upper() + "!" for w in words * 20)
    assert time.time() - began < 20
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) != broadcast
