"""Stages of the pipeline on small tables with null ids, shared ids, repeated rows and texts without words."""

import random

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def said(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def near(seed, last="changed"):
    return " ".join([*said(seed)[:-1], last])


def text(seed):
    return " ".join(said(seed))


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, t, lang, None, len(t or "")) for i, t, lang in rows], SCHEMA).repartition(3)


def kept(df):
    return sorted(((r.doc_id, r.text, r.lang) for r in df.collect()), key=repr)


def test_near_duplicates(spark, frame):
    stay = [
        (1, text(1), "en"),  # least id of a group whose other rows have greater or null ids
        (None, text(2), "en"), (None, text(3), "de"),  # null ids, unlinked texts
        (None, text(4), "en"),  # a group of null ids only, two rows of one text
        (7, text(5), "en"), (7, text(6), "en"),  # unlinked texts that share an id
        (8, text(9), "en"),
        (9, text(10), None),  # a row twice, but for lang
        (10, None, "en"), (None, None, "en"), (11, "", "en"), (11, "", "en"),
    ]
    go = [(2, near(1), "en"), (None, near(1, "other"), "en"), (7, near(1, "third"), "en"), (None, text(4), "en"), (9, near(9), "en"), (9, text(10), "en")]
    out = pipeline.near_duplicates(spark, frame(stay + go), "")
    assert out.columns == frame(stay).columns and kept(out) == sorted(stay, key=repr)
    # an id whose other text heads a group lets no near copy through, and texts of one id are one group's if linked
    rows = [(3, text(1), "en"), (4, text(2), "en"), (4, near(1), "en"), (5, text(3), "en"), (5, near(3), "en")]
    got = kept(pipeline.near_duplicates(spark, frame(rows), ""))
    assert got[:2] == kept(frame(rows[:2])) and len(got) == 3 and got[2] in rows[3:]
    assert pipeline.near_duplicates(spark, frame([]), "").count() == 0


def test_decontaminated(spark, frame, tmp_path):
    spark.createDataFrame([(1, " ".join(said(1)[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stay = [(1, text(2), "en"), (None, text(3), "en"), (None, None, "en"), (2, text(4), "en"), (2, text(4), "en")]
    go = [(1, text(1), "en"), (None, text(1), "en"), (3, near(1), "en")]
    assert kept(pipeline.decontaminated(spark, frame(stay + go), str(tmp_path))) == sorted(stay, key=repr)
