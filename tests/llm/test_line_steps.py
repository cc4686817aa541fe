"""Line deduplication: counts of lines by bytes, and steps of half a megabyte that give the sets of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from holosna.llm import line_dedup

TEXTS = [None, "", "\n", "a", "a\n", "\n\nb", "é\nü\n\nя", "\r\n \n"]


def test_lines_are_counted_as_split(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("text", line_dedup.line_count(F.col("text")).alias("n"))
    assert sorted((r.text or "", r.n) for r in rows.collect()) == sorted((t or "", 0 if t is None else len(t.split("\n"))) for t in TEXTS)


def test_sets_do_not_depend_on_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(f"w{i} x{j} y{j % 3} z" for j in range(20))) for i in range(30)], "doc_id long, text string").coalesce(1)
    head, _ = line_dedup.frequent_words(docs)
    found = []
    for size in (1 << 20, 600):
        monkeypatch.setattr(line_dedup, "SET_BYTES", size)
        found.append(sorted(map(repr, line_dedup.line_sets(docs, head, 4, 5).collect())))
    assert found[0] == found[1] and len(found[0]) == 600
