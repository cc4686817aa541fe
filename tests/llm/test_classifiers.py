"""op9 against loops over characters, on texts of several scripts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holosna.llm import toxicity
from holosna.llm.common import mix


def bucket(gram):
    v = len(gram)
    for c in gram:
        v = (v * 0xD6E8FEB86659FD93 + ord(c)) % (1 << 64)
    return int(mix(np.array([v], np.uint64))[0]) >> (64 - toxicity.BITS)


def features(text):
    low = f" {text.lower()} "
    low = "".join(" " if c in "\t\n\v\f\r" else c for c in low)
    return {bucket(low[i : i + k]) for k in toxicity.ORDERS for i in range(len(low) - k + 1)}


TEXTS = ["", "a", "Дуже ДОВГЕ слово", "ÀÉÎ straße\tx\n", "日本語のテキスト", "😀😀 ok", "z" * 50]


def test_features_are_of_characters():
    doc, at = toxicity.distinct(*toxicity.gram_buckets([t.encode() for t in TEXTS]))
    assert [set(at[doc == i].tolist()) for i in range(len(TEXTS))] == [features(t) for t in TEXTS]
    # one letter of two bytes changes as many n-grams as one of one byte
    assert len(features("слово за словом") ^ features("слово зо словом")) == len(features("slovo za slovom") ^ features("slovo zo slovom"))


def test_scores_by_loops(spark):
    rng = random.Random(1)
    words = ["добре", "тихо", "море", "ліс", "сонце", "книга", "стіл"]
    texts = [" ".join([*rng.choices(words, k=6), *(["погань"] if i % 4 == 0 else [])]) for i in range(160)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "погань"), (900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = docs.where("doc_id < 120").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("label"))
    model = toxicity.train(docs, labels)
    own, toxic = [features(t) for t in texts[:120]], [i % 4 == 0 for i in range(120)]
    seen = {b: sum(b in x for x in own) for x in own for b in x}
    for b, n in seen.items():
        one = sum(b in x for x, y in zip(own, toxic, strict=True) if y)
        ratio = math.log((one + 1) / (sum(toxic) + 2)) - math.log((n - one + 1) / (120 - sum(toxic) + 2))
        assert n >= toxicity.LEAST_TEXTS and abs(ratio) >= toxicity.LEAST_RATIO or model.weights[b] == 0
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    for i, t in [*enumerate(texts), (900, ""), (901, ""), (None, "погань")]:
        want = 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[b]) for b in features(t)))))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == (want >= 0.5)
    assert all(got[i].predicted == (i % 4 == 0) for i in range(120, 160))
