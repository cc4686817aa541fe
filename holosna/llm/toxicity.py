"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-case characters (code points), over the whole text. Each is scaled by the
log ratio of its smoothed share in toxic and in clean training texts; a logistic model is fitted on the scaled
features. Features seen in few training texts, or with a small ratio, have weight 0 and are never looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import by_batch, dropped, mix, small, stored, utf8

ORDERS, BITS, LEAST_TEXTS, LEAST_RATIO, RIDGE, ROUNDS = (5, 7), 20, 6, 0.7, 1e-4, 200
#: Learnt from at most about so many clean and toxic labelled documents, dealt by a hash of the id.
SAMPLE_PER_CLASS = (3500, 1500)


@dataclass
class Model:
    weights: np.ndarray  # by bucket, float32: the fitted weight times the log-count ratio
    bias: float


def gram_buckets(texts: list[bytes], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every character n-gram of every text (UTF-8), which a space is put before and behind."""
    low = [f" {t.decode('utf-8', 'replace').lower()} " for t in texts]
    raw = np.frombuffer(("".join(low) + " " * max(orders)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    raw[(raw >= 9) & (raw <= 13)] = 32
    length = np.fromiter(map(len, low), np.int64, len(low))
    end, doc = np.cumsum(length), np.repeat(np.arange(len(texts)), length)
    docs, out = [], []
    for k in orders:
        v = np.full(len(doc), k, np.uint64)
        for j in range(k):
            v = v * np.uint64(0xD6E8FEB86659FD93) + raw[j : j + len(doc)]
        own = np.arange(len(doc)) + k <= end[doc]
        docs.append(doc[own])
        out.append((mix(v[own]) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(out)


def distinct(doc: np.ndarray, bucket: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc << bits) + bucket)
    return key >> bits, key & ((1 << bits) - 1)


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> Model:
    """labels: doc_id and label (0 or 1; null: left out). A bounded sample of each class; of its features those that count go to the driver.

    Null ids are not learnt from; an id that labels name twice has its greater label; rows that share an id are learnt from each.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label")).where("label IN (0, 1) AND __id IS NOT NULL").groupBy("__id").agg(F.max("label").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -20.0 if not sizes.get(1) else 20.0)
    rate = F.when(F.col("label") == 1, min(1.0, per_class[1] / sizes[1])).otherwise(min(1.0, per_class[0] / sizes[0]))
    picked = stored(known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < rate * 1_000_003), "sample")
    rows = docs.select("doc_id", "text").join(small(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "label", utf8(F.col("text")).alias("text_utf8"))

    def features(texts: list[bytes], more: dict) -> dict:
        doc, bucket = distinct(*gram_buckets(texts))
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        return {"doc_id": more["doc_id"], "label": more["label"], "x": [bucket[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]}

    sample = stored(by_batch(rows, features, "doc_id long, label int, x binary"), "features")
    one, seen, texts = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), [0, 0]
    # one row of counts a task reaches the driver, and one at a time
    for r in sample.mapInArrow(tallied, "bucket binary, seen binary, one binary, n long, n_one long").toLocalIterator():
        at = np.frombuffer(bytes(r.bucket), "<u4")
        seen[at] += np.frombuffer(bytes(r.seen), "<u4")
        one[at] += np.frombuffer(bytes(r.one), "<u4")
        texts = [texts[0] + r.n - r.n_one, texts[1] + r.n_one]
    if not all(texts):
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    ratio = np.log((one + 1) / (texts[1] + 2)) - np.log((seen - one + 1) / (texts[0] + 2))
    use = (seen >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    number = np.where(use, np.cumsum(use) - 1, -1).astype(np.int32)

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            x = [number[np.frombuffer(r, "<u4")] for r in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r[r >= 0].tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    got = sorted(sample.mapInArrow(kept, "doc_id long, label int, x binary").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    out = np.zeros(1 << BITS, np.float32)
    out[use], bias = fitted([np.frombuffer(bytes(r[2]), "<i4") for r in got], np.array([r[1] for r in got], np.float64), ratio[use])
    dropped(sample, picked)
    prior = sizes[1] / (sizes[0] + sizes[1])
    return Model(out, float(bias + 0.5 * np.log(prior / (1 - prior))))


def tallied(batches):
    """In how many texts, and toxic ones, each feature is: one row a task."""
    import pyarrow as pa

    seen, one, n, n_one = np.zeros(1 << BITS, np.uint32), np.zeros(1 << BITS, np.uint32), 0, 0
    for batch in batches:
        for x, label in zip(batch.column("x").to_pylist(), batch.column("label").to_pylist(), strict=True):
            at = np.frombuffer(x, "<u4")  # a row's buckets are distinct
            seen[at] += 1
            one[at] += label
            n, n_one = n + 1, n_one + label
    if n:
        at = np.flatnonzero(seen).astype("<u4")
        yield pa.RecordBatch.from_pydict({"bucket": [at.tobytes()], "seen": [seen[at].tobytes()], "one": [one[at].tobytes()], "n": [n], "n_one": [n_one]})


def fitted(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on features (numbers by row) scaled by their log-count ratios: the weight times the ratio of each, and the bias."""
    row, col = np.repeat(np.arange(len(rows), dtype=np.int32), [len(k) for k in rows]), np.concatenate(rows)
    value = ratio[col]
    w, b = np.zeros(len(ratio)), 0.0
    g2, gb2 = np.full(len(ratio), 1e-8), 1e-8
    cost = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    for _ in range(ROUNDS):  # full-batch AdaGrad: convex, no draw of chance
        z = b + np.bincount(row, w[col] * value, len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost / len(y)
        g, gb = np.bincount(col, e[row] * value, len(ratio)) + RIDGE * w, e.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.1 * g / np.sqrt(g2)
        b -= 0.1 * gb / np.sqrt(gb2)
    return w * ratio, b


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    doc, bucket = gram_buckets(texts)
    keep = model.weights[bucket] != 0
    doc, bucket = distinct(doc[keep], bucket[keep])
    return 1 / (1 + np.exp(-np.clip(model.bias + np.bincount(doc, model.weights[bucket], len(texts)), -40, 40)))


def predict(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every row; null and empty texts get the score of no features.

    Repeated rows are scored alike, a null id stays null, texts are read whole, other columns are not read. Empty docs: no rows.
    """

    def look(texts: list[bytes], more: dict) -> dict:
        p = scores(texts, model)
        return {"doc_id": more["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text_utf8")), look, "doc_id long, score double, predicted int")
