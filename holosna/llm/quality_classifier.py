"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class is a Gaussian whose covariance is shrunk towards the pooled one and towards a multiple of the identity. The
lower Cholesky factors of the inverse problem are computed once; a score is the logistic of the difference of the
log-densities (Mahalanobis distances and log-determinants) and the log prior odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import SPACED, by_batch, small, stored, utf8, words

TO_POOLED, TO_IDENTITY = 0.1, 0.02
#: Learnt from at most about so many labelled documents of each class, dealt by a hash of the id.
SAMPLE_PER_CLASS = 20_000
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>@^~=+\\/{}[]_", "stop": b".,;:?", "shout": b"!", "line": b"\n"}
NAMES = ["log_words", "word_length", *_KINDS, "distinct", "adjacent", "dup_lines"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row per text: logs and square roots of counts and shares, all finite; a text without words has zeros.

    Shares are damped by a dozen words, so that one mark in a short text doesn't look like a habit.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    length = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    begin = np.cumsum(length) - length
    start, end, h, first = words(texts, SPACED)
    n = np.diff(first)
    some = np.maximum(n, 1)
    total = np.concatenate([[0], np.cumsum(end - start)])
    chars = np.maximum(total[first[1:]] - total[first[:-1]], 1)
    out = [np.log1p(n), np.log1p((chars + 25) / (some + 5))]
    for name, of in _KINDS.items():
        table = np.zeros(256, np.int64)
        table[list(of)] = 1
        count = np.add.reduceat(table[raw], begin) - (name == "line")
        out.append(np.sqrt(count / (chars + 60 if name != "line" else some + 12)))
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]))]) if len(h) else np.zeros(1, np.int64)
    inside = np.where(n > 1, same[first[1:]] - same[np.minimum(first[:-1] + 1, len(same) - 1)], 0)
    kinds = np.array([len(set(h[a:b].tolist())) for a, b in zip(first[:-1], first[1:], strict=True)])
    dup = np.array([1 - len(set(x)) / len(x) if (x := [y for y in t.split(b"\n") if y.strip()]) else 0 for t in texts])
    out += [np.log1p(kinds) / np.log1p(some), np.sqrt(inside / (some + 12)), np.sqrt(dup)]
    return np.where(n[:, None] > 0, np.stack(out, 1), 0)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]  # of the lower Cholesky factors of the shrunk covariances
    log_dets: list[float]
    prior: float  # log odds of class 1


def fitted(x: np.ndarray, y: np.ndarray, odds: float, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - centre) / scale
    means = [z[y == c].mean(0) for c in (0, 1)]
    own = [np.cov(z[y == c], rowvar=False, bias=True).reshape(z.shape[1], -1) for c in (0, 1)]
    share = [np.mean(y == c) for c in (0, 1)]
    pooled = share[0] * own[0] + share[1] * own[1]
    factors = []
    for c in own:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        factors.append(np.linalg.cholesky(c))
    # the factors' inverses are kept, so that no batch solves for them again
    return Model(centre, scale, means, [np.linalg.solve(f, np.eye(len(f))) for f in factors], [2 * np.log(np.diag(f)).sum() for f in factors], float(odds))


def scores(x: np.ndarray, m: Model) -> np.ndarray:
    z = (x - m.centre) / m.scale
    log_density = [-0.5 * ((((z - mu) @ f.T) ** 2).sum(1) + d) for f, mu, d in zip(m.inverses, m.means, m.log_dets, strict=True)]
    return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + m.prior, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | float:
    """labels: doc_id and label (0 or 1; null: left out). With fewer than two texts of a class: the share of label 1 as a constant."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label")).where("label IN (0, 1) AND __id IS NOT NULL").groupBy("__id").agg(F.max("label").alias("label"))
    sizes = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, min(1.0, per_class / max(1, sizes[1]))).otherwise(min(1.0, per_class / max(1, sizes[0])))
    picked = stored(known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < rate * 1_000_003), "sample")
    rows = docs.select("doc_id", "text").join(small(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "label", utf8(F.col("text")).alias("text_utf8"))

    def features(texts: list[bytes], more: dict) -> dict:
        return {"doc_id": more["doc_id"], "label": more["label"], "x": [r.astype("<f8").tobytes() for r in statistics(texts)]}

    got = sorted(by_batch(rows, features, "doc_id long, label int, x binary").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    y = np.array([r[1] for r in got], np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return float((sizes[1] + 1) / (sizes[0] + sizes[1] + 2))
    return fitted(np.array([np.frombuffer(bytes(r[2]), "<f8") for r in got]), y, np.log(sizes[1] / sizes[0]))


def predict(docs: DataFrame, model: Model | float, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row; null and empty texts are scored by their zeros.

    Repeated rows are scored alike, a null id stays null, texts are read whole, other columns are not read. Empty docs: no rows.
    """

    def look(texts: list[bytes], more: dict) -> dict:
        p = np.full(len(texts), model) if isinstance(model, float) else scores(statistics(texts), model)
        return {"doc_id": more["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text_utf8")), look, "doc_id long, score double, predicted int")
