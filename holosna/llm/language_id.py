"""Multilingual mixture inference for language identification.

A language is a smoothed multinomial over hashed byte trigrams of letters. Expectation-maximisation finds, for each
whole text, the proportions of the languages whose mixture makes its trigrams likeliest. Sets of the 1, 2, ... most
present languages are then compared by log-likelihood less a penalty for each language more; trigrams overlap, so a
third of them count as evidence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import CHUNK_BYTES, by_batch, utf8

BITS, SMOOTHING, ROUNDS, SET_ROUNDS, PENALTY = 13, 0.5, 10, 6, 2.0
#: Learnt from at most about so many documents of a language, dealt by a hash of the id.
SAMPLE_PER_LANGUAGE = 3000
#: Letters keep their bytes, ASCII ones in lower case; the rest is a space.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    p: np.ndarray  # languages x buckets, float32


def counted(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of the trigrams of each text; those of three spaces don't count."""
    raw = LETTERS[np.frombuffer(b"\n".join(texts) + b"\n  ", np.uint8)].astype(np.uint32)
    v = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    bucket = (v * np.uint32(2654435761)) >> np.uint32(32 - bits)
    length = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), length)
    keep = v != 0x202020
    tail = np.cumsum(length)
    keep[tail - 1] = False
    keep[np.maximum(tail - 2, 0)] &= length == 1  # a trigram ends in its own text
    at, n = np.unique((doc[keep] << bits) + bucket[keep], return_counts=True)
    return at >> bits, at & ((1 << bits) - 1), n.astype(np.float32)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, bits: int = BITS) -> Model:
    """From text and lang of the given rows; rows with null text or lang are left out. A bounded sample per language.

    The counts that reach the driver are languages x buckets numbers.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, 1 << bits), np.float32))
    langs = sorted(sizes)
    rate = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / sizes[lang]))]), F.col("lang"))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate * 1_000_003).select("lang", utf8(F.col("text")).alias("text_utf8"))

    def tally(texts: list[bytes], more: dict) -> dict:
        doc, bucket, n = counted(texts, bits)
        own = more["lang"].to_pylist()
        names = sorted(set(own))
        code = np.array([names.index(x) for x in own], np.int64)
        table = np.bincount((code[doc] << bits) + bucket, n, minlength=len(names) << bits).reshape(len(names), -1)
        return {"lang": names, "n": [x.astype("<f8").tobytes() for x in table]}

    total = np.zeros((len(langs), 1 << bits))
    for lang, n in by_batch(picked, tally, "lang string, n binary", per_step=1 << 23).toLocalIterator():
        total[langs.index(lang)] += np.frombuffer(bytes(n), "<f8")
    total += SMOOTHING
    return Model(langs, (total / total.sum(1, keepdims=True)).astype(np.float32))


def mixture(doc: np.ndarray, n: np.ndarray, p: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: pi is texts x languages, p languages x entries. Returns the proportions and the log-likelihoods."""
    size = np.maximum(np.bincount(doc, n, len(pi)), 1e-9)
    for _ in range(rounds):
        part = pi[doc].T * p
        ratio = n / np.maximum(part.sum(0), 1e-30)
        pi = np.stack([np.bincount(doc, row * ratio, len(pi)) for row in part], 1) / size[:, None]
    mixed = np.maximum((pi[doc].T * p).sum(0), 1e-30)
    return pi, np.bincount(doc, n * np.log(mixed), len(pi))


def inferred(texts: list[bytes], model: Model, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of all languages, and those of the chosen set (0 outside it)."""
    doc, bucket, n = counted(texts, bits)
    size, k = len(texts), len(model.langs)
    p = model.p[:, bucket]
    full, _ = mixture(doc, n, p, np.full((size, k), 1 / k), ROUNDS)
    rank = np.argsort(-full, 1, kind="stable")
    evidence = np.log(np.maximum(np.bincount(doc, n, size) / 3, 2))
    chosen, best, active = np.zeros((size, k)), np.full(size, -np.inf), np.ones(size, bool)
    for m in range(1, k + 1):
        pick = np.zeros((size, k))
        np.put_along_axis(pick, rank[:, :m], 1, 1)
        rows = active[doc]
        pi, ll = mixture(doc[rows], n[rows], p[:, rows], np.where(pick > 0, full + 1e-3, 0) / np.where(pick > 0, full + 1e-3, 0).sum(1, keepdims=True), SET_ROUNDS if m > 1 else 1)
        value = ll / 3 - PENALTY * (m - 1) * evidence
        active = active & (value > best)
        chosen[active], best[active] = (pi if m > 1 else pick)[active], value[active]
        if not active.any():
            break
    return full, chosen


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the language's proportion in the full mixture), langs (the chosen set, most present first).

    Null texts, and texts without a letter, are ``und`` with score 0; with no language learnt, all are. Repeated rows
    are predicted each; a null id stays null; ties go to the language that sorts first. Texts are read whole, however
    long. Other columns are not read. Empty docs: no rows.
    """

    def look(texts: list[bytes], more: dict) -> dict:
        letter = [bool(_LETTER.search(t.decode("utf-8", "replace"))) and any(c.isalpha() for c in t.decode("utf-8", "replace")) for t in texts]
        out = {"doc_id": more["doc_id"], "lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "langs": [[] for _ in texts]}
        if model.langs:
            full, chosen = inferred(texts, model)
            for i in np.flatnonzero(letter):
                order = [j for j in np.argsort(-chosen[i], kind="stable") if chosen[i, j] > 0]
                j = order[0] if order else int(full[i].argmax())
                out["lang_pred"][i], out["score"][i], out["langs"][i] = model.langs[j], float(min(1, max(0, full[i, j]))), [model.langs[x] for x in order]
        return out

    # a step's arrays have a row a language, so its bytes of text shrink as there are more
    step = CHUNK_BYTES * 4 // max(4, len(model.langs))
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text_utf8")), look, "doc_id long, lang_pred string, score double, langs array<string>", per_step=step)
