"""Importance resampling towards a target: texts weigh as much as their hashed n-grams are commoner in the target.

A text is scanned once, word by word. A ring keeps the running crc32 of each of the last n starts; a word extends each
by a space and itself, and begins a new one: every state is then the crc32 of an n-gram that ends here, without the
n-gram being put together. Its bucket is that crc32 modulo their number. Buckets of a text are stored, in two bytes each
where they fit; the corpus and the target are counted by bucket, the gains of all buckets are one short array, and the
stored buckets are summed up with it. The highest scores, with Gumbel noise from a hash of the id, are a draw without
replacement by weight; places are found over all rows by ranges of scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import bounded, by_batch, ranked, stored, utf8

#: Words of lower-cased UTF-8: runs of ASCII letters and digits and of what is beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10000, 2024, 20, 10


def scan(words: list[bytes], order: int) -> list[int]:
    """crc32 of all runs of 1 to ``order`` consecutive words, joined by one space: those that end at each word in turn, longest first."""
    crc, out, ring = zlib.crc32, [], []
    if order == 1:  # the ring has a place for the new start alone
        return list(map(crc, words))
    for word in words:
        more = b" " + word
        ring = [crc(more, state) for state in ring[max(0, len(ring) - order + 1) :]]
        ring.append(crc(word))
        out += ring
    return out


def kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(texts: DataFrame, order: int, buckets: int, *columns: str) -> DataFrame:
    """n_words and buckets (little-endian numbers, one a feature) of every row of texts (text_utf8 and the columns)."""

    def look(found: list[bytes], more: dict) -> dict:
        words = [WORD.findall(t.lower()) for t in found]
        made = [(np.array(scan(w, order), np.uint32) % np.uint32(buckets)).astype(kind(buckets)).tobytes() for w in words]
        return {c: more[c] for c in columns} | {"n_words": [len(w) for w in words], "buckets": made}

    given = "".join(f"{c} {t}, " for c, t in texts.dtypes if c in columns)
    return by_batch(texts, look, f"{given}n_words long, buckets binary")


def counts(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket and n of the features of all rows (buckets); a task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(own, kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": total[at]})

    return bounded(rows.select("buckets")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of every bucket in the target and the corpus: as many numbers as there are buckets."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for into, table in ((s, corpus), (t, target)):
        for bucket, n in table.collect():
            into[bucket] = n
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (all_s + buckets) / ((x + 1.0) * (all_t + buckets)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, and weight (the sum of the gains of its features) of every row."""
    form = kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, form) for b in batch.column("buckets").to_pylist()]
            made = [pa.array([len(x) for x in own], pa.int64()), pa.array([int(gain[x].sum()) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *made], names=["doc_id", "n_words", "n_features", "weight"])

    return bounded(rows).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of sha256 of "seed:id"; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1, 2, 3, … of those drawn; else null) of every row of docs.

    docs: doc_id, text; target: text. percent % of the rows with at least least_words words are drawn, rounded down:
    the highest scores, ties to the smaller doc_id, null ids first, then by features and weight; rows that are equal in
    all of these have places one after another. A null or empty text has no features and weight 0. Very long texts are
    scanned whole. Other columns are not looked at. An empty target leaves its shares to the smoothing; empty docs: no rows.
    """
    rows = stored(bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text_utf8")), order, buckets, "doc_id"), "buckets")
    wanted = bucketed(target.select(utf8(F.col("text")).alias("text_utf8")), order, buckets)
    own = weighed(rows, gains(counts(rows, buckets), counts(wanted, buckets), buckets))
    own = stored(own.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    may = F.col("n_words") >= least_words
    drawn = own.where(may).count() * percent // 100
    placed = ranked(own.withColumn("all", F.lit("")), ["all"], [(~may).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("weight").asc()])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("at") < drawn, F.col("at") + 1).alias("rank"))
