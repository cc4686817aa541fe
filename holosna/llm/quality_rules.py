"""Quality rules: base counts of whole texts, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Two multinomials over ``buckets`` hashed word n-grams (n from 1 to ``order``, 2 at most) are counted, one over the trusted target, one over the
raw corpus, each over all their documents. A document's score is the mean over its n-grams of
log p_target - log p_raw, shrunk for short texts by ``prior`` n-grams of evidence for neither; a document is kept if
the score reaches ``threshold`` and no base rule fails. No draw of chance is made: equal inputs give equal verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import stored

WINDOW = 8
MIN_WORDS = 20
BUCKETS = 1 << 15
ORDER = 2
PRIOR = 40
THRESHOLD = -0.1
SMOOTHING = 4.0
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, f) -> Column:
    """f(value) with value computed once a row, even where f names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order; null text: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE, -1), lambda w: w != "")


def covered(places: Column, width: int) -> Column:
    """How many words the windows of this width at these sorted places cover."""
    gaps = lambda p: F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(width)))
    return let(places, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps(p), F.lit(width), lambda s, x: s + x)))


def joined(h: Column, step: int) -> Column:
    """Hash of each entry with the one ``step`` places on; the last ``step`` entries have none."""
    return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.size(h) + 1), lambda a, b: F.xxhash64(a, b))


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def repeat_places(h: Column) -> Column:
    """Sorted places of the entries of h that it holds twice or more."""

    def marked(s: Column) -> Column:
        last = F.size(s) - 1
        pairs = F.zip_with(F.slice(s, 1, last), F.slice(s, 2, last), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)


def repeated_words(h2: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, from the hashes of its word pairs.

    Hashes are doubled: pairs, fours, eights, compared as 64 bits. A text whose fours are all different ends there.
    """
    distinct = lambda h: F.size(h) == F.size(F.array_distinct(h))
    eights = lambda h4: let(joined(h4, 4), lambda h8: F.when(distinct(h8), F.lit(0)).otherwise(covered(repeat_places(h8), WINDOW)))
    return let(joined(h2, 2), lambda h4: F.when((F.size(h4) < 5) | distinct(h4), F.lit(0)).otherwise(eights(h4)))


def bucket(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def mean_ratio(h: Column, weights: list[float], prior: float) -> Column:
    # the weights are a constant array of fixed size, folded once and indexed in place
    table, bits = F.split(F.lit(" ".join(f"{w:.6g}" for w in weights)), " ").cast("array<double>"), len(weights).bit_length() - 1
    return F.aggregate(h, F.lit(0.0), lambda s, x: s + F.get(table, bucket(x, bits))) / (F.size(h) + F.lit(float(prior)))


def with_counts(docs: DataFrame, weights: list[float] | None = None, prior: float = PRIOR, order: int = ORDER) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, and llr where weights are given."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    pairs = lambda h: let(joined(h, 1), lambda h2: F.struct(F.size(h).alias("n"), repeated_words(h2).alias("r"), (mean_ratio(h if order == 1 else F.concat(h, h2), weights, prior) if weights else F.lit(0.0)).alias("llr")))
    # the words are bound once: their code points, hashes, pairs and windows are all made from them
    bound = let(word_array(text), lambda w: F.struct(F.length(F.array_join(w, "")).alias("c"), let(F.transform(w, lambda x: F.xxhash64(x)), pairs).alias("h")))
    long = {"n_words": "__m.h.n", "word_chars": "__m.c", "n_repeat_words": "__m.h.r"}
    made = docs.withColumn("__m", bound)
    made = made.withColumns({k: F.col(v).cast("long") for k, v in long.items()} | {
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    } | ({"llr": F.col("__m.h.llr")} if weights else {}))
    return made.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).drop("__m")


def fitted(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, order: int = ORDER, smoothing: float = SMOOTHING) -> list[float]:
    """log p_target - log p_raw for each bucket (a power of two), from all of docs and all of the trusted among them.

    The target's count and the count that raw would make expect of it are both raised by ``smoothing``, so that a
    bucket seen a few times says little.

    trusted_ids: a column doc_id, nulls ignored. Without a trusted word every ratio is 0. The counts that reach the
    driver are ``buckets`` rows, summed in each task before they are shuffled. The trusted ids are broadcast only
    while their count is under a bound, and joined by shuffle beyond it.
    """
    ids = trusted_ids.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__trusted", F.lit(1))
    marked = docs.select("doc_id", "text").join(_sized(ids), F.col("doc_id") == F.col("__id"), "left")
    grams = marked.select(F.coalesce("__trusted", F.lit(0)).alias("t"), F.explode(word_hashes(F.col("text")) if order == 1 else let(word_hashes(F.col("text")), lambda h: F.concat(h, joined(h, 1)))).alias("g"))
    counts = (
        grams.groupBy(bucket(F.col("g"), buckets.bit_length() - 1).alias("b"))
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for b, r, t in counts:
        raw[b], target[b] = r, t
    if not sum(target):
        return [0.0] * buckets
    share = sum(target) / sum(raw)
    return [math.log((t + smoothing) / (r * share + smoothing)) for r, t in zip(raw, target, strict=True)]


def _sized(ids: DataFrame) -> DataFrame:
    from holosna.llm.common import small

    kept = stored(ids, "trusted")
    return small(kept)


def judged(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD, order: int = ORDER) -> DataFrame:
    """docs with the base counts, base_failed, llr and kept; every row of docs is in the result.

    Null and empty texts have no words, so base_failed. Repeated rows are judged alike. Columns of docs by the names
    of the results are replaced. Empty docs: no rows.
    """
    return with_counts(docs, fitted(docs, trusted_ids, buckets, order), prior, order).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
