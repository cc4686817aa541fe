"""Near-duplicates by odd sketches over MinHash samples.

A set of shingles has SAMPLES MinHash values. Runs of ROWS of them, hashed together, are its bands: sets meet in the
bands that they share, and of two sets of similarity j all of 32 bands of 5 differ with chance (1 - j**5)**32, which is
under 1e-8 at 0.85. The samples are also folded into a bitmap: each value, with its number, flips one bit, so a value
that two sets share flips the same bit in both and leaves no trace in their difference (Mitzenmacher, Pagh and Pham,
2014). The bits that differ thus count samples that differ, by parity, which tells similarities apart best where they
are high: ``limit`` is the count that a pair at the threshold exceeds with a chance of some 1e-9. Pairs under it are
compared with their whole sets. What meets in a band is compared, joined and cut into tiles as the n-gram join does it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holosna.llm import ngram_join
from holosna.llm.common import mix

ROWS, SAMPLES, SKETCH_BITS = 5, 160, 512
#: Standard deviations that a pair at the threshold is given.
SLACK = 6.0
#: Shingles that are hashed at once: samples times so many numbers stay in a core's cache.
AT_ONCE = 1024


def multipliers(samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Two odd 32-bit numbers for each sample."""
    h = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h | np.uint64(1)).astype(np.uint32), ((h >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def samples_of(own: list[np.ndarray], samples: int) -> np.ndarray:
    """MinHash values of sets (64-bit hashes), none of which is empty: a row a set."""
    a, b = (x[:, None] for x in multipliers(samples))
    out = np.empty((len(own), samples), np.uint32)
    for i, x in enumerate(own):
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        least = (low[:AT_ONCE] * a + high[:AT_ONCE] * b).min(axis=1)
        for s in range(AT_ONCE, len(x), AT_ONCE):
            np.minimum(least, (low[s : s + AT_ONCE] * a + high[s : s + AT_ONCE] * b).min(axis=1), out=least)
        out[i] = least
    return out


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of every run of so many values and of its number."""
    runs = values.reshape(len(values), -1, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, runs.shape[1] + 1, dtype=np.uint64)), runs.shape[:2]).copy()
    for j in range(rows):
        key = mix(key + runs[:, :, j])
    return key


def sketches(values: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of the values, as 64-bit words: each value flips the bit that its hash with its number names."""
    number = np.arange(values.shape[1], dtype=np.uint64) << np.uint64(32)
    at = (mix(values.astype(np.uint64) + number) % np.uint64(bits)).astype(np.int64) + np.arange(len(values))[:, None] * bits
    odd = np.bincount(at.ravel(), minlength=len(values) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(values), bits), axis=1).view("<i8")


def differing(flips: float, bits: int) -> float:
    """Bits of the difference that are set, as expected, after so many flips."""
    return bits / 2 * (1 - math.exp(-2 * flips / bits))


def estimate(differ: int, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """The similarity of two sets whose sketches differ in so many bits (half of the bits or more: no more than 0)."""
    return 0.0 if 2 * differ >= bits else max(0.0, 1 + bits / (4 * samples) * math.log(1 - 2 * differ / bits))


@dataclass(frozen=True)
class OddSketches(ngram_join.Bands):
    """Sets meet in MinHash bands, and odd sketches estimate what a pair's similarity is."""

    rows: int = ROWS
    samples: int = SAMPLES
    bits: int = SKETCH_BITS

    def features(self, own: list[np.ndarray]) -> dict[str, list]:
        values = samples_of(own, self.samples)
        sketch = list(sketches(values, self.bits))
        return {"keys": list(bands(values, self.rows).view(np.int64)), "narrow": sketch, "wide": sketch}

    def limit(self) -> int:
        """Bits in which sketches of a pair at the threshold differ at most, but for SLACK standard deviations.

        These are of the samples that differ, of which each flips two bits, and of where the flips fall.
        """
        apart = 1 - self.num / self.den
        flips = 2 * self.samples * apart
        of_samples = 2 * math.sqrt(self.samples * apart * (1 - apart)) * math.exp(-2 * flips / self.bits)
        of_places = math.sqrt(self.bits / 4 * (1 - math.exp(-4 * flips / self.bits)))
        return min(self.bits, math.ceil(differing(flips, self.bits) + SLACK * math.hypot(of_samples, of_places)))

    def may_link(self, na, nb, differ):
        return differ <= self.limit()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; component_id is the smallest doc_id that links reach.

    Texts whose sets of shingles have a Jaccard similarity of num / den or more are linked, each link confirmed on the
    whole sets; of a component the row of the smallest doc_id is kept. Texts without words have no links. Rows with equal
    sets link, repeated rows too (all rows of the smallest id are kept). A null doc_id links as any other, never names a
    component unless all of it are null, and is kept only then. Very long texts are sampled whole. Other columns of docs
    are not looked at. Empty docs: no rows.
    """
    found = ngram_join.linked(docs, width, OddSketches(num, den))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
