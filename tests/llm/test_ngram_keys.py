"""Meetings of the n-gram join: sets without a common shingle stay apart, linked ones meet."""

import numpy as np
import pytest

from holosna.llm.ngram_join import keys, spare


@pytest.mark.parametrize(("num", "den"), [(4, 5), (85, 100)])
def test_only_sets_with_something_in_common_meet(num, den):
    """Else meetings would grow with the documents, and the pairs that tiles compare with their square."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)) for n in rng.integers(60, 1400, 1500)]
    met = np.unique(np.concatenate([np.unique(keys(x, num, den)) for x in sets]), return_counts=True)[1]
    assert met.max() <= 6


@pytest.mark.parametrize(("num", "den"), [(4, 5), (85, 100), (2, 3)])
def test_sets_at_the_bound_meet(num, den):
    rng = np.random.default_rng(4)
    for n in [*range(2, 60), *rng.integers(60, 3000, 150).tolist()]:
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        for gone in {(den - num) * n // den, (den - num) * n // (den + num)}:  # a part of the set, and one with as many others
            y = rng.permutation(x)[gone:]
            if gone * (den + num) <= (den - num) * n:
                y = np.concatenate([y, rng.integers(0, 1 << 64, gone, np.uint64, endpoint=False)])
            if gone:
                assert len(np.intersect1d(keys(x, num, den), keys(np.sort(y), num, den))), (n, gone)


def test_spare_parts_are_bounded():
    assert spare(0, 3) == 0 and spare(500, 400) == 2 and spare(1, 4) == 1
    assert all(spare(k, 5 * k // 2) <= k + 8 for k in range(1, 3000, 7))
