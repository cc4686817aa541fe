"""Long texts of plain words with a few things to read: cut, they are read as whole ones."""

from __future__ import annotations

import random

import pytest

from holosna.functions import tables as T
from holosna.normal import letters, pipeline, stretches
from holosna.options import Options

PLAIN = "the water was und nicht heit élan ñame straße Over again, then. schon (quiet) tsch yeee ooo".split(" ")
READ = ("5 kg", "34@mail7.example.com", "$25.50", "192.168.0.1", "25:61", "XIV", "a.b", "12/07/2024", "#tag & more", 'token = "04db 11"', "K 300", "computer", "+380 44 123 45 67")


def _text(seed: int) -> str:
    rnd = random.Random(seed)
    parts = []
    for _ in range(rnd.randint(1, 4)):
        parts += [" ".join(rnd.choices(PLAIN, k=rnd.choice((0, 3, 40, 120)))), rnd.choice(READ)]
    return rnd.choice((" ", "\n", "  ")).join([*parts, " ".join(rnd.choices(PLAIN, k=90))])


@pytest.mark.parametrize("preset", ["default", "tts_friendly"])
def test_cut_texts_read_as_whole_ones(preset):
    options = Options() if preset == "default" else Options.preset(preset)
    cut = 0
    for seed in range(120):
        text = _text(seed)
        whole = pipeline._read(text, options, False)
        assert pipeline.normalized(text, options) == whole
        cut += stretches.by_stretches(text, options, lambda piece: pipeline._read(piece, options, any(c.isdigit() for c in text))) == whole
    assert cut > 60


def test_passes_see_only_what_is_near():
    text, seen = " ".join(PLAIN * 200) + " 5 kg " + " ".join(PLAIN * 200), []
    stretches.by_stretches(text, Options(), lambda piece: seen.append(len(piece)) or piece)
    assert 0 < sum(seen) < len(text) / 10


def test_marks_that_span_and_cyrillic_letters_are_not_cut():
    for mark in ("<b>", "`x`", "[a]", "слово", "== a =="):
        assert stretches.by_stretches(" ".join(PLAIN * 200) + f" {mark} 5 kg", Options(), str) is None


def test_sequences_in_turn():
    """Of overlapping sequences that which begins first, then the longer one, as one search would find them."""
    import itertools
    import re

    found = re.compile("|".join(sorted(T.LATIN, key=len, reverse=True)))
    for x in map("".join, itertools.product("tsckzhyeou", repeat=5)):
        assert letters.transliterated(x) == found.sub(lambda m: T.LATIN[m[0]], x)
