"""What the passes are made of: patterns in which classes, bounds and case are of ASCII alone, and ways to apply them."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from typing import NamedTuple

import regex

from holosna.normal import lexicon as L
from holosna.options import Options

LETTERS = "А-Яа-яЄєІіЇїҐґ"
#: No letter of either script may follow.
NO_LETTER = f"(?![A-Za-z{LETTERS}])"
NO_CYRILLIC = f"(?![{LETTERS}])"
# --- fixed values: fragments of patterns ----------------------------------------------------------------------------------------
MONTH = (
    r"січня|січ\.|лютого|лют\.|березня|бер\.|квітня|квіт\.|травня|трав\.|червня|черв\.|липня|лип\.|серпня|серп\.|вересня|вер\.|жовтня|жовт\.|листопада|лист\.|грудня|груд\.|"
    r"Січня|Лютого|Березня|Квітня|Травня|Червня|Липня|Серпня|Вересня|Жовтня|Листопада|Грудня"
)
MULTIPLIER = r"(?:тис|млн|млрд|трлн)\.?"
SIGNED = r"(?:\+|-|−|–|—)?(?:\d+(?:[.,]\d+)?|[.,]\d+)"
RANGE = r"(?:-|−|‐|‑|‒|–|—|…)"
BEFORE_RANGE = r"(^|[\s(\[{:;,.!?=]|(?:[-–—]\s+))"
YEAR_WORD = rf"(?:\s+року{NO_CYRILLIC}|\s*р\.(?![а-яіїєґ]))?"
# --------------------------------------------------------------------------------------------------------------------------------

Match = regex.Match
Step = Callable[..., str]
DEFAULT = Options()


def any_of(keys) -> str:
    """The keys as alternatives, the longest first."""
    return "|".join(regex.escape(k, special_only=True) for k in sorted(keys, key=len, reverse=True))


UNIT = any_of(L.UNIT)
NOUN = any_of(L.COUNTED_NOUN)
CURRENCY = f"(?:{any_of(['грн', *(c.code for c in L.CURRENCIES), *(c.symbol for c in L.CURRENCIES if c.symbol)])})"
CODE = any_of(c.code for c in L.CURRENCIES)


def pattern(source: str, fold: bool = False) -> regex.Pattern:
    """\\\\d, \\\\w, \\\\s and \\\\b are of ASCII, and so is the case that fold takes away; $ is the very end."""
    return regex.compile(regex.sub(r"(?<!\\)\$", r"\\Z", source), regex.ASCII | (regex.IGNORECASE if fold else 0))


class Around(NamedTuple):
    """What a reading may need besides its match: the text since the match before, and the options."""

    before: str
    options: Options

    @property
    def from_to(self) -> bool:
        return self.options.range_style == "from_to"


def rule(source: str, fold: bool = False) -> Callable[[Callable[..., str | None]], Step]:
    """Makes a step of a reading of matches: every match is replaced, but stays where the reading gives None."""
    compiled = pattern(source, fold)

    def made(reading: Callable[..., str | None]) -> Step:
        alone = len(signature(reading).parameters) == 1

        def step(text: str, options: Options = DEFAULT) -> str:
            last = 0

            def read(m: Match) -> str:
                nonlocal last
                out = reading(m) if alone else reading(m, Around(text[last : m.start()], options))
                last = m.end()
                return m[0] if out is None else out

            return compiled.sub(read, text)

        return step

    return made


def passes(*steps: Callable[..., str]) -> Step:
    """The steps one after another."""
    bare = [len(signature(step).parameters) == 1 for step in steps]

    def run(text: str, options: Options = DEFAULT) -> str:
        for step, alone in zip(steps, bare, strict=True):
            text = step(text) if alone else step(text, options)
        return text

    return run


def has(text: str, *tokens: str) -> bool:
    return any(t in text for t in tokens)
