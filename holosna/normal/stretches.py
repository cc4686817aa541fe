"""Long texts of Latin words: those far from anything that the passes read are read by the few passes that can change them.

Matches of the passes reach a few words at most around a figure, a sign or a known word, unless brackets, tags, quoted code or
headings span them. So a text without Cyrillic letters and such marks is cut at blanks between plain words that lie further
off, and only what is near goes through all passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from holosna.functions import tables as T
from holosna.normal import letters, rx, shape
from holosna.normal.lexicon import LATIN_WORDS
from holosna.normal.rules import LETTERS
from holosna.options import Options

#: Plain words and characters of them that stay around what isn't plain; both hold.
WORDS, CHARACTERS = 16, 256
#: Cyrillic letters, and marks whose span may be of any length; private-use characters stand for kept spans.
_SPANS = re.compile(f"[{LETTERS}<`~\\[\\]{{}}|\\\\\ue000-\uf8ff]|==")
_WORD = re.compile(f"[\"«(]?([A-Za-z{''.join(T.DIACRITICS)}]+)[.,;!?)\"»]*")
_CAPITALS = re.compile("[A-Z]{2,}")


def plain_text(text: str, options: Options) -> str:
    """The reading of plain words."""
    text = shape.unicode_forms(text, options.quote_style)
    if options.normalize_english_words and rx.search("[A-Za-z]", text):
        text = letters.english(text, options.vocabulary)
    if options.transliterate_latin:
        text = letters.transliterated(text)
    return shape.output_spacing(shape.trimmed(text))


def by_stretches(text: str, options: Options, read: Callable[[str], str]) -> str | None:
    """The reading of text, whose pieces near to what isn't plain read gives; None if it can't be cut."""
    if len(text) < 4 * CHARACTERS or _SPANS.search(text):
        return None
    tokens = text.split(" ")

    def is_plain(token: str) -> bool:
        m = _WORD.fullmatch(token)
        return m is not None and not _CAPITALS.fullmatch(m[1]) and (low := m[1].lower()) not in LATIN_WORDS and low not in options.vocabulary

    # lines end inside tokens: each part counts
    plain = [all(map(is_plain, token.split("\n"))) if "\n" in token else is_plain(token) for token in tokens]
    spots = [i for i, p in enumerate(plain) if not p]
    ends, at = [], 0
    for i in spots:
        ends.append((at, i))
        at = i + 1
    ends.append((at, len(tokens)))
    cuts = []  # first and last token but one of the plain pieces
    for a, b in ends:
        low, high = a if a == 0 else _margin(tokens, a, b, 1), b if b == len(tokens) else _margin(tokens, b - 1, a - 1, -1) + 1
        if high - low >= WORDS:
            cuts.append((low, high))
    if not cuts:
        return None
    out, at = [], 0
    for low, high in cuts:
        if at < low:
            out.append(read(" ".join(tokens[at:low])))
        out.append(plain_text(" ".join(tokens[low:high]), options))
        at = high
    if at < len(tokens):
        out.append(read(" ".join(tokens[at:])))
    return " ".join(out)


def _margin(tokens: list[str], at: int, end: int, step: int) -> int:
    """The first token from at on before which enough words and characters lie; end if there is none."""
    words = size = 0
    while at != end and (words < WORDS or size < CHARACTERS):
        words, size, at = words + 1, size + len(tokens[at]) + 1, at + step
    return at
