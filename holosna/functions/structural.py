"""Structural passes over a text as Catalyst expressions: characters, typography, look-alikes, digit groups, symbols, headings.

All map null to null and an empty text to itself. Class escapes and word bounds are ASCII, written out where Java's differ.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from holosna.functions.letters import _map, replaced, trimmed
from holosna.options import STYLES

# --- fixed values: characters -----------------------------------------------------------------------------------------
CYRILLIC = "А-Яа-яЄєІіЇїҐґ"
LATIN = "A-Za-z"
QUOTES, OPENING = "«»„“”‟‹›\"", "«„‟‹“"
APOSTROPHES = "ʼ´‛‘"
SPACES = "\u00a0\u2009\u202f\u2060"
COMPOSED = {"и" "\u0306": "й", "И" "\u0306": "Й", "і" "\u0308": "ї", "І" "\u0308": "Ї"}
LOOK_LATIN = "aeiopcxyABCEHIKMOPTX"
LOOK_CYRILLIC = "аеіорсхуАВСЕНІКМОРТХ"
# --- fixed values: literals, in the order of their replacement --------------------------------------------------------
SYMBOLS = {
    "°C": "градусів Цельсія", "°С": "градусів Цельсія", "°F": "градусів Фаренгейта",
    "℃": "градусів Цельсія", "℉": "градусів Фаренгейта", "°Ra": "градусів Ранкіна",
    "°Ré": "градусів Реомюра", "°Re": "градусів Реомюра", "°De": "градусів Деліля",
    "°Rø": "градусів Ремера", "°Rō": "градусів Ремера", "°R": "градусів Ранкіна",
    "°K": "кельвінів", "°К": "кельвінів", "\u212a": "кельвінів", "±": "плюс мінус",
    "≈": "приблизно дорівнює", "≠": "не дорівнює", "≤": "менше або дорівнює",
    "≥": "більше або дорівнює", "×": "помножити на", "÷": "поділити на",
    "=": "дорівнює", "<": "менше", ">": "більше", "‰": "проміле",
    "§": "параграф", "₿": "біткоїн", "•": " ", "·": " ", "~": "тильда",
    "&": "і", "#": "решітка", "_": "нижнє підкреслення", "²": "у квадраті",
    "³": "у кубі", "№": "номер",
}
VARIABLES = {"ρh": " ро аш", "з α =": "з альфою, що дорівнює", "З α =": "З альфою, що дорівнює", "α =": "альфа ="}
# --- fixed values: patterns -------------------------------------------------------------------------------------------
BEFORE_PUNCTUATION = r"[ \t]+(\.(?=[0-9]|[.,;:!?]|\z)|[,;:!?])"
SLASHED_UNIT = r"(км|м|см³|см3|кбіт|Кбіт|мбіт|Мбіт|гбіт|Гбіт)[ \t]*/[ \t]*(?:(год|с[²2]?)|(c)([²2]?))(?![A-Za-z])"
SLASHED_LETTERS = r"([A-Za-z])[ \t]*/[ \t]*([A-Za-z])"
DIMENSION = r"([0-9])[ \t\n\r\x0B\x0C]+[хХ][ \t\n\r\x0B\x0C]+([0-9])"
BARE_DECIMAL = r"(^|[ \t\n\r\x0B\x0C(\[{=:;])([+\-]?)([.,])([0-9]+)(?![0-9.,])"
BETWEEN_SPACE_GROUPS = r"(?<=(?<![0-9A-Za-z_])[0-9]{1,3}) (?=[0-9]{3}(?![0-9A-Za-z_]))"
COMMA_GROUPS = r"(?<![0-9.,])[0-9]{1,3}(?:,[0-9]{3}){2,}(?![0-9])"
DOT_GROUPS = r"(?<![0-9.,])([0-9]{1,3})\.([0-9]{3})\.([0-9]{3})(?!\.?[0-9])"
HEADING = r"(?dm)^[ \t\r]*(={2,6})(?!=)[ \t]*([^ \t\n](?:[^\n]*[^ \t\n])?)[ \t]*(?<!=)\1[ \t\r]*$"
ENGLISH_WORD = r"(?<![0-9A-Za-z_])[A-Za-z](?:[A-Za-z'’-]*[A-Za-z])?(?![0-9A-Za-z_])"


def _literals(text: Column, table: Mapping[str, str], pad: str = "") -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pad + pair[1] + pad)), table.items(), text)


def unicode_forms(text: Column, quote_style: str = "keep") -> Column:
    """Apostrophes, minus signs, dashes and quotes in one form each, й and ї composed. The minus of a tight 10−n stays."""
    if quote_style not in STYLES["quote_style"]:
        raise ValueError(f"quote_style is one of {', '.join(STYLES['quote_style'])}, not {quote_style!r}")
    letter, word = f"[{CYRILLIC}{LATIN}]", f"[{CYRILLIC}{LATIN}0-9]"
    # what stands beside a mark is judged before marks are changed or letters composed
    if quote_style == "strip":
        text = F.translate(F.regexp_replace(text, f"(?<={word})[{QUOTES}](?={word})", " "), QUOTES, "")
    elif quote_style != "keep":
        text = F.translate(text, QUOTES, "".join('"' if quote_style == "straight" else "«" if c in OPENING else "»" for c in QUOTES))
    text = F.regexp_replace(text, f"(?<={word})[{APOSTROPHES}](?={word})|(?<={letter})′(?={letter})", "'")
    text = F.regexp_replace(text, "−(?!(?<=(?<![0-9])10−)[0-9])", "-")
    return _literals(F.translate(text, "－＋‐‑‒", "-+–––"), COMPOSED)


def typography(text: Column) -> Column:
    """Plain spaces, no emphasis marks or backticks, no blanks before punctuation, tight slashes, × between numbers."""
    text = F.translate(text, SPACES, " " * len(SPACES))
    text = F.regexp_replace(text, r"(?<!\*)\*\*(?!\*)", "")
    text = F.regexp_replace(text, r"(?<!_)__(?!_)", "")
    text = F.regexp_replace(F.translate(text, "’`", "'"), BEFORE_PUNCTUATION, "$1")
    tight = F.regexp_replace(text, SLASHED_UNIT, "$1/$2$3$4")
    # a Latin c after the slash stands for the Cyrillic letter
    tight = F.regexp_replace(tight, r"((?:км|м|см³|см3|[кКмМгГ]біт)/)c([²2]?)(?![A-Za-z])", "$1с$2")
    return F.regexp_replace(F.regexp_replace(tight, SLASHED_LETTERS, "$1/$2"), DIMENSION, "$1 × $2")


def homoglyphs(text: Column) -> Column:
    """Words of both scripts in that of their most letters (Cyrillic if even), if every other letter has a look-alike."""

    def repaired(word: Column) -> Column:
        latin, cyrillic = F.regexp_replace(word, f"[^{LATIN}]", ""), F.regexp_replace(word, f"[^{CYRILLIC}]", "")
        to_latin = F.length(latin) > F.length(cyrillic)
        alike = F.when(to_latin, cyrillic.rlike(f"^[{LOOK_CYRILLIC}]+$")).otherwise(latin.rlike(f"^[{LOOK_LATIN}]+$"))
        mixed = (F.length(latin) > 0) & (F.length(cyrillic) > 0)
        return F.when(~(mixed & alike), word).when(to_latin, F.translate(word, LOOK_CYRILLIC, LOOK_LATIN)).otherwise(F.translate(word, LOOK_LATIN, LOOK_CYRILLIC))

    return replaced(text, f"[{CYRILLIC}{LATIN}'’–-]+", repaired)


def number_groups(text: Column, thousand_separators: bool = True) -> Column:
    """A zero before a bare decimal point; digits that spaces, and if asked two or more commas or two dots, group are joined."""
    # a blank joins digit groups if a whole group stands on either side, whatever stands further off
    text = F.regexp_replace(F.regexp_replace(text, BARE_DECIMAL, "$1$20$3$4"), BETWEEN_SPACE_GROUPS, "")
    if thousand_separators:
        joined = replaced(text, COMMA_GROUPS, lambda x: F.translate(x, ",", ""))
        text = F.when(F.contains(text, F.lit(",")), joined).otherwise(text)
        text = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, DOT_GROUPS, "$1$2$3")).otherwise(text)
    return text


def symbols(text: Column) -> Column:
    """Mathematical and typographic signs by name."""
    return trimmed(_literals(text, SYMBOLS, " "))


def variables(text: Column) -> Column:
    """Greek variables that are read as words."""
    return _literals(text, VARIABLES)


def headings(text: Column) -> Column:
    """Lines ``== heading ==`` of two to six marks, the same at both ends, as the heading alone."""
    return F.regexp_replace(text, HEADING, "$2")


def output_spacing(text: Column) -> Column:
    """No blanks before punctuation."""
    return F.regexp_replace(text, r"[ \t]+([,.;:!?])", "$1")


def english_words(text: Column, vocabulary: Mapping[str, str]) -> Column:
    """Latin words that the vocabulary (lower-case word -> reading) knows, as their readings."""
    if not vocabulary:
        return text
    table = _map(dict(vocabulary))
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return replaced(text, ENGLISH_WORD, lambda x: F.coalesce(F.try_element_at(table, fold(x)), x))
