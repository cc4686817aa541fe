"""Scripts and letters: Catalyst expressions that cut a text into marked pieces, map each, and join them again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holosna.functions import tables as T

UPPER = "А-ЯҐЄІЇ"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def replaced(text: Column, pattern: str, f) -> Column:
    """Every match of the pattern through f, the text between as it is."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), f)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def transliterated(text: Column) -> Column:
    """Latin letters as Cyrillic ones, the longest sequences first, in lower case."""
    singles = {k: v for k, v in T.LATIN.items() if len(k) == 1} | T.DIACRITICS
    # the case is folded for ASCII alone
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for sequence in T.LATIN_SEQUENCES:
        out = F.replace(out, F.lit(sequence), F.lit(T.LATIN[sequence]))
    plain = {c: v for c, v in singles.items() if len(v) == 1}
    for c, v in singles.items():
        out = out if c in plain else F.replace(out, F.lit(c), F.lit(v))
    return F.translate(out, "".join(plain), "".join(plain.values()))


def spelled_acronyms(text: Column) -> Column:
    """Runs of two or more upper-case Cyrillic letters without a vowel, letter by letter."""
    names = _map(T.LETTER_NAMES)
    spell = lambda run: F.array_join(F.filter(F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.try_element_at(names, c)), lambda x: x.isNotNull()), " ")
    return replaced(text, f"[{UPPER}]+", lambda run: F.when((F.length(run) < 2) | run.rlike("[АЕЄИІЇОУЮЯ]"), run).otherwise(spell(run)))


def spelled_letters(text: Column) -> Column:
    """Latin and Cyrillic letters by name; other characters are left out."""
    names = _map(T.LETTER_NAMES | T.LATIN_LETTER_NAMES)
    return F.array_join(F.filter(F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.try_element_at(names, c)), lambda x: x.isNotNull()), " ")


def trimmed(text: Column) -> Column:
    """Runs of spaces as one, and none at the ends; other white space stays."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))
