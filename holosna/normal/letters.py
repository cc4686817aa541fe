"""Passes on abbreviations, acronyms, Latin words, and tokens of letters and figures."""

from __future__ import annotations

from collections.abc import Mapping

import regex

from holosna.functions import tables as T
from holosna.normal import rx
from holosna.normal import lexicon as L
from holosna.normal import words as W
from holosna.normal.rules import LETTERS, Match, passes, pattern, rule

_WORD = f"[{LETTERS}A-Za-z0-9’']"


def _loose(key: str) -> str:
    """A pattern of the abbreviation: letters of either case, blanks where it has some and around its points."""
    out = ""
    for i, c in enumerate(key):
        if c == " ":
            out += " *"
        elif c == ".":
            out += r" *\." + (" *" if i + 1 < len(key) else "")
        else:
            out += f"[{W.lower(c)}{W.upper(c)}]" if W.lower(c) != W.upper(c) else regex.escape(c)
    return f"(?<!{_WORD})({out})" + (f"(?!{_WORD})" if rx.fullmatch(_WORD, key[-1]) else "")


_KEYS = list(L.ABBREVIATIONS.items())
_ABBREVIATION = pattern("|".join(_loose(key) for key, _ in _KEYS))


def abbreviation_patterns() -> list[str]:
    """A pattern for each abbreviation."""
    return [_loose(key) for key, _ in _KEYS]


def abbreviations(text: str) -> str:
    """Abbreviations in full, capital if they were. The point of one that ends the text ends the sentence too."""

    def read(m: Match) -> str:
        key, full = _KEYS[m.lastindex - 1]
        out = W.capitalised(full) if rx.match("[А-ЯЄІЇҐ]", m[0]) else full
        return out + ("." if key.endswith(".") and m.end() == len(m.string) else "")

    return _ABBREVIATION.sub(read, text)


@rule("[А-ЯЄІЇҐ]{2,}")
def acronyms(m: Match) -> str | None:
    """Runs of capitals without a vowel, letter by letter."""
    return None if rx.search("[АЕЄИІЇОУЮЯ]", m[0]) else " ".join(T.LETTER_NAMES[c] for c in m[0] if c in T.LETTER_NAMES)


_SINGLE = {k: v for k, v in T.LATIN.items() if len(k) == 1} | T.DIACRITICS


def transliterated(text: str) -> str:
    """Latin letters as Cyrillic ones, the longest sequences first, in lower case."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes fold ASCII alone
    for sequence in T.LATIN_SEQUENCES:
        text = text.replace(sequence, T.LATIN[sequence])
    for c in _SINGLE.keys() & set(text):
        text = text.replace(c, _SINGLE[c])
    return text


def _names(run: str) -> str:
    return " ".join(T.LATIN_LETTER_NAMES[c.upper()] for c in run)


def english(text: str, vocabulary: Mapping[str, str]) -> str:
    """Latin words that the vocabulary or the lexicon knows as their readings; other runs of capitals letter by letter."""
    known = {**L.LATIN_WORDS, **vocabulary} if vocabulary else L.LATIN_WORDS
    text = rx.sub(r"(?a)\b[A-Za-z][A-Za-z'’-]*\b", lambda m: known.get(m[0].lower(), m[0]), text)
    return rx.sub(r"(?a)\b[A-Z]+\b", lambda m: m[0] if m[0].lower() in known else _names(m[0]), text)


def _figures(run: str) -> str:
    return W.digit_by_digit(run) if len(run) > 1 and run[0] == "0" else W.digits_or_words(run)


@rule(r"\bIPv([46])\b", fold=True)
def _protocol(m: Match) -> str:
    return "ай пі версії " + _figures(m[1])


@rule(r"\b(\d+)(G|D)\b")
def _generation(m: Match) -> str:
    return f"{_figures(m[1])} {'джі' if m[2] == 'G' else 'ді'}"


@rule(r"\bx(86|64)\b", fold=True)
def _x86(m: Match) -> str:
    return "ікс " + _figures(m[1])


@rule(r"\b(\d+)(?:st|nd|rd|th)\b", fold=True)
def _english_ordinal(m: Match) -> str | None:
    n = W.whole(m[1])
    return None if n is None else W.ordinal(n, "nom")


@rule(r"\b(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]+\b")
def _mixed(m: Match) -> str:
    return " ".join(_figures(x) if x[0].isdigit() else _names(x) if rx.fullmatch("[A-Z]+", x) else x for x in rx.findall("[0-9]+|[A-Za-z]+", m[0]))


technical = passes(_protocol, _generation, _x86, _english_ordinal, _mixed)

_TIMES = r"(?<=[0-9])х(?=[0-9])"


@rule(f"[{LETTERS}0-9](?:[{LETTERS}0-9/–—-]*[{LETTERS}0-9])?")
def cyrillic_tokens(m: Match) -> str | None:
    """Tokens of Cyrillic letters and figures that have a capital or a cross between figures, part by part."""
    token = m[0]
    if not rx.search("[0-9]", token) or not rx.search(f"[{LETTERS}]", token) or not rx.search(f"[А-ЯЄІЇҐ]|{_TIMES}", token):
        return None
    out = []
    for part in rx.finditer(f"([0-9]+)|([–—-])|(/)|({_TIMES})|([{LETTERS}]+)", token):
        out.append([W.identifier_number, lambda _: "дефіс", lambda _: "слеш", lambda _: "помножити на", W.letters][part.lastindex - 1](part[0]))
    return " ".join(x for x in out)
