"""Passes on ordinals, centuries, quarters, pages and numbered parts of documents."""

from __future__ import annotations

from holosna.normal import rx
from holosna.normal import words as W
from holosna.normal.checks import roman, valid_roman
from holosna.normal.dates import year
from holosna.normal.lexicon import Unit
from holosna.normal.rules import LETTERS, NO_CYRILLIC, Around, Match, passes, rule

# --- fixed values: forms that endings tell, words that aren't Roman numerals, names of parts --------------------------------
ENDINGS = {
    "й": "nom_m", "ший": "nom_m", "го": "gen", "му": "dat", "м": "prep", "а": "nom_f", "ша": "nom_f", "га": "nom_f", "тя": "nom_f", "у": "acc_f", "е": "nom_n", "ше": "nom_n", "ге": "nom_n",
    "тє": "nom_n", "х": "pl", "им": "ins", "ім": "ins", "ою": "ins_f", "ій": "loc_f", "ими": "ins_pl",
}
NOT_ROMAN = ["CD", "DVD", "MD", "DC", "MC", "MI", "MM", "DI", "DIV", "DVI", "DL", "CLI", "MIX", "CIV", "LCD"]
ROMAN = r"(?:Х|І|X|I|V|M|C|D|L){1,8}"
CENTURY = r"(ст\.|століття|столітті|сторіччя|сторіччі)"
DASH = r"\s*(?:-|−|–|—)\s*"
ROMAN_DASH = r"\s*(?:-|–|—)\s*"
# part: plural after a compact range, genitive after від … до, gender of its ordinal
PARTS = {
    "ст": ("статті", "статті", "f"), "статті": ("статті", "статті", "f"), "ч": ("частини", "частини", "f"), "частини": ("частини", "частини", "f"),
    "п": ("пункти", "пункту", "m"), "пункти": ("пункти", "пункту", "m"), "пп": ("підпункти", "підпункту", "m"), "підпункти": ("підпункти", "підпункту", "m"),
    "абз": ("абзаци", "абзацу", "m"), "розд": ("розділи", "розділу", "m"), "гл": ("глави", "глави", "f"), "табл": ("таблиці", "таблиці", "f"), "рис": ("рисунки", "рисунка", "m"),
}
PAGE = Unit("сторінка", "сторінки", "сторінок", "", "f")
# --------------------------------------------------------------------------------------------------------------------------------


def _mixed_roman(token: str) -> int | None:
    """The value of a numeral that has Cyrillic look-alikes."""
    latin = token.replace("Х", "X").replace("І", "I")
    return roman(latin) if latin != token and valid_roman(latin) else None


def _last_word(text: str) -> str:
    return rx.split(r"[ \t\n]", W.lower(text).rstrip())[-1]


@rule(rf"(^|[^A-Za-z{LETTERS}])({ROMAN}){ROMAN_DASH}({ROMAN})\s*{CENTURY}{NO_CYRILLIC}")
def _centuries(m: Match, around: Around) -> str | None:
    first, second = _mixed_roman(m[2]), _mixed_roman(m[3])
    if first is None or second is None:
        return None
    stem = "сторічч" if m[4].startswith("сторіч") else "століття"[:-1]
    if _last_word(around.before + m[1]) in ("у", "в") or m[4] in ("столітті", "сторіччі"):
        return f"{m[1]}{W.ordinal(first, 'prep')}–{W.ordinal(second, 'prep')} {stem}ях"
    return f"{m[1]}від {W.ordinal(first, 'gen')} до {W.ordinal(second, 'gen')} {stem}я"


@rule(rf"(^|[^A-Za-z{LETTERS}])({ROMAN})\s*{CENTURY}{NO_CYRILLIC}")
def _century(m: Match, around: Around) -> str | None:
    value, before = _mixed_roman(m[2]), _last_word(around.before + m[1])
    if value is None:
        return None
    inside = before in ("у", "в") or m[3] in ("столітті", "сторіччі")
    form = "prep" if inside else "gen" if before in ("початку", "кінця", "середини", "половини") else "nom_n"
    return f"{m[1]}{W.ordinal(value, form)} {'сторічч' if m[3].startswith('сторіч') else 'століття'[:-1]}{'і' if inside else 'я'}"


@rule(rf"(Протягом|протягом|Впродовж|впродовж|Упродовж|упродовж)\s+({ROMAN})\s+та\s+початку")
def _century_and_start(m: Match) -> str | None:
    value = _mixed_roman(m[2])
    return None if value is None else f"{m[1]} {W.ordinal(value, 'gen')} століття та початку"


@rule(rf"(\d+)(?:-|–|—)(ший|ими|им|ім|ою|ій|ше|ша|ге|га|тє|тя|го|му|й|м|а|у|е|х){NO_CYRILLIC}")
def _ending(m: Match) -> str:
    return year(m[1], ENDINGS[m[2]])


def _roman_pair(m: Match, form: str, noun: str) -> str | None:
    return f"{m[1]}{W.ordinal(roman(m[2]), form)} {W.ordinal(roman(m[3]), form)} {noun}" if valid_roman(m[2]) and valid_roman(m[3]) else None


@rule(rf"(^|[^A-Za-z])([MDCLXVI]{{1,6}}){ROMAN_DASH}([MDCLXVI]{{1,6}})\s*(?:ст\.|століття){NO_CYRILLIC}")
def _roman_centuries(m: Match) -> str | None:
    return _roman_pair(m, "nom_n", "століття")


@rule(rf"(^|[^A-Za-z])([MDCLXVI]{{1,6}}){ROMAN_DASH}([MDCLXVI]{{1,6}})\s*(розд\.|розділ){NO_CYRILLIC}")
def _roman_sections(m: Match) -> str | None:
    return _roman_pair(m, "nom_m", "розділ")


@rule(rf"(^|[^A-Za-z])([MDCLXVI]{{1,6}})\s*(?:ст\.|століття){NO_CYRILLIC}")
def _roman_century(m: Match) -> str | None:
    return f"{m[1]}{W.ordinal(roman(m[2]), 'nom_n')} століття" if valid_roman(m[2]) else None


@rule(rf"(^|[^A-Za-z])([MDCLXVI]{{1,6}})\s+(група|групи){NO_CYRILLIC}", fold=True)
def _roman_group(m: Match) -> str | None:
    return f"{m[1]}{W.ordinal(roman(m[2]), 'gen_f' if W.lower(m[3]) == 'групи' else 'nom_f')} {m[3]}" if valid_roman(m[2]) else None


@rule(r"\b[MDCLXVI]{2,}\b")
def _bare_roman(m: Match) -> str | None:
    return W.ordinal(roman(m[0])) if m[0] not in NOT_ROMAN and valid_roman(m[0]) else None


ordinals = passes(_centuries, _century, _century_and_start, _ending, _roman_centuries, _roman_sections, _roman_century, _roman_group, _bare_roman)

_OF_YEAR = rf"(?:\s+(\d{{3,4}})(?:\s*р\.|\s+року)?)?{NO_CYRILLIC}"


def _quarter(m: Match, n: int) -> str | None:
    return f"{m[1]}{W.ordinal(n)} квартал" + (f" {year(m[3])} року" if m[3] else "") if 1 <= n <= 4 else None


@rule(rf"(^|[^A-Za-z])([MDCLXVI]{{1,6}})\s*(?:кв\.|квартал){_OF_YEAR}")
def _roman_quarter(m: Match) -> str | None:
    return _quarter(m, roman(m[2])) if valid_roman(m[2]) else None


@rule(rf"(^|[^\d])(\d{{1,2}})(?:[-–—]?(?:й|ій))?\s*(?:кв\.|квартал){_OF_YEAR}")
def _numeric_quarter(m: Match) -> str | None:
    return _quarter(m, int(m[2]))


quarters = passes(_roman_quarter, _numeric_quarter)


@rule(r"(^|[\s,:;])(У|у|В|в)\s+(\d+)\s+(?:т|Т)(?:т|Т)?\.?([ \t]*)(?=/)")
def _volumes(m: Match) -> str:
    n = W.number(m[3])
    return f"{m[1]}{m[2]} {W.cased(n, 'prep')} {'томі' if W.is_one(n) else 'томах'}{m[4]}"


@rule(r"(^|(?:-|—)\s+)(\d+)\s+(?:с|С)\.(?=\s*(?::|;|-|—|ISBN|$))", fold=True)
def _page_count(m: Match) -> str:
    return m[1] + W.counted(W.number(m[2]), PAGE) + ("." if m.end() == len(m.string) else "")


@rule(rf"(^|[^{LETTERS}A-Za-z])(?:стор\.|Стор\.|СТОР\.|с\.|С\.|pp?\.)\s*(\d+){DASH}(\d+)(?!\d)", fold=True)
def _pages(m: Match, around: Around) -> str | None:
    low, high = W.whole(m[2]), W.whole(m[3])
    if low is None or high is None:
        return None
    return m[1] + (f"від {W.ordinal(low, 'gen_f')} до {W.ordinal(high, 'gen_f')} сторінки" if around.from_to else f"сторінки {W.cardinal(low)} {W.cardinal(high)}")


@rule(rf"(^|[^{LETTERS}A-Za-z])(?:стор|Стор|СТОР|с|С|pp?)\.\s*(\d+)(?!\d)", fold=True)
def _page(m: Match) -> str:
    return f"{m[1]}сторінка {W.cardinal(W.number(m[2]))}"


pages = passes(_volumes, _page_count, _pages, _page)


@rule(rf"(^|[^{LETTERS}A-Za-z])(пп|підпункти)\.?\s*(\d+(?:\.\d+)+){DASH}(\d+(?:\.\d+)+)(?![\d.])", fold=True)
def _dotted_parts(m: Match, around: Around) -> str:
    low, high = W.dotted(m[3]), W.dotted(m[4])
    return m[1] + (f"від підпункту {low} до підпункту {high}" if around.from_to else f"підпункти {low} {high}")


@rule(rf"(^|[^{LETTERS}A-Za-z])(ст|статті|ч|частини|пп|підпункти|п|пункти|абз|розд|гл|табл|рис)\.?\s*(\d+){DASH}(\d+)(?!\d)", fold=True)
def _parts(m: Match, around: Around) -> str | None:
    low, high, part = W.whole(m[3]), W.whole(m[4]), PARTS.get(W.lower(m[2]))
    if low is None or high is None or part is None:
        return None
    plural, genitive, gender = part
    form = "gen_f" if gender == "f" else "gen"
    return m[1] + (f"від {W.ordinal(low, form)} до {W.ordinal(high, form)} {genitive}" if around.from_to else f"{plural} {W.cardinal(low)} {W.cardinal(high)}")


section_ranges = passes(_dotted_parts, _parts)
