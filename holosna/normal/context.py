"""Passes on numbers whose case, gender or form the words around them decide."""

from __future__ import annotations

from holosna.normal import lexicon as L
from holosna.normal import words as W
from holosna.normal.dates import preceding_word
from holosna.normal.rules import LETTERS, NO_CYRILLIC, NOUN, UNIT, Around, Match, any_of, passes, rule

# --- fixed values: cases that prepositions govern; nouns whose numbers are ordinals; parts of laws ----------------------------
GOVERNED = {
    "близько": "gen", "менше": "gen", "більше": "gen", "серед": "gen", "від": "gen", "до": "gen", "із": "gen", "з": "instr", "без": "gen", "після": "gen", "протягом": "gen", "впродовж": "gen",
    "упродовж": "gen", "перед": "instr", "між": "instr", "над": "instr", "під": "instr", "при": "prep", "к": "dat", "о": "prep", "об": "prep",
}
ORDINAL_BEFORE = {
    "місце": "nom_n", "село": "nom_n", "місто": "nom_n", "століття": "nom_n", "ст": "nom_n", "клас": "nom_m", "курс": "nom_m", "раунд": "nom_m", "сезон": "nom_m", "етап": "nom_m", "тур": "nom_m",
    "том": "nom_m", "під'їзд": "nom_m", "поверх": "nom_m", "група": "nom_f", "квартира": "nom_f", "сторінка": "nom_f",
}
OF_ARTICLE = ("частина", "пункт", "розділ", "параграф", "глава")
OUTSIDE = rf"(^|[^{LETTERS}])"
COUNT = r"([1-9]\d{0,5})"
# --------------------------------------------------------------------------------------------------------------------------------


def _cased(m: Match, at: int, case: str) -> str:
    return W.cased(W.number(m[at]), case)


@rule(rf"{OUTSIDE}(Понад|понад)\s+(\d+)(?!\d)")
def _over(m: Match) -> str:
    words = W.cardinal(W.number(m[3]))
    return f"{m[1]}{m[2]} " + (words.replace("тисяча", "тисячу", 1) if words.startswith("тисяча ") else words)


@rule(r"(^|[\s(\[{:;,.!?])((?:З|з))\s+(\d+)\s+([^\s,.;:!?]+)")
def _of_plural(m: Match) -> str | None:
    return f"{m[1]}{m[2]} {_cased(m, 3, 'gen')} {m[4]}" if W.lower(m[4]).endswith(("ів", "їв")) else None


@rule(rf"{OUTSIDE}(Після|після|До|до|Від|від|Без|без)\s+(більш|менш)\s+ніж\s+(\d+)(?!\d)")
def _compared(m: Match) -> str:
    return f"{m[1]}{m[2]} {m[3]} ніж {_cased(m, 4, 'gen')}"


@rule(rf"{OUTSIDE}([Зз])\s+(\d+)\s+([а-яєіїґ']{{3,}}(?:ами|ями|ма)){NO_CYRILLIC}")
def _with(m: Match) -> str:
    return f"{m[1]}{m[2]} {_cased(m, 3, 'instr')} {m[4]}"


@rule(r"(^|[\s(\[{:;,.!?])(У|у|В|в|На|на)\s+(\d+)\s+([^\s,.;:!?]+)")
def _in(m: Match) -> str | None:
    return f"{m[1]}{m[2]} {_cased(m, 3, 'prep')} {m[4]}" if W.number(m[3]) != 1 and W.lower(m[4]).endswith(("ому", "ьому", "ій", "их")) else None


@rule(
    rf"(^|[^{LETTERS}-])(Близько|близько|Після|після|Протягом|протягом|Впродовж|впродовж|Упродовж|упродовж|Менше|менше|Більше|більше|Серед|серед|Перед|перед|Між|між|Над|над|"
    rf"Під|під|При|при|Без|без|Від|від|До|до|Із|із|З|з|Об|об|К|к|О|о)\s+(\d+)(?:\s*({UNIT})(\.?))?(?!\s*%)(?![\d.,:%–—-])(?![A-Za-z{LETTERS}])"
)
def _governed(m: Match) -> str | None:
    case = GOVERNED[W.lower(m[2])]
    if m[4] and case != "gen":  # a unit agrees with the genitive only
        return None
    return f"{m[1]}{m[2]} {_cased(m, 3, case)}" + (f" {L.UNIT[m[4]].many}{m[5]}" if m[4] else "")


@rule(rf"{OUTSIDE}(У|у|В|в|На|на)\s+(\d+)\s+({any_of(L.COUNTED_CASE)}){NO_CYRILLIC}", fold=True)
def _oblique(m: Match) -> str | None:
    case = L.COUNTED_CASE.get(W.lower(m[4]))
    return case and f"{m[1]}{m[2]} {_cased(m, 3, case)} {m[4]}"


cases = passes(_over, _of_plural, _compared, _with, _in, _governed, _oblique)


@rule(rf"(^|[^{LETTERS}\d])(Понад|понад)\s+{COUNT}\s+({NOUN}){NO_CYRILLIC}")
def _over_counted(m: Match) -> str | None:
    noun = L.COUNTED_NOUN.get(W.lower(m[4]))
    return noun and f"{m[1]}{m[2]} {W.counted(int(m[3]), noun)}"


@rule(
    rf"(^|[^{LETTERS}\d])(Близько|близько|Більше|більше|Менше|менше|Серед|серед|До|до|Від|від|Без|без|Після|після|Протягом|протягом|Впродовж|впродовж|Упродовж|упродовж|Із|із)"
    rf"\s+{COUNT}\s+({NOUN}){NO_CYRILLIC}"
)
def _genitive_counted(m: Match) -> str | None:
    noun = L.COUNTED_NOUN.get(W.lower(m[4]))
    return f"{m[1]}{m[2]} {_cased(m, 3, 'gen')} {noun.many}" if noun and W.many_after_genitive(int(m[3])) else None


counted_context = passes(_over_counted, _genitive_counted)


@rule(rf"(^|[^{LETTERS}\d/]){COUNT}\s+({NOUN}){NO_CYRILLIC}", fold=True)
def counted_nouns(m: Match, around: Around) -> str | None:
    """``частина 2 статті`` refers to a part and counts no articles."""
    noun = L.COUNTED_NOUN.get(W.lower(m[3]))
    if noun is None or (noun.one == "стаття" and preceding_word(around.before) in OF_ARTICLE):
        return None
    return m[1] + W.counted(int(m[2]), noun)


@rule(rf"(^|[^\d{LETTERS}])(\d{{1,2}})\s+(класу){NO_CYRILLIC}", fold=True)
def _of_grade(m: Match) -> str | None:
    return f"{m[1]}{W.ordinal(int(m[2]), 'gen')} {m[3]}" if int(m[2]) else None


@rule(rf"(^|[^\d])(\d{{1,4}})\s+({any_of(ORDINAL_BEFORE)}){NO_CYRILLIC}", fold=True)
def _ordinal_noun(m: Match) -> str:
    return f"{m[1]}{W.ordinal(int(m[2]), ORDINAL_BEFORE[W.lower(m[3])])} {m[3]}"


ordinal_nouns = passes(_of_grade, _ordinal_noun)


@rule(rf"(^|[^\d])(\d+)-(?!(?:ший|ими|им|ім|ою|ій|ше|ша|ге|га|тє|тя|го|му|й|м|а|у|е|х)(?:[^{LETTERS}]|$))([^0-9A-Za-z\s,.;:!?()]+)")
def compounds(m: Match) -> str:
    return m[1] + W.compound(W.number(m[2])) + m[3]
