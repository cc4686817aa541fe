"""Passes on clock times, ratios, fractions, percents and measures."""

from __future__ import annotations

from holosna.normal import rx
from holosna.normal import lexicon as L
from holosna.normal import words as W
from holosna.normal.dates import clock, preceding_word
from holosna.normal.ranges import PERCENT
from holosna.normal.rules import LETTERS, NO_CYRILLIC, NO_LETTER, SIGNED, UNIT, Around, Match, any_of, passes, pattern, rule

# --- fixed values: names of time zones, fractions of one sign, accusatives of units ------------------------------------------
ZONES = {
    "europe/kyiv": "за київським часом", "europe/london": "за лондонським часом", "europe/warsaw": "за варшавським часом",
    "america/new_york": "за нью-йоркським часом", "america/los_angeles": "за лос-анджелеським часом", "asia/tokyo": "за токійським часом",
}
VULGAR = {
    "½": (1, 2), "⅓": (1, 3), "⅔": (2, 3), "¼": (1, 4), "¾": (3, 4), "⅕": (1, 5), "⅖": (2, 5), "⅗": (3, 5), "⅘": (4, 5), "⅙": (1, 6), "⅚": (5, 6), "⅐": (1, 7), "⅛": (1, 8), "⅜": (3, 8),
    "⅝": (5, 8), "⅞": (7, 8), "⅑": (1, 9), "⅒": (1, 10),
}
ACCUSATIVE = {"секунда": "секунду", "хвилина": "хвилину", "година": "годину", "миля": "милю", "тонна": "тонну", "унція": "унцію", "атмосфера": "атмосферу"}
POWERS = {"²": "у квадраті", "2": "у квадраті", "³": "у кубі", "3": "у кубі"}
HM = r"(^|[^\d:])(\d{1,2}):([0-5]\d)"
# --------------------------------------------------------------------------------------------------------------------------------


def _clock(m: Match, around: Around | None = None, hour: int | None = None, seconds: bool = True) -> str:
    """The time of groups 2 to 4, in the locative after о or об; midnight by name."""
    h, minute, second = int(m[2]) if hour is None else hour, int(m[3]), int(m[4] or 0) if seconds else 0
    if h in (0, 24) and not minute and not second:
        return "опівночі"
    spoken = clock(h, minute, second)
    if around and preceding_word(around.before + m[1]) in ("о", "об"):
        return spoken.replace(W.counted(h, W.HOUR), f"{W.ordinal(h, 'loc_f')} годині", 1)
    return spoken


@rule(r"(^|[^A-Za-z\d:])(\d+)\s*:\s*([A-Za-z])(?![A-Za-z\d])")
def _variable_ratio(m: Match) -> str:
    return f"{m[1]}{W.cardinal(W.number(m[2]))} до {W.letters(m[3])}"


@rule(HM + r"(?::([0-5]\d))?\s*(a\.?m\.?|p\.?m\.?)(?![A-Za-z])", fold=True)
def _am_pm(m: Match, around: Around) -> str | None:
    hour, pm = int(m[2]), m[5][0] in "pP"
    if not 1 <= hour <= 12:
        return None
    if hour == 12:
        part = " дня" if pm else ""
    elif pm:
        part = " дня" if hour < 6 else " вечора"
    else:
        part = " ночі" if hour < 5 else " ранку"
    return m[1] + _clock(m, around, 0 if hour == 12 and not pm else hour) + part


def _offset(sign: str, hours: int, minutes: int) -> str:
    return f"{'плюс' if sign == '+' else 'мінус'} {W.counted(hours, W.HOUR)}" + (f" {W.counted(minutes, W.MINUTE)}" if minutes else "")


def _beyond(hour: int, hours: int, minutes: int) -> bool:
    return hour > 23 or hours > 14 or (hours == 14 and minutes > 0)


@rule(HM + r"(?::([0-5]\d))?\s*(UTC|GMT)(?:\s*([+-])\s*(\d{1,2})(?::?([0-5]\d))?)?(?![A-Za-z\d])", fold=True)
def _zoned(m: Match) -> str | None:
    hours, minutes = int(m[7] or 0), int(m[8] or 0)
    if _beyond(int(m[2]), hours, minutes):
        return None
    return f"{m[1]}{_clock(m)} за всесвітнім координованим часом" + (" " + _offset(m[6], hours, minutes) if m[6] else "")


@rule(HM + r"(?::([0-5]\d))?\s+([+-])(\d{2}):([0-5]\d)(?!\d)")
def _offset_zoned(m: Match) -> str | None:
    hours, minutes = int(m[6]), int(m[7])
    return None if _beyond(int(m[2]), hours, minutes) else f"{m[1]}{_clock(m)} за часовим поясом {_offset(m[5], hours, minutes)}"


@rule(HM + r"(?::([0-5]\d))?\s+([A-Za-z_+-]+/[A-Za-z0-9_+/-]+)(?![A-Za-z0-9_+/-])", fold=True)
def _named_zone(m: Match) -> str | None:
    zone = ZONES.get(W.lower(m[5]))
    return f"{m[1]}{_clock(m)} {zone}" if zone and int(m[2]) <= 23 else None


@rule(HM + r":([0-5]\d)(?![\d:])")
def _seconds(m: Match, around: Around) -> str | None:
    return m[1] + _clock(m, around) if int(m[2]) <= 23 else None


@rule(rf"(^|[^{LETTERS}\d])((?:О|о)(?:б)?) (\d{{1,2}})(?:-|–|—)?(?:й|ій|а|ої){NO_CYRILLIC}")
def _at_hour(m: Match) -> str:
    return f"{m[1]}{m[2]} {W.ordinal(int(m[3]), 'nom_f')} година"


@rule(HM + rf"\s+(ранку|дня|вечора|ночі)(?![{LETTERS}\d:])", fold=True)
def _part_of_day(m: Match, around: Around) -> str | None:
    return f"{m[1]}{_clock(m, around, seconds=False)} {m[4]}" if int(m[2]) <= 23 else None


@rule(HM + r"(?![\d:])")
def _minutes(m: Match, around: Around) -> str | None:
    hour = int(m[2])
    if around.options.colon_style == "ratio" or hour > 24 or (hour == 24 and int(m[3])):
        return None
    return m[1] + _clock(m, around, seconds=False)


@rule(r"(^|[^\d:])(\d+):(\d+)(?![\d:])")
def _ratio(m: Match, around: Around) -> str | None:
    left, right = W.whole(m[2]), W.whole(m[3])
    if left is None or right is None:
        return None
    if around.options.colon_style == "clock":
        return m[1] + ("опівночі" if left == right == 0 else clock(left, right)) if left <= 23 and right <= 59 else None
    return f"{m[1]}{W.cardinal(left)} до {W.cased(right, 'gen')}"


time = passes(_variable_ratio, _am_pm, _zoned, _offset_zoned, _named_zone, _seconds, _at_hour, _part_of_day, _minutes, _ratio)

_ANY_VULGAR = "".join(VULGAR)


@rule(rf"(\d+)\s*([{_ANY_VULGAR}])\s*({UNIT}){NO_LETTER}")
def _mixed_measure(m: Match) -> str:
    return f"{W.cardinal(W.number(m[1]), 'f')} цілих і {W.fraction(*VULGAR[m[2]])} {L.UNIT[m[3]].decimal}"


@rule(rf"(^|[^\d])([{_ANY_VULGAR}])\s*({UNIT}){NO_LETTER}")
def _vulgar_measure(m: Match) -> str:
    return f"{m[1]}{W.fraction(*VULGAR[m[2]])} {L.UNIT[m[3]].decimal}"


@rule(rf"(\d+)\s*([{_ANY_VULGAR}])")
def _mixed_vulgar(m: Match) -> str:
    return f"{W.cardinal(W.number(m[1]), 'f')} цілих і {W.fraction(*VULGAR[m[2]])}"


@rule(f"[{_ANY_VULGAR}]")
def _vulgar(m: Match) -> str:
    return " " + W.fraction(*VULGAR[m[0]])


def _sign(sign: str) -> str:
    return W.sign_of(sign)[0]


def _slashed(over: str, under: str) -> str | None:
    a, b = W.whole(over), W.whole(under)
    return None if a is None or not b else W.fraction(a, b)


@rule(rf"(^|[^\d.,/])([+\-]?)(\d+)/(\d+)\s*({UNIT}){NO_LETTER}")
def _slashed_measure(m: Match) -> str | None:
    part = _slashed(m[3], m[4])
    return part and f"{m[1]}{_sign(m[2])}{part} {L.UNIT[m[5]].decimal}"


@rule(r"(^|[^\d.,/])([+\-−]?)(\d+) (\d+)/(\d+)\b")
def _mixed_number(m: Match) -> str | None:
    n, part = W.whole(m[3]), _slashed(m[4], m[5])
    return None if n is None or part is None else f"{m[1]}{_sign(m[2])}{W.cardinal(n, 'f')} і {part}"


@rule(r"(^|[^\d.,/])([+\-−]?)(\d+)/(\d+)\b")
def _plain_fraction(m: Match) -> str | None:
    part = _slashed(m[3], m[4])
    return part and m[1] + _sign(m[2]) + part


fractions = passes(_mixed_measure, _vulgar_measure, _mixed_vulgar, _vulgar, _slashed_measure, _mixed_number, _plain_fraction)


def _percent(token: str) -> str | None:
    """A signed number with its noun."""
    words, n = W.signed(token), W.whole(W.sign_of(token)[1])
    if words is None:
        return None
    return f"{words} {PERCENT.decimal}" if rx.search("[.,]", token) else None if n is None else f"{words} {W.agree(n, PERCENT)}"


@rule(
    rf"(^|[^{LETTERS}-])(Близько|близько|Після|після|Менше|менше|Більше|більше|Без|без|Від|від|До|до|Із|із)\s+([+\-]?\d+(?:[.,]\d+)?)\s*%"
)
def _governed_percent(m: Match) -> str | None:
    words = W.signed(m[3], "gen")
    return words and f"{m[1]}{m[2]} {words} {PERCENT.decimal if rx.search('[.,]', m[3]) else PERCENT.many}"


@rule(r"([+\-])(\d+(?:[.,]\d+)?)\s*%")
def _signed_percent(m: Match) -> str | None:
    words = _percent(m[1] + m[2])
    return words and " " + words


@rule(r"(^|[^\d.,+\-])([+\-]?\d+(?:[.,]\d+)?)\s*%")
def _plain_percent(m: Match) -> str | None:
    sign, rest = W.sign_of(m[2])
    words = _percent(m[2])
    if words is None and rest.isdigit():
        words = f"{sign}{W.digit_by_digit(rest)} {PERCENT.many}"
    return words and m[1] + words


percent = passes(_governed_percent, _signed_percent, _plain_percent)

ATOM = f"(?:{any_of(k for k in L.UNIT if not rx.search('[-/ ·]', k))})(?:²|³|2|3)?"
_ATOM = pattern(ATOM)


@rule(rf"(^|[^\d.,])({SIGNED})\s*±\s*({SIGNED})\s*({UNIT}){NO_LETTER}")
def _tolerance(m: Match) -> str | None:
    unit = L.UNIT[m[4]]
    base = W.signed(m[2], "", "f" if unit.gender == "f" else "m")
    return base and f"{m[1]}{base} плюс мінус {W.quantity(m[3], unit)}"


@rule(rf"(^|[^\d.,])({SIGNED})\s*({ATOM})\s*/\s*\(\s*({ATOM})\s*(?:·|\*)\s*({ATOM})\s*\){NO_LETTER}")
def _over_product(m: Match) -> str | None:
    units = [L.UNIT.get(m[i]) for i in (3, 4, 5)]
    return f"{m[1]}{W.quantity(m[2], units[0])} поділити на {units[1].one} помножити на {units[2].one}" if all(units) else None


def _factor(token: str, amount: str | None, under: bool) -> str | None:
    """One unit of a formula with its power; the first carries the amount."""
    unit, power = L.UNIT.get(token), ""
    if unit is None and token[-1] in POWERS:
        unit, power = L.UNIT.get(token[:-1]), " " + POWERS[token[-1]]
    if unit is None:
        return None
    if amount is not None:
        return W.quantity(amount, unit) + power
    return (ACCUSATIVE.get(unit.one, unit.one) if under else unit.one) + power


@rule(rf"(^|[^\d.,])([+\-−]?\d+(?:[.,]\d+)?)\s*({ATOM}\s*(?:·|\*|/)\s*{ATOM}(?:\s*(?:·|\*|/)\s*{ATOM})*)(?!\s*/){NO_LETTER}")
def _formula(m: Match) -> str | None:
    if m[3] in L.UNIT:
        return m[1] + W.quantity(m[2], L.UNIT[m[3]])
    out, end, under = m[1], 0, False
    for atom in _ATOM.finditer(m[3]):
        over = "/" in m[3][end : atom.start()]
        under, first = under or over, out == m[1] and end == 0
        words = _factor(atom[0], m[2] if first else None, under)
        if words is None:
            return None
        out += words if first else f" {'поділити' if over else 'помножити'} на {words}"
        end = atom.end()
    return out


@rule(rf"(^|[^\d.,+\-])([+\-]?\d+(?:[.,]\d+)?)\s*({UNIT})(\.?){NO_LETTER}")
def _measure(m: Match) -> str:
    return f"{m[1]}{W.quantity(m[2], L.UNIT[m[3]])}{m[4]}"


measurements = passes(_tolerance, _over_product, _formula, _measure)
