"""Passes on science, medicine, multipliers, versions, and the numbers that nothing else reads."""

from __future__ import annotations

from holosna.normal import rx
from holosna.normal import lexicon as L
from holosna.normal import temperature
from holosna.normal import words as W
from holosna.normal.dates import joined
from holosna.normal.lexicon import Unit
from holosna.normal.rules import BEFORE_RANGE, LETTERS, NO_CYRILLIC, NO_LETTER, SIGNED, UNIT, Around, Match, passes, rule

# --- fixed values ----------------------------------------------------------------------------------------------------------------
SUPERSCRIPTS = {"⁰": "0", "¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁻": "-", "⁺": "+"}
MULTIPLIERS = {
    "тис": Unit("тисяча", "тисячі", "тисяч", "тисячі", "f"), "млн": Unit("мільйон", "мільйони", "мільйонів", "мільйона"),
    "млрд": Unit("мільярд", "мільярди", "мільярдів", "мільярда"), "трлн": Unit("трильйон", "трильйони", "трильйонів", "трильйона"),
}
TIMES = Unit("раз", "рази", "разів")
GOVERNING = "Близько|близько|Після|після|Менше|менше|Більше|більше|Без|без|Від|від|До|до|Із|із"
CROSS = r"\s*(?:×|·|x|X|\*)\s*"
NOT_IN_WORD = rf"(^|[^A-Za-z{LETTERS}\d.,])"
BASE = r"([+-]?\d+(?:[.,]\d+)?)"
MERCURY = r"\s*мм\s*рт\.?\s*ст\.?"
# --------------------------------------------------------------------------------------------------------------------------------


@rule(r"(^|[^\d.,])(\d+(?:[.,]\d+)?)\s*(мг|мл|г)\s*/\s*(мл|л)" + NO_LETTER, fold=True)
def _concentration(m: Match) -> str:
    return f"{m[1]}{W.quantity(m[2], L.UNIT[W.lower(m[3])])} на {L.UNIT[W.lower(m[4])].one}"


def _pressure(low: str, high: str) -> str:
    return f"{W.cardinal(int(low))} на {W.cardinal(int(high))} міліметрів ртутного стовпа"


@rule(rf"(^|[^{LETTERS}\d])(тиск\s+)(\d{{2,3}})\s*/\s*(\d{{2,3}}){MERCURY}", fold=True)
def _labelled_pressure(m: Match) -> str:
    return m[1] + m[2] + _pressure(m[3], m[4])


@rule(rf"(^|[^\d.,])(\d{{2,3}})\s*/\s*(\d{{2,3}}){MERCURY}", fold=True)
def _bare_pressure(m: Match) -> str:
    return m[1] + _pressure(m[2], m[3])


@rule(rf"{BEFORE_RANGE}({SIGNED})\s*±\s*({SIGNED})\s*({temperature.SCALE}){NO_LETTER}")
def _temperature_tolerance(m: Match) -> str | None:
    on, base = temperature.scale(m[4]), W.signed(m[2])
    off = on and temperature.spoken(m[3], on)
    return f"{m[1]}{base} плюс мінус {off}" if base and off else None


@rule(rf"(^|[^{LETTERS}-])({GOVERNING})\s+({SIGNED})\s*({temperature.SCALE}){NO_LETTER}")
def _governed_temperature(m: Match) -> str | None:
    on = temperature.scale(m[4])
    words = on and temperature.spoken(m[3], on, "gen")
    return words and f"{m[1]}{m[2]} {words}"


@rule(rf"{BEFORE_RANGE}({SIGNED})\s*({temperature.SCALE}){NO_LETTER}")
def _temperature(m: Match) -> str | None:
    on = temperature.scale(m[3])
    words = on and temperature.spoken(m[2], on)
    return words and m[1] + words


@rule(rf"(^|[^{LETTERS}\d])(\d+)\s*(?:р\.|раз(?:и|ів)?)(\s+на\s+(?:день|добу|тиждень|місяць)){NO_CYRILLIC}", fold=True)
def _frequency(m: Match) -> str:
    return f"{m[1]}{W.counted(W.number(m[2]), TIMES)}{m[3]}"


@rule(rf"(^|[^{LETTERS}\d])№\s*(\d{{1,4}})(?![\d/])")
def _number_sign(m: Match) -> str:
    return f"{m[1]}номер {W.cardinal(int(m[2]))}"


medical = passes(_concentration, _labelled_pressure, _bare_pressure, _temperature_tolerance, _governed_temperature, _temperature, _frequency, _number_sign)


@rule("(?<=[0-9])[" + "".join(SUPERSCRIPTS) + "]+")
def _superscripts(m: Match) -> str:
    return "^" + "".join(SUPERSCRIPTS[c] for c in m[0])


def _exponent(token: str) -> str | None:
    """The words of an exponent with its ASCII sign."""
    sign, rest = {"-": "мінус ", "+": "плюс "}.get(token[:1], ""), token.lstrip("+-") if token[:1] in "+-" else token
    n = W.whole(rest)
    return None if n is None else sign + W.cardinal(n)


def _power(base: str, exponent: str) -> str | None:
    words, power = W.signed(base), _exponent(exponent.replace("−", "-", 1))
    return f"{words} помножити на десять у степені {power}" if words and power else None


def _unit_of(amount: str, key: str | None) -> str:
    """The unit after a power, agreeing with the amount before it."""
    if not key or key not in L.UNIT:
        return ""
    unit, rest = L.UNIT[key], amount[1:] if amount[:1] in ("+", "-") else amount
    n = W.whole(rest)
    return " " + unit.decimal if rx.search("[.,]", rest) else "" if n is None else " " + W.agree(n, unit)


@rule(rf"(^|[^\d]){BASE}{CROSS}10−(\d+)\s*°[CС](?:−|-)(\d+)(?!\d)")
def _per_degree(m: Match) -> str | None:
    words, inverse = _power(m[2], "-" + m[3]), W.number(m[4])
    return words and f"{m[1]}{words} на градус Цельсія" + ("" if inverse == 1 else f" у степені {W.cardinal(inverse)}")


@rule(rf"{NOT_IN_WORD}{BASE}{CROSS}10\s*\^\s*([+-]?\d+)(?!\d)(?:\s*({UNIT}))?{NO_LETTER}")
def _times_ten(m: Match) -> str | None:
    words = _power(m[2], m[3])
    return words and m[1] + words + _unit_of(m[2], m[4])


@rule(rf"{NOT_IN_WORD}{BASE}{CROSS}10\s*((?:\+|-|−)\d+)(?!\d)(?:\s*({UNIT}))?")
def _times_ten_plain(m: Match) -> str | None:
    words = _power(m[2], m[3])
    return words and m[1] + words + _unit_of(m[2], m[4])


@rule(rf"{NOT_IN_WORD}{BASE}[eE]([+-]?\d+)(?![A-Za-z{LETTERS}\d])")
def _e_notation(m: Match) -> str | None:
    words = _power(m[2], m[3])
    return words and m[1] + words


@rule(rf"(^|[^\d])10−(\d+)\s*(?:-|–|—)\s*10−(\d+)(?:\s*(секунди|секунда|секунд|{UNIT}))?{NO_LETTER}")
def _negative_powers(m: Match, around: Around) -> str | None:
    low, high = _exponent("-" + m[2]), _exponent("-" + m[3])
    if low is None or high is None:
        return None
    unit = " секунд" if m[4] in ("секунди", "секунда", "секунд") else _unit_of("10", m[4])
    return m[1] + joined(around.from_to, f"десяти у степені {low}", f"десяти у степені {high}") + unit


@rule(rf"(^|[^\d])10−(\d+)(?!\d)(?:\s*({UNIT}))?")
def _negative_power(m: Match) -> str | None:
    power = _exponent("-" + m[2])
    return power and f"{m[1]}десять у степені {power}{_unit_of('10', m[3])}"


@rule(rf"{NOT_IN_WORD}{BASE}\s*\^\s*([+-]?\d+)(?!\d)")
def _bare_power(m: Match) -> str | None:
    base, power = W.signed(m[2]), _exponent(m[3])
    return f"{m[1]}{base} у степені {power}" if base and power else None


scientific = passes(_superscripts, _per_degree, _times_ten, _times_ten_plain, _e_notation, _negative_powers, _negative_power, _bare_power)


@rule(r"(\d)\s*\+\s*(?=\d)")
def sums(m: Match) -> str:
    return f"{m[1]} плюс "


@rule(r"\b(\d+)[,.](\d+)\b")
def decimals(m: Match) -> str:
    return W.decimal_or_digits(m[1], m[2])


@rule(r"\b(\d+),(\d{3,})(?=\s*(?:грн|UAH|USD|EUR|GBP|[\$€£₴]|долар|євро|фунт))", fold=True)
def precise_money(m: Match) -> str:
    """More decimals than money has are read one by one."""
    return f"{W.digits_or_words(m[1])} кома {W.digit_by_digit(m[2])}"


@rule(rf"(^|[^{LETTERS}-])({GOVERNING}|Серед|серед)\s+(\d+(?:[.,]\d+)?)\s*(тис|млн|млрд|трлн)\.?(?![а-яіїєґ])", fold=True)
def governed_multipliers(m: Match) -> str | None:
    unit = MULTIPLIERS[W.lower(m[4])]
    words = W.signed(m[3], "gen", unit.gender)
    return words and f"{m[1]}{m[2]} {words} {unit.decimal if rx.search('[.,]', m[3]) else unit.many}"


@rule(r"\b(\d+(?:[.,]\d+)?)\s*(тис|млн|млрд|трлн)(\.?)(?![а-яіїєґ])", fold=True)
def _multiplier(m: Match) -> str | None:
    """A point stays only where it ends the text."""
    unit, end, halves = MULTIPLIERS[W.lower(m[2])], m[3] if m.end() == len(m.string) else "", rx.split("[.,]", m[1])
    if len(halves) == 2:
        words = W.decimal(*halves)
        return words and f"{words} {unit.decimal}{end}"
    n = W.whole(m[1])
    return (f"{W.digit_by_digit(m[1])} {unit.many}" if n is None else W.counted(n, unit)) + end


multipliers = passes(governed_multipliers, _multiplier)


@rule(
    r"(^|[\s(\[{:,;])((?:(?:В|в)ерсі(?:я|ї|ю|єю)|(?:Р|р)еліз(?:у|ом)?|(?:В|в)ипуск(?:у|ом)?|(?:П|п)ункт(?:у|ом|і|а)?|(?:Р|р)озділ(?:у|ом|і|а)?)\s+)(\d+(?:\.\d+)+)\b"
)
def _named_version(m: Match) -> str:
    return m[1] + m[2] + W.dotted(m[3])


@rule(r"\b([A-Za-z][A-Za-z0-9_\-]*\s+)(\d+(?:\.\d+)+)\b")
def _version_of(m: Match) -> str:
    return m[1] + W.dotted(m[2])


@rule(r"\b([vV])(\d+(?:\.\d+)+)\b")
def _v_version(m: Match) -> str:
    return f"{W.letters(m[1])} {W.dotted(m[2])}"


@rule(r"\b([A-Za-z])\.(\d{1,6})\b")
def _letter_number(m: Match) -> str:
    return f"{W.letters(m[1])} крапка {W.digits_or_words(m[2])}"


@rule(r"\b(\d+)\.(\d+)([A-Za-z]{1,6})\b")
def _number_suffix(m: Match) -> str:
    return f"{W.digits_or_words(m[1])} крапка {W.digits_or_words(m[2])} {W.letters(m[3])}"


@rule(r"\b\d+(?:\.\d+){2,}\b")
def _dotted(m: Match) -> str:
    return W.dotted(m[0])


versions = passes(_named_version, _version_of, _v_version, _letter_number, _number_suffix, _dotted)


@rule(r"(^|[\s(\[])(?:-|−|–|—)(\d)")
def negatives(m: Match) -> str:
    return f"{m[1]}мінус {m[2]}"


@rule(r"\b\d+\b")
def numbers(m: Match) -> str:
    return W.digit_by_digit(m[0]) if len(m[0]) > 1 and m[0][0] == "0" else W.digits_or_words(m[0])
