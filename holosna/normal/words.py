"""Numbers, signs, letters and identifiers of a single text as words: what the passes read their matches with."""

from __future__ import annotations

from functools import cache

from holosna.normal import rx
from holosna.functions import tables as T
from holosna.normal.checks import roman, valid_roman
from holosna.normal.lexicon import Unit

DIGIT_NAMES = [T.ZERO, *T.ONES[1:]]
LETTERS = "А-Яа-яЄєІіЇїҐґ"
CASE_FORMS = T.case_forms()
# --- fixed values: combining forms of cardinal words that aren't the genitive; places, units of time, figures -------------------------------------------------------------------------------------------------------------
COMPOUND = {
    "один": "одно", "одна": "одно", "два": "дво", "дві": "дво", "три": "три", "чотири": "чотири", "дев'яносто": "дев'яносто", "сто": "сто",
    "тисяча": "тисячо", "тисячі": "тисячо", "тисяч": "тисячо",
}
PLACES_GENITIVE = [("десятої", "десятих"), ("сотої", "сотих"), ("тисячної", "тисячних"), ("десятитисячної", "десятитисячних"), ("стотисячної", "стотисячних"), ("мільйонної", "мільйонних")]
HOUR, MINUTE, SECOND = (Unit("година", "години", "годин", "години", "f"), Unit("хвилина", "хвилини", "хвилин", "хвилини", "f"), Unit("секунда", "секунди", "секунд", "секунди", "f"))
MINUSES = "-−–—"
# ------------------------------------------------------------------------------------------------------------------------------

_LOWER = {**{c: c + 32 for c in range(0x41, 0x5B)}, **{c: c + 32 for c in range(0x410, 0x430)}, **{ord(a): ord(b) for a, b in zip("ЄІЇҐ", "єіїґ", strict=True)}}
_UPPER = {b: a for a, b in _LOWER.items()}


def lower(text: str) -> str:
    """ASCII and Ukrainian letters in lower case; all others stay."""
    return text.translate(_LOWER)


def upper(text: str) -> str:
    return text.translate(_UPPER)


def is_letter(c: str) -> bool:
    """A Ukrainian letter, or an apostrophe that binds a word."""
    return "а" <= c <= "я" or "А" <= c <= "Я" or c in "єЄіІїЇґҐ’'"


def capitalised(text: str) -> str:
    for i, c in enumerate(text):
        if "a" <= c <= "z" or is_letter(c):
            return text[:i] + upper(c) + text[i + 1 :]
    return text


def whole(digits: str) -> int | None:
    """The number that the digits write, if it fits 64 bits; None for none."""
    n = int(digits) if digits.isascii() and digits.isdigit() and len(digits) < 40 else None
    return n if n is not None and n < 1 << 64 else None


def number(digits: str) -> int:
    """The number at the start of the text; 0 if there is none, or none that fits."""
    lead = rx.match("[0-9]*", digits)[0]
    return whole(lead) or 0 if lead else 0


def is_one(n: int) -> bool:
    return n % 10 == 1 and n % 100 != 11


def agree(n: int, unit: Unit) -> str:
    """The form of the unit that stands after n."""
    if is_one(n):
        return unit.one
    return unit.few if 2 <= n % 10 <= 4 and not 12 <= n % 100 <= 14 else unit.many


def digit_by_digit(text: str) -> str:
    return " ".join(DIGIT_NAMES[int(c)] for c in text if "0" <= c <= "9")


@cache
def cardinal(n: int, gender: str = "m") -> str:
    if n == 0:
        return T.ZERO
    if n > T.MAX_SPELLED_NUMBER:
        return T.agreed(digit_by_digit(str(n)), gender)
    out = []
    for value, forms in T.SCALES.items():
        if count := n // value % 1000:
            spoken = T.agreed(T.below_thousand(count), "f" if value == 1000 else "m")
            out += [*([] if (value, count) == (1000, 1) else [spoken]), agree(count, Unit(*forms))]
    return T.agreed(" ".join([*out, T.below_thousand(n % 1000)]).strip(), gender)


@cache
def cased(n: int, case: str, gender: str = "m") -> str:
    """Cardinal words in the case gen, dat, instr or prep."""
    at = T.CASES.index(case)
    return " ".join(CASE_FORMS[w][at] if w in CASE_FORMS else w for w in cardinal(n, gender).split())


@cache
def ordinal(n: int, form: str = "nom_m") -> str:
    if n % 1000 == 0 and n // 1000 in T.ROUND_THOUSANDS:
        return T.inflected(T.ROUND_THOUSANDS[n // 1000] + "тисячний", form)
    head, _, last = cardinal(n).rpartition(" ")
    return f"{head} {T.inflected(T.ORDINAL_STEMS.get(last, last), form)}".strip()


@cache
def compound(n: int) -> str:
    """The number as the first part of a compound word, as дво or п'яти."""
    return "".join(COMPOUND.get(w) or CASE_FORMS.get(w, (w,))[0] for w in cardinal(n).split())


def digits_or_words(digits: str) -> str:
    n = whole(digits)
    return digit_by_digit(digits) if n is None else cardinal(n)


def decimal(integer: str, fraction: str) -> str | None:
    """``дві цілих і п'ять десятих``; None for more than six places or what isn't a number."""
    i, f = whole(integer), whole(fraction)
    if i is None or f is None or not 1 <= len(fraction) <= len(T.PLACES):
        return None
    one, many = T.PLACES[len(fraction) - 1]
    return f"{cardinal(i, 'f')} {'ціла' if is_one(i) else 'цілих'} і {cardinal(f, 'f')} {one if is_one(f) else many}"


def decimal_or_digits(integer: str, fraction: str) -> str:
    return decimal(integer, fraction) or f"{digits_or_words(integer or '0')} кома {digit_by_digit(fraction)}"


def sign_of(token: str) -> tuple[str, str]:
    """The spoken sign and the rest of the token."""
    if token[:1] and token[0] in MINUSES:
        return "мінус ", token[1:]
    return ("плюс ", token[1:]) if token[:1] == "+" else ("", token)


def signed(token: str, case: str = "", gender: str = "m") -> str | None:
    """A number with an optional sign and decimals, in the genitive for case gen; None if it can't be read."""
    sign, token = sign_of(token)
    integer, mark, fraction = _halves(token)
    if not mark:
        n = whole(token)
        return None if n is None else sign + (cased(n, "gen", gender) if case == "gen" else cardinal(n, gender))
    i, f = whole(integer or "0"), whole(fraction)
    if i is None or f is None or not 1 <= len(fraction) <= len(PLACES_GENITIVE):
        return None
    if case != "gen":
        words = decimal(integer, fraction)
        return None if words is None else sign + words
    one, many = PLACES_GENITIVE[len(fraction) - 1]
    return f"{sign}{cased(i, 'gen', 'f')} {'цілої' if is_one(i) else 'цілих'} і {cased(f, 'gen', 'f')} {one if is_one(f) else many}"


def _halves(token: str) -> tuple[str, str, str]:
    """What stands before and after the first point or comma, and the mark."""
    found = rx.search("[.,]", token)
    return (token[: found.start()], found[0], token[found.end() :]) if found else (token, "", "")


def many_after_genitive(n: int) -> bool:
    return n % 10 == 0 or n % 10 >= 5 or 11 <= n % 100 <= 14


def counted(n: int, unit: Unit) -> str:
    return f"{cardinal(n, unit.gender)} {agree(n, unit)}"


def fraction(over: int, under: int) -> str:
    return f"{cardinal(over, 'f')} {ordinal(under, 'nom_f' if is_one(over) else 'pl')}"


def quantity(token: str, unit: Unit) -> str:
    """An amount with its unit; a leading - or + is spoken."""
    sign, token = sign_of(token) if token[:1] in ("-", "+") else ("", token)
    integer, mark, part = _halves(token)
    if mark:
        return f"{sign}{decimal_or_digits(integer or '0', part)} {unit.decimal}"
    n = whole(token)
    return sign + (f"{digit_by_digit(token)} {unit.many}" if n is None else counted(n, unit))


def finance_amount(amount: str, unit: Unit) -> str:
    integer, mark, part = _halves(amount.replace(" ", ""))
    return f"{decimal_or_digits(integer, part)} {unit.decimal}" if mark else counted(number(integer), unit)


def letters(text: str) -> str:
    """Latin and Cyrillic letters by name; other characters are left out."""
    names = (T.LATIN_LETTER_NAMES.get(c.upper()) if c.isascii() else T.LETTER_NAMES.get(upper(c)) for c in text)
    return " ".join(x for x in names if x)


def identifier_number(digits: str) -> str:
    return digit_by_digit(digits) if len(digits) > 4 or (len(digits) > 1 and digits[0] == "0") else cardinal(number(digits))


def segment(text: str) -> str:
    """A part of an identifier: its figures as numbers, its letters as a Roman ordinal or by name."""
    out = []
    for run in rx.findall(f"[0-9]+|[A-Za-z{LETTERS}’']+", text):
        if run[0].isdigit():
            out.append(identifier_number(run))
        else:
            up = run.upper() if run.isascii() else ""
            out.append(ordinal(roman(up)) if up and valid_roman(up) else letters(run))
    return " ".join(out)


def structured(value: str) -> str:
    """An identifier of several parts; slashes and hyphens between them are spoken."""
    out = []
    for part in rx.findall(f"[0-9A-Za-z{LETTERS}’']+|[/‑–—-]", value):
        out.append("слеш" if part == "/" else "дефіс" if part in "-‑–—" else segment(part))
    return " ".join(out)


def dotted(text: str) -> str:
    return " крапка ".join(digit_by_digit(p) if len(p) > 1 and p[0] == "0" else digits_or_words(p) for p in text.split("."))


def phone(text: str, style: str) -> str:
    """A phone number in words; what is neither Ukrainian nor international stays."""
    groups, abroad = rx.findall("[0-9]+", text), text.startswith("00")
    if abroad:
        groups = [g for g in [groups[0][2:], *groups[1:]] if g]
    digits = "".join(groups)
    if len(digits) == 10 and digits[0] == "0":
        digits = "38" + digits
    one_by_one = style == "digit_by_digit"
    if len(digits) == 12 and digits.startswith("380"):
        if one_by_one:
            return "плюс " + digit_by_digit(digits)
        return " ".join(["плюс", cardinal(380), *(digit_by_digit(g) if g[0] == "0" else cardinal(int(g)) for g in (digits[3:5], digits[5:8], digits[8:10], digits[10:]))])
    if not (text.startswith("+") or abroad) or not 7 <= len(digits) <= 15:
        return text
    if one_by_one or len(groups) < 2:
        return "плюс " + digit_by_digit(digits)
    return " ".join(["плюс", *(digit_by_digit(g) if len(g) > 3 or (len(g) > 1 and g[0] == "0") else cardinal(int(g)) for g in groups)])
