"""Passes on ranges: of temperatures, years, times, fractions, measures, money, percents, paragraphs, grades and bare numbers.

A range takes the connector that the style, or від and до around it, ask for; a preposition before it governs its case.
"""

from __future__ import annotations

from collections.abc import Callable

from holosna.normal import rx
from holosna.normal import lexicon as L
from holosna.normal import temperature
from holosna.normal import words as W
from holosna.normal.dates import clock, joined, preceding_word, year
from holosna.normal.lexicon import Unit
from holosna.normal.money import may_have_money
from holosna.normal.rules import BEFORE_RANGE, CURRENCY, LETTERS, MONTH, NO_CYRILLIC, NO_LETTER, RANGE, SIGNED, UNIT, Around, Match, Step, passes, rule
from holosna.options import Options

# --- fixed values: patterns and words -------------------------------------------------------------------------------------------
END = r"(?![\d:/+\-−–—])(?![.,]\d)"
LEAD = BEFORE_RANGE.replace("(", "(?P<lead>", 1)
LOW, HIGH = f"(?P<low>{SIGNED})", f"(?P<high>{SIGNED})"
TO = rf"\s*{RANGE}\s*"
DASH = r"\s*(?:-|−|–|—)\s*"
YEAR_WORDS = r"\s*(?:рр\.?|роки|роках|року|років)(?![\dа-яіїєґ])"
SHORT_YEAR_WORDS = r"\s*(?:рр?\.?|роки|роках|року|років)(?![\dа-яіїєґ])"
PERCENT = Unit("відсоток", "відсотки", "відсотків", "відсотка")
HRYVNIA = Unit("гривня", "гривні", "гривень", "", "f")
NOT_A_DATE = rf"(?!\s+(?:{MONTH})(?:\s|$))"
# --------------------------------------------------------------------------------------------------------------------------------


class Frame:
    """What stands around a range: the governing preposition (only where the style reads від … до), its case and connector."""

    def __init__(self, m: Match, around: Around, explicit: bool):
        self.both = around.from_to or explicit
        word = preceding_word(around.before + m["lead"]) if around.from_to and not explicit else ""
        self.word = word if word in ("від", "до", "близько", "на", "в", "у") else ""
        self.inside = self.word in ("на", "в", "у")
        self.case = "gen" if self.both and not self.inside else ""

    def join(self, low: str, high: str) -> str:
        return f"{low}–{high}" if self.word else joined(self.both, low, high)

    def numbers(self, m: Match, gender: str = "m") -> str | None:
        low, high = W.signed(m["low"], self.case, gender), W.signed(m["high"], self.case, gender)
        return None if low is None or high is None else self.join(low, high)


Say = Callable[[Match, Around, bool], str | None]


def _shapes(say: Say, unit: str, end: str, order: str) -> list[Step]:
    """Steps for the ways to write a range with a unit, by letters: unit twice (r), від … до with it twice (e) or once (f), від and a dash (d), a dash (p)."""
    one, other = f"(?P<unit>{unit})", f"(?P<other>{unit})"
    ways = {
        "r": (rf"{LOW}\s*{other}{TO}{HIGH}\s*{one}", False),
        "e": (rf"від\s+{LOW}\s*{other}\s+до\s+{HIGH}\s*{one}", True),
        "f": (rf"від\s+{LOW}\s+до\s+{HIGH}\s*{one}", True),
        "d": (rf"від\s+{LOW}{TO}{HIGH}\s*{one}", True),
        "p": (rf"{LOW}{TO}{HIGH}\s*{one}", False),
    }
    return [rule(LEAD + ways[way][0] + end)(_reading(say, ways[way][1])) for way in order]


def _reading(say: Say, explicit: bool):
    return lambda m, around: say(m, around, explicit)


def _other(m: Match) -> str | None:
    return m.groupdict().get("other")


def _temperature(m: Match, around: Around, explicit: bool) -> str | None:
    on, frame = temperature.scale(m["unit"]), Frame(m, around, explicit)
    first = temperature.scale(_other(m)) if _other(m) else on
    if on is None or first is None:
        return None
    if first != on:
        low, high = (_bound(m[x], s, frame.both) for x, s in (("low", first), ("high", on)))
        return m["lead"] + frame.join(low, high) if low and high else None
    numbers = frame.numbers(m)
    return numbers and f"{m['lead']}{numbers} {temperature.range_unit(m['high'], on)}{on.of}"


def _bound(token: str, on: temperature.Scale, genitive: bool) -> str | None:
    if not genitive:
        return temperature.spoken(token, on)
    words = W.signed(token, "gen")
    return words and f"{words} {temperature.range_unit(token, on)}{on.of}"


_temperatures = _shapes(_temperature, temperature.SCALE, END + NO_LETTER, "erfp")


def _period(lead: str, preposition: str, low: int, high: int) -> str:
    return f"{lead}{preposition} період від {year(low)} до {year(high)} року"


@rule(rf"(^|[^{LETTERS}])(У|у|В|в)\s+(\d{{3,4}}){DASH}(\d{{3,4}}){YEAR_WORDS}")
def _years_in(m: Match) -> str:
    return _period(m[1], m[2], int(m[3]), int(m[4]))


@rule(rf"(^|[^{LETTERS}])(У|у|В|в)\s+(\d{{4}}){DASH}(\d{{4}})(?![\dа-яіїєґ])")
def _bare_years_in(m: Match) -> str:
    return _period(m[1], m[2], int(m[3]), int(m[4]))


def _later(first: int, short: int) -> int:
    """The year that two digits mean after the first one."""
    return first - first % 100 + short + (100 if short < first % 100 else 0)


@rule(rf"\b((?:19|20)\d{{2}})\s*(?:-|–|—)\s*(\d{{2}})(?:-|–|—)?(х|их|і|ї)(?:\s+(роках|років|роки))?(?![\d{LETTERS}])")
def _decades(m: Match) -> str | None:
    first = int(m[1])
    second = _later(first, int(m[2]))
    if first // 100 != second // 100 or first % 10 or second % 10:
        return None
    form = "nom_pl" if m[3] in "ії" else "pl"
    return f"{year(first % 100, form)}–{year(second % 100, form)} {m[4] or ('роки' if form == 'nom_pl' else 'роках')} {year(first // 100 + 1)} століття"


@rule(rf"(^|[^{LETTERS}])(У|у|В|в)\s+((?:19|20)\d{{2}})\s*(?:-|–|—)\s*(\d{{2}}){SHORT_YEAR_WORDS}")
def _short_years_in(m: Match) -> str:
    return _period(m[1], m[2], int(m[3]), _later(int(m[3]), int(m[4])))


@rule(rf"\b((?:19|20)\d{{2}})\s*(?:-|–|—)\s*(\d{{2}}){SHORT_YEAR_WORDS}")
def _short_years(m: Match, around: Around) -> str:
    low, high = int(m[1]), _later(int(m[1]), int(m[2]))
    return f"від {year(low)} до {year(high)} року" if around.from_to else f"{year(low, 'nom_m')}–{year(high, 'nom_m')} роки"


@rule(rf"\b(\d{{3,4}}){DASH}(\d{{3,4}})\s*(?:рр\.?|роки)(?![а-яіїєґ])")
def _years(m: Match, around: Around) -> str:
    if not around.from_to:
        return f"{year(m[1], 'nom_m')} {year(m[2], 'nom_m')} роки"
    word = preceding_word(around.before)
    if word in ("близько", "до", "від"):
        return f"{year(m[1])}–{year(m[2])} року"
    return ("період " if word == "на" else "") + f"від {year(m[1])} до {year(m[2])} року"


def genitive_clock(hour: int, minute: int, second: int = 0) -> str:
    return " ".join([f"{W.ordinal(hour, 'gen_f')} години", *(f"{W.cased(n, 'gen', 'f')} {noun}" for n, noun in ((minute, "хвилин"), (second, "секунд")) if n)])


@rule(rf"{BEFORE_RANGE}(\d{{1,2}}):([0-5]\d)(?::([0-5]\d))?{TO}(\d{{1,2}}):([0-5]\d)(?::([0-5]\d))?(?![\d:])")
def _times(m: Match, around: Around) -> str | None:
    if int(m[2]) > 23 or int(m[5]) > 23:
        return None
    low, high = ((genitive_clock if around.from_to else clock)(*(int(m[i] or 0) for i in (at, at + 1, at + 2))) for at in (2, 5))
    return m[1] + joined(around.from_to, low, high)


def _genitive_fraction(over: int, under: int) -> str:
    return f"{W.cased(over, 'gen', 'f')} {W.ordinal(under, 'gen_f' if W.is_one(over) else 'pl')}"


@rule(rf"{BEFORE_RANGE}(\d+)/(\d+){TO}(\d+)/(\d+)(?![\d/])")
def _fractions(m: Match, around: Around) -> str | None:
    values = [W.whole(m[i]) for i in (2, 3, 4, 5)]
    if None in values or not values[1] or not values[3]:
        return None
    say = _genitive_fraction if around.from_to else W.fraction
    return m[1] + joined(around.from_to, say(*values[:2]), say(*values[2:]))


def _measure(m: Match, around: Around, explicit: bool) -> str | None:
    if _other(m) not in (None, m["unit"]):
        return None
    unit, frame = L.UNIT[m["unit"]], Frame(m, around, explicit)
    numbers = frame.numbers(m, "f" if unit.gender == "f" else "m")
    name = unit.many
    if not frame.both or frame.inside:  # the unit agrees with the upper bound
        upper = W.sign_of(m["high"])[1]
        n = W.whole(upper)
        name = unit.few if rx.search("[.,]", upper) else name if n is None else W.agree(n, unit)
    return numbers and f"{m['lead']}{numbers} {name}"


_measures = _shapes(_measure, UNIT, NO_LETTER, "refdp")


def currency(token: str) -> Unit | None:
    low = W.lower(token)
    if low == "грн":
        return HRYVNIA
    return next((c.main for c in L.CURRENCIES if low == W.lower(c.code) or (c.symbol and token == c.symbol)), None)


def _money(m: Match, around: Around, explicit: bool) -> str | None:
    unit = currency(m["unit"])
    first = currency(_other(m)) if _other(m) else unit
    if unit is None or first is None or first.many != unit.many:
        return None
    numbers = Frame(m, around, explicit).numbers(m, unit.gender)
    return numbers and f"{m['lead']}{numbers} {unit.many}"


_amounts = [
    rule(rf"{LEAD}(?P<other>{CURRENCY})\s*{LOW}{TO}(?P<unit>{CURRENCY})\s*{HIGH}{END}")(_reading(_money, False)),
    rule(rf"{LEAD}(?P<unit>{CURRENCY})\s*{LOW}{TO}{HIGH}{END}")(_reading(_money, False)),
    *_shapes(_money, CURRENCY, NO_LETTER, "refp"),
]


def _percent(m: Match, around: Around, explicit: bool) -> str | None:
    frame = Frame(m, around, explicit)
    numbers, n = frame.numbers(m), W.whole(W.sign_of(m["high"])[1])
    return numbers and f"{m['lead']}{numbers} {W.agree(n, PERCENT) if frame.inside and n is not None else PERCENT.many}"


_in_money = passes(*_amounts)


def _ranges_of_money(text: str, options: Options) -> str:
    return _in_money(text, options) if may_have_money(text) else text


_percents = [
    *_shapes(_percent, "%", r"(?!\w)", "r"),
    rule(rf"{LEAD}від\s+{LOW}\s*%\s+до\s*{HIGH}\s*%(?!\w)")(_reading(_percent, True)),
    *_shapes(_percent, "%", r"(?!\w)", "fdp"),
]


@rule(rf"{BEFORE_RANGE}(?:§§|§)\s*(\d+){TO}(\d+)(?!\d)")
def _paragraphs(m: Match, around: Around) -> str:
    low, high = W.number(m[2]), W.number(m[3])
    return m[1] + (f"від {W.ordinal(low, 'gen')} до {W.ordinal(high, 'gen')} параграфа" if around.from_to else f"параграфи {W.cardinal(low)} {W.cardinal(high)}")


@rule(rf"{BEFORE_RANGE}(\d{{1,2}}){TO}(\d{{1,2}})\s+(класах|класів){NO_CYRILLIC}")
def _grades(m: Match, around: Around) -> str | None:
    before = preceding_word(around.before + m[1])
    governed = before in ("у", "в") if m[4] == "класах" else before == "учнів"
    return f"{m[1]}{year(m[2], 'pl')}–{year(m[3], 'pl')} {m[4]}" if governed and int(m[2]) and int(m[3]) else None


def _bare(m: Match, around: Around, explicit: bool) -> str | None:
    low, high = W.whole(m["low"]), W.whole(m["high"])
    # a year and a short number are a span of years
    if not explicit and len(m["low"]) == 4 and len(m["high"]) <= 2 and low is not None and 1000 <= low <= 2999:
        return None
    frame, after = Frame(m, around, explicit), m.string[m.end() : m.end() + 7]
    if frame.word in ("в", "у") and after == " класах" and low is not None and high is not None:
        return f"{m['lead']}{W.cased(low, 'prep')}–{W.cased(high, 'prep')}"
    numbers = frame.numbers(m, "f" if frame.word in ("в", "у") and after.startswith(" лінії") else "m")
    return numbers and m["lead"] + numbers


@rule(rf"{LEAD}(Понад|понад)\s+{LOW}{TO}{HIGH}{END}")
def _over(m: Match) -> str | None:
    low, high = W.signed(m["low"]), W.signed(m["high"])
    return None if low is None or high is None else f"{m['lead']}{m[2]} {low} чи {high}"


_bares = [
    rule(rf"{LEAD}від\s+{LOW}\s+до\s+{HIGH}{END}{NOT_A_DATE}")(_reading(_bare, True)),
    rule(rf"{LEAD}від\s+{LOW}{TO}{HIGH}{END}")(_reading(_bare, True)),
    _over,
    rule(rf"{LEAD}{LOW}{TO}{HIGH}{END}{NOT_A_DATE}")(_reading(_bare, False)),
]

ranges = passes(
    *_temperatures, _years_in, _bare_years_in, _decades, _short_years_in, _short_years, _years, _times, _fractions, *_measures, _ranges_of_money, *_percents, _paragraphs, _grades, *_bares
)
