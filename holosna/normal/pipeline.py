"""The whole normalisation of a text: what is protected, and which passes run over it in which order."""

from __future__ import annotations

from holosna.functions.structural import VARIABLES
from holosna.normal import rx
from holosna.normal import context, dates, identifiers, letters, money, numerals, ordinals, quantities, ranges, shape
from holosna.normal import words as W
from holosna.normal.protection import Kept, protected
from holosna.normal.quantities import VULGAR
from holosna.normal.rules import LETTERS, Match, has, pattern, rule
from holosna.normal.stretches import by_stretches
from holosna.options import Options

# --- fixed values: what tells that a pass may have work ------------------------------------------------------------------------
WEB = ("http://", "https://", "ftp://", "www.", ".com", ".ua", ".org", ".net", ".info", ".io", ".edu", ".gov", ".укр")
MEDICAL = ("/", "°", "№", "℃", "℉", "\u212a", "мм рт", "раз", "тиск", "градус", "град.", "K", "К", "кельвін")
SCALES = ("тис", "млн", "млрд", "трлн")
SIGNS = (
    "°", "℃", "℉", "\u212a", "±", "≈", "≠", "≤", "≥", "×", "÷", "=", "<", ">", "‰", "§", "₿", "•", "·", "~", "&", "#", "_", "²", "³", "№",
)
LINES = "480|576|720|1080|1440|2160|4320"
# --------------------------------------------------------------------------------------------------------------------------------

_GROUPED = pattern(r"[1-9]\d{0,2}(?:,\d{3}|\.\d{3})+[.,]\d")
_GROUPED_MONEY = pattern(rf"(?:{money.CURRENCY})\s*[1-9]\d{{0,2}}(?:(?:,\d{{3}})+\.\d{{1,4}}|(?:\.\d{{3}})+,\d{{1,4}})", fold=True)


@rule(rf"(^|[^A-Za-z0-9{LETTERS}])({LINES})[pP](?:-(якістю|якість)|(?![A-Za-z0-9]))")
def resolutions(m: Match) -> str:
    return m[1] + (f"{m[3]} " if m[3] else "") + f"{W.cardinal(int(m[2]))} пі"


def _digit(text: str) -> bool:
    return rx.search("[0-9]", text) is not None


def _latin(text: str) -> bool:
    return rx.search("[A-Za-z]", text) is not None


def _roman(text: str) -> bool:
    return rx.search("[MDCLXVI]", text) is not None


def normalized(text: str, options: Options = Options()) -> str:
    """The text as it is read aloud under the options."""
    figures = _digit(text)
    cut = by_stretches(text, options, lambda piece: _read(piece, options, figures))
    return _read(text, options, figures) if cut is None else cut


def _read(text: str, options: Options, figures: bool) -> str:
    """All passes over a text, or over a piece of one that has figures somewhere."""
    kept = Kept()
    text = shape.typography(shape.unicode_forms(protected(text, options, kept), options.quote_style))
    for sign, spoken in VARIABLES.items():
        text = text.replace(sign, spoken)
    if has(text, "$", "¥"):
        text = money.regional(text)
    if "==" in text:
        text = shape.headings(text)
    if options.normalize_network_addresses and has(text, ".", ":", "-"):
        text = identifiers.network(text)
    if _digit(text):
        text = ordinals.pages(text, options)
        if options.normalize_english_words and _latin(text):  # before a Latin p is taken for a Cyrillic letter
            text = resolutions(text)
    if options.repair_homoglyphs and _latin(text):
        text = shape.homoglyphs(text)
    if has(text, "@", "#", *WEB) or ("." in text and _latin(text)):
        text = shape.web(text)
    if has(text, "кв.", "квартал") or _roman(text):
        text = ordinals.quarters(text)
    if "." in text:
        text = shape.addresses(text)
    text = letters.abbreviations(text)
    if money.may_have_tickers(text):
        text = money.known_finance(text)
    if figures or _digit(text):
        text = _with_digits(text, options)
    elif _roman(text) or has(text, "ХХ", "ХІ", "ІХ"):
        text = ordinals.ordinals(text)
    if not _digit(text) and has(text, *VULGAR):
        text = quantities.fractions(text)
    if _digit(text) and money.may_have_money(text):
        text = numerals.precise_money(money.currency(text))
    if "/" in text or _digit(text):
        text = money.finance(text)
    if options.expand_known_acronyms:
        text = money.acronyms(text)
    if options.spell_unknown_acronyms:
        text = letters.acronyms(text)
    if options.symbol_style == "expand":
        if "+" in text and _digit(text):
            text = numerals.sums(text)
        if has(text, *SIGNS):
            text = shape.symbols(text)
    if _digit(text):
        text = _rest_of_digits(text, options)
    if _latin(text) and _digit(text):
        text = letters.technical(text)
    if options.normalize_english_words and _latin(text):
        text = letters.english(text, options.vocabulary)
    if options.transliterate_latin:
        text = letters.transliterated(text)
    return kept.restore(shape.output_spacing(shape.trimmed(text)))


def _with_digits(text: str, options: Options) -> str:
    """The passes on texts with figures, each before those that would read its matches otherwise."""
    if _GROUPED.search(text) and _GROUPED_MONEY.search(text):
        text = money.currency(text)
    text = shape.number_groups(text, options.parse_thousand_separators)
    text = letters.cyrillic_tokens(identifiers.identifiers(text))
    text = numerals.scientific(shape.phones(text, options.phone_style), options)
    for step in (dates.dates, ordinals.section_ranges, ranges.ranges):
        text = step(text, options)
    text = identifiers.coordinates(dates.discourse(text))
    if has(text, *MEDICAL):
        text = numerals.medical(text)
    text = context.counted_context(text)
    if "%" in text:
        text = quantities.percent(text)
    if has(text, *SCALES):
        text = numerals.governed_multipliers(text)
    text = context.cases(text)
    if "." in text or _roman(text):
        text = shape.sections(text)
    if has(text, ":", "-", "–", "—"):
        text = quantities.time(text, options)
    text = context.ordinal_nouns(context.counted_nouns(text))
    if has(text, "-", "–", "—"):
        text = context.compounds(text)
    text = ordinals.ordinals(text)
    if has(text, "/", *VULGAR):
        text = quantities.fractions(text)
    if money.may_have_money(text):
        text = money.multiplied(text)
    if has(text, *SCALES):
        text = numerals.multipliers(text)
    return quantities.measurements(text)


def _rest_of_digits(text: str, options: Options) -> str:
    if "." in text:
        text = numerals.versions(text)
    if has(text, ",", "."):
        text = numerals.decimals(text)
    text = shape.phones(text, options.phone_style)
    if has(text, "-", "−"):
        text = numerals.negatives(text)
    return numerals.numbers(text)
