"""Passes on the shape of a text: characters, typography, look-alikes, web names, addresses, groups, sections, signs, phones."""

from __future__ import annotations

from holosna.functions.structural import APOSTROPHES, COMPOSED, LOOK_CYRILLIC, LOOK_LATIN, OPENING, QUOTES, SPACES, SYMBOLS
from holosna.normal import rx
from holosna.normal import words as W
from holosna.normal.checks import valid_roman
from holosna.normal.rules import LETTERS, Around, Match, pattern, passes, rule

# --- fixed values: spoken signs of web names, in the order of their replacement; words of addresses and sections --------------
WEB_SIGNS = {
    "@": "равлик", ".": "крапка", "/": "слеш", ":": "двокрапка", "-": "дефіс", "_": "підкреслення", "?": "знак питання", "=": "дорівнює", "&": "амперсанд", "#": "решітка", "+": "плюс",
}
ADDRESS = {
    "м": "місто", "с": "село", "смт": "селище міського типу", "вул": "вулиця", "просп": "проспект", "пр": "проспект", "пров": "провулок", "пл": "площа", "бул": "бульвар", "наб": "набережна",
    "буд": "будинок", "б": "будинок", "кв": "квартира", "оф": "офіс", "корп": "корпус", "під": "під'їзд", "пов": "поверх", "обл": "область", "р-н": "район",
}
SECTION = {"ст": "стаття", "ч": "частина", "пп": "підпункт", "п": "пункт", "абз": "абзац", "розд": "розділ", "гл": "глава", "табл": "таблиця", "рис": "рисунок"}
# --------------------------------------------------------------------------------------------------------------------------------

_LETTER = f"[{LETTERS}A-Za-z]"
_WORD = f"[{LETTERS}A-Za-z0-9]"
_ONE_FORM = str.maketrans("−－＋‐‑‒", "--+–––")
_STRAIGHT = str.maketrans(dict.fromkeys(QUOTES, '"'))
_GUILLEMETS = str.maketrans({c: "«" if c in OPENING else "»" for c in QUOTES})
_APOSTROPHE = pattern(f"(?<={_WORD})[{APOSTROPHES}](?={_WORD})|(?<={_LETTER})′(?={_LETTER})")
_SPLIT_QUOTE = pattern(f"(?<={_WORD})[{QUOTES}](?={_WORD})")
_POWER_MINUS = pattern(r"(?<=(?<!\d)10)−(?=\d)")
_KEPT_MINUS = "\uf8ff"  # stands for it meanwhile


def unicode_forms(text: str, quote_style: str = "keep") -> str:
    """Apostrophes, minus signs, dashes and quotes in one form each, й and ї composed. The minus of a tight 10−n stays."""
    if quote_style == "strip":
        text = rx.sub(f"[{QUOTES}]", "", _SPLIT_QUOTE.sub(" ", text))
    elif quote_style != "keep":
        text = text.translate(_STRAIGHT if quote_style == "straight" else _GUILLEMETS)
    text = _POWER_MINUS.sub(_KEPT_MINUS, _APOSTROPHE.sub("'", text)).translate(_ONE_FORM).replace(_KEPT_MINUS, "−")
    for apart, composed in COMPOSED.items():
        text = text.replace(apart, composed)
    return text


def _plain(text: str) -> str:
    text = text.translate(str.maketrans(SPACES, " " * len(SPACES)))
    text = rx.sub(r"(?<!\*)\*\*(?!\*)|(?<!_)__(?!_)", "", text)
    return text.replace("`", "").replace("’", "'")


@rule(r"[ \t]+(\.(?=\d|[.,;:!?]|$)|[,;:!?])")
def _punctuation(m: Match) -> str:
    return m[1]


@rule(r"(км|м|см³|см3|кбіт|Кбіт|мбіт|Мбіт|гбіт|Гбіт)[ \t]*/[ \t]*(год|с(?:²|2)?|c(?:²|2)?)(?![A-Za-z])")
def _unit_slash(m: Match) -> str:
    """A Latin c after the slash stands for the Cyrillic letter."""
    return f"{m[1]}/{m[2].replace('c', 'с', 1)}"


@rule(r"([A-Za-z])[ \t]*/[ \t]*([A-Za-z])")
def _letter_slash(m: Match) -> str:
    return f"{m[1]}/{m[2]}"


@rule(r"(\d)\s+(?:х|Х)\s+(\d)")
def _dimension(m: Match) -> str:
    return f"{m[1]} × {m[2]}"


typography = passes(_plain, _punctuation, _unit_slash, _letter_slash, _dimension)

_TO_CYRILLIC, _TO_LATIN = str.maketrans(LOOK_LATIN, LOOK_CYRILLIC), str.maketrans(LOOK_CYRILLIC, LOOK_LATIN)


_TWO_SCRIPTS = pattern(f"[A-Za-z]['’–-]*[{LETTERS}]|[{LETTERS}]['’–-]*[A-Za-z]")


@rule(f"[{LETTERS}A-Za-z'’–-]+")
def _look_alikes(m: Match) -> str | None:
    if not _TWO_SCRIPTS.search(m[0]):
        return None
    latin, cyrillic = rx.findall("[A-Za-z]", m[0]), rx.findall(f"[{LETTERS}]", m[0])
    few, alike, table = (latin, LOOK_LATIN, _TO_CYRILLIC) if len(cyrillic) >= len(latin) else (cyrillic, LOOK_CYRILLIC, _TO_LATIN)
    return m[0].translate(table) if set(few) <= set(alike) else None


def homoglyphs(text: str) -> str:
    """Words of both scripts in that of most of their letters (Cyrillic if even), if all others have look-alikes."""
    return _look_alikes(text) if _TWO_SCRIPTS.search(text) else text


def trimmed(text: str) -> str:
    return rx.sub(" {2,}", " ", text).strip(" ")


_UKRAINIAN_DOMAIN = pattern(r"\.(ua|укр)(?=$|[/?#])", fold=True)


def spelled_web(value: str) -> str:
    value = _UKRAINIAN_DOMAIN.sub(lambda m: " крапка ю ей " if W.lower(m[1]) == "ua" else " крапка укр ", value.rstrip(".,!?"))
    for sign, word in WEB_SIGNS.items():
        value = value.replace(sign, f" {word} ")
    return trimmed(value)


@rule(r"\bdoi\s*:\s*(10\.\d{4,9}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9])", fold=True)
def _doi(m: Match) -> str:
    return "ді оу ай " + spelled_web(m[1])


@rule(rf"(^|[^A-Za-z{LETTERS}0-9._%+\-])([A-Za-z{LETTERS}0-9._%+\-]+@[A-Za-z{LETTERS}0-9\-]+(?:\.[A-Za-z{LETTERS}0-9\-]+)+)")
def _email(m: Match) -> str:
    return m[1] + spelled_web(m[2])


@rule(rf"\b(?:(?:https?|ftp)://|www\.)\S+|\b(?:[A-Za-z{LETTERS}0-9-]+\.)+[A-Za-z{LETTERS}]{{2,63}}(?:[/?#]\S*)?", fold=True)
def _url(m: Match) -> str:
    return spelled_web(m[0])


@rule(rf"(^|[^A-Za-z{LETTERS}0-9])\.(ua|укр)(?![A-Za-z{LETTERS}0-9])", fold=True)
def _domain(m: Match) -> str:
    return m[1] + ("крапка ю ей" if W.lower(m[2]) == "ua" else "крапка укр")


@rule(rf"#([A-Za-z{LETTERS}0-9_]+)")
def _hashtag(m: Match) -> str:
    return "хештег " + m[1]


@rule(rf"(^|[^A-Za-z{LETTERS}0-9._%+-])@([A-Za-z][A-Za-z0-9_]{{1,30}})")
def _handle(m: Match) -> str:
    return f"{m[1]}акаунт {m[2]}"


web = passes(_doi, _email, _url, _domain, _hashtag, _handle)

_IN, _OF = pattern(r"(?:^|[\s(])(?:у|в)\s+$"), pattern(r"(?:^|[\s(])(?:від|до|з|із|зі|для)\s+$")


@rule(rf"((?:смт|просп|пров|корп|буд|вул|наб|бул|оф|кв|обл|під|пов|р-н|пр|пл|м|с|б(?!\.п)))\.(?=\s*[A-Za-z{LETTERS}0-9])", fold=True)
def addresses(m: Match) -> str | None:
    """Abbreviations of an address that begin a token; of town, village and block only before a name or a number."""
    key, before, after = W.lower(m[1]), W.lower(m.string[max(0, m.start() - 64) : m.start()]), m.string[m.end() : m.end() + 64].lstrip()
    if rx.search(f"[{LETTERS}A-Za-z0-9/]$", before):
        return None
    if key in ("м", "с", "корп") and not rx.match("[А-ЯЄІЇҐA-Z0-9]", after):
        return None
    if key == "м":
        if _IN.search(before):
            return "місті"
        if _OF.search(before) or rx.match(f"Києва(?![{LETTERS}])", after):
            return "міста"
    if key == "с" and before.endswith("вакуумі "):  # the speed of light at the end of a sentence
        return None
    return ADDRESS[key]


@rule(r"(^|[\s(\[{=:;])([+\-]?)([.,])(\d+)(?![\d.,])")
def _bare_decimal(m: Match) -> str:
    return f"{m[1]}{m[2]}0{m[3]}{m[4]}"


@rule(r"\b\d{1,3}(?: \d{3})+\b")
def _space_groups(m: Match) -> str:
    return m[0].replace(" ", "")


@rule(r"(^|[^\d.,])(\d{1,3}(?:,\d{3}){2,})(?!\d)")
def _comma_groups(m: Match) -> str:
    return m[0][: len(m[1])] + m[2].replace(",", "")


@rule(r"(^|[^\d.,])(\d{1,3}(?:\.\d{3}){2})(?!\.?\d)")
def _dot_groups(m: Match) -> str:
    return m[0][: len(m[1])] + m[2].replace(".", "")


def number_groups(text: str, thousand_separators: bool = True) -> str:
    text = _space_groups(_bare_decimal(text))
    return _dot_groups(_comma_groups(text)) if thousand_separators else text


_CENTURY = pattern(r"([MDCLXVI]{1,6})\s*$")


@rule(rf"(^|[^{LETTERS}A-Za-z])(ст|ч|пп|п|абз|розд|гл|табл|рис)\.\s*(?=\d|[MDCLXVI])", fold=True)
def sections(m: Match, around: Around) -> str | None:
    """Abbreviated parts of a document before a number; ``XX ст.`` is a century and stays."""
    key = W.lower(m[2])
    century = key == "ст" and _CENTURY.search(around.before)
    return None if (century and valid_roman(century[1])) or key not in SECTION else f"{m[1]}{SECTION[key]} "


def symbols(text: str) -> str:
    for sign, word in SYMBOLS.items():
        text = text.replace(sign, f" {word} ")
    return trimmed(text)


_EXTENSION = r"(?:\s*(?:доб\.?|дод\.?|ext\.?|x)\s*(\d{1,6}))?(?!\d)"
_PHONES = [
    pattern(r"(^|[^\d.,])((?:\+?380|00380|0)\s*\(?\d{2}\)?[\-\s]?\d{3}[\-\s]?\d{2}[\-\s]?\d{2})" + _EXTENSION),
    pattern(r"(^|[^\d.,])((?:\+|00)\d{1,3}(?:[\s().-]*\d{1,4}){2,})" + _EXTENSION, fold=True),
]


def phones(text: str, style: str = "grouped") -> str:
    """Ukrainian and international phone numbers, with extensions."""
    for p in _PHONES:
        text = p.sub(lambda m: m[1] + W.phone(m[2], style) + (f" додатковий {W.digit_by_digit(m[3])}" if m[3] else ""), text)
    return text


def headings(text: str) -> str:
    """Lines ``== heading ==`` of two to six marks, the same at both ends, as the heading alone."""

    def bare(line: str) -> str:
        m = rx.fullmatch(r"(?s)[ \t\r]*(={2,6})(?!=)[ \t]*([^ \t](?:.*[^ \t])?)[ \t]*(?<!=)\1[ \t\r]*", line)
        return m[2] if m else line

    return "\n".join(map(bare, text.split("\n")))


@rule(r"[ \t]+([,.;:!?])")
def output_spacing(m: Match) -> str:
    return m[1]
