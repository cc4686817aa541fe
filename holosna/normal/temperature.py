"""Temperature scales and quantities on them."""

from __future__ import annotations

from typing import NamedTuple

from holosna.normal import rx
from holosna.normal import words as W
from holosna.normal.lexicon import Unit

# --- fixed values: how scales are written (stems; whole tokens; endings after град), in the order of trial, and read --------
DEGREE, KELVIN = Unit("градус", "градуси", "градусів", "градуса"), Unit("кельвін", "кельвіни", "кельвінів", "кельвіна")
WRITTEN = [
    ("", ["кельв"], ["k", "к", "\u212a", "°k", "°к"], ["k", "к"]),
    ("Реомюра", ["реомюр"], ["°re", "°ré", "°rÉ"], ["re", "ré", "rÉ"]),
    ("Деліля", ["деліл"], ["°de"], ["de"]),
    ("Ньютона", ["ньютон"], ["°n"], []),
    ("Ремера", ["ремер"], ["°rø", "°rØ", "°rō", "°rŌ"], ["rø", "rØ", "rō", "rŌ"]),
    ("Ранкіна", ["ранкін"], ["°r", "°ra"], ["r", "ra"]),
    ("Фаренгейта", ["фаренгейт"], ["f", "°f", "℉"], ["f"]),
    ("Цельсія", ["цельс", "celsius"], ["c", "с", "°c", "°с", "℃"], ["c", "с"]),
]
_DEGREE_SIGN = r"(?:°\s*(?:Celsius|celsius|Fahrenheit|fahrenheit|C|c|С|с|F|f|N|n|D(?:e|E)|d[eE]|R(?:a|A|e|E|é|É|ø|Ø|ō|Ō)?|r(?:a|e|é|ø|ō)?)|℃|℉)"
_KELVIN_SIGN = "(?:K|\u041a|\u212a|°\\s*(?:K|k|\u041a|\u043a))"
_DEGREES = r"(?:град\.?|Град\.?|ГРАД\.?|градус(?:а|и|ів)?|Градус(?:а|и|ів)?|ГРАДУС(?:А|И|ІВ)?)"
_OF_SCALE = (
    r"(?:C|c|С|с|F|f|R|r|Ra|ra|Re|re|Ré|ré|De|de|Rø|rø|Rō|rō|Цельсія|цельсія|ЦЕЛЬСІЯ|Фаренгейта|фаренгейта|ФАРЕНГЕЙТА|Ранкіна|ранкіна|РАНКІНА|Реомюра|реомюра|РЕОМЮРА"
    r"|Деліля|деліля|ДЕЛІЛЯ|Ньютона|ньютона|НЬЮТОНА|Ремера|ремера|РЕМЕРА|за\s+(?:Цельсієм|цельсієм|ЦЕЛЬСІЄМ|Фаренгейтом|фаренгейтом|ФАРЕНГЕЙТОМ|Ранкіном|ранкіном|РАНКІНОМ"
    r"|Реомюром|реомюром|РЕОМЮРОМ|Делілем|делілем|ДЕЛІЛЕМ|Ньютоном|ньютоном|НЬЮТОНОМ|Ремером|ремером|РЕМЕРОМ))"
)
_KELVIN_NAME = r"(?:кельвін(?:а|и|ів)?|Кельвін(?:а|и|ів)?|КЕЛЬВІН(?:А|И|ІВ)?)"
_OF_KELVIN = "(?:K|k|\u041a|\u043a|\u212a|Кельвіна|кельвіна|КЕЛЬВІНА|за\\s+(?:Кельвіном|кельвіном|КЕЛЬВІНОМ))"
SCALE = rf"(?:{_DEGREE_SIGN}|(?:C|c|С|с|F|f)(?!\.)|{_KELVIN_NAME}|{_KELVIN_SIGN}|{_DEGREES}\s+(?:{_OF_SCALE}|{_OF_KELVIN}))"
# --------------------------------------------------------------------------------------------------------------------------------


class Scale(NamedTuple):
    name: str
    unit: Unit

    @property
    def of(self) -> str:
        return self.name and " " + self.name


def scale(token: str) -> Scale | None:
    low = W.lower(token)
    tight = rx.sub(r"\s", "", low)
    for name, stems, tokens, endings in WRITTEN:
        if any(s in low for s in stems) or tight in tokens or ("град" in low and tight.endswith(tuple(endings))):
            return Scale(name, DEGREE if name else KELVIN)
    return None


def spoken(token: str, on: Scale, case: str = "") -> str | None:
    """A quantity on a scale; None if its number can't be read."""
    words = W.signed(token, case)
    if words is None:
        return None
    if "." in token or "," in token:
        return f"{words} {on.unit.decimal}{on.of}"
    n = W.whole(W.sign_of(token)[1])
    return None if n is None else f"{words} {on.unit.many if case == 'gen' else W.agree(n, on.unit)}{on.of}"


def range_unit(upper: str, on: Scale) -> str:
    """The unit after a range that ends in upper."""
    n = W.whole(W.sign_of(upper)[1])
    return on.unit.decimal if rx.search("[.,]", upper) or (n is not None and W.is_one(n)) else on.unit.many
