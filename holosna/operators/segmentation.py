"""Sentences and tokens of Ukrainian text, with UTF-8 byte offsets.

The kernels are plain functions over one string, run on Arrow batches by pandas UDFs; sentences() and tokens() give
arrays of (start, stop, text), exploded() the relational form. All are stateless, so they serve streams as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose spans a worker holds at a time; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
SPANS = "array<struct<start:bigint,stop:bigint,text:string>>"

# --- fixed values: characters -------------------------------------------------------------------------------------
SPACE = " \t\n\r\x0c\x0b\xa0"
UK = "а-яА-ЯґҐєЄіІїЇ"
EXTRA = "ÅåğĞ\u0370-\u03ff"
DELIMITERS = ".?!…;\"„'»”’)]}"
ENDINGS = ".?!…"
DASHES = "‑–—−-"
GENERIC_QUOTES = "\"„'"
CLOSERS = "»”’)]}"
TOKEN_PUNCT = "\\/!#$%&*+,.:;<=>?@^_`|~№…‑–—−-«“‘»”’\"„'()[]{}"
# --- fixed values: abbreviations ----------------------------------------------------------------------------------
TRAILING = {
    "тис", "млн", "млрд", "грн", "коп", "проц", "га", "кг", "г", "т", "куб", "кв", "км", "м", "см", "мм", "л", "год", "хв", "сек", "ст", "р", "рр", "с", "к", "руб",
    "крб", "co", "corp", "inc", "ed", "al", "мон", "моз", "мвс", "сбу", "нбу", "дпс", "дбр", "набу", "назк", "ова", "ода", "рда", "кмда", "мкм", "нм", "квт", "мвт", "шт",
    "од", "екз", "вс", "оаск", "єрдр", "ecli",
}
LEADING = {
    "ст", "укр", "англ", "нім", "фр", "італ", "грец", "лат", "mr", "mrs", "ms", "dr", "vs", "св", "проф", "акад", "доц", "канд", "д-р", "ред", "гр", "ім", "тов", "п",
    "пп", "ч", "чч", "гл", "абз", "пт", "no", "просп", "пр", "вул", "ш", "м", "смт", "с", "обл", "р-н", "корп", "пер", "пл", "буд", "кв", "оф", "каб", "літ", "р", "а",
    "оз", "г", "напр", "дод", "юр", "фіз", "тел", "тобто", "див", "розд", "табл", "мал", "рис", "пор", "упоряд", "мкр", "наб", "пров", "шос", "бул", "деп", "пост",
    "наказ", "підп", "арк", "вип", "стор", "ухв", "ріш", "провадж", "спр", "поз", "позов", "відп", "заявн", "оск", "адмін", "крим", "цив", "госп", "док", "прим",
    "перекл", "вид", "т", "тт", "зб", "зош", "журн", "газ", "асист", "викл", "зав", "лаб", "інж", "н", "чл.-кор", "м-н", "ж/м", "в/ч", "остр", "річ", "станц", "залізн",
    "бл", "прибл", "зокр", "порівн", "підрозд", "тр", "скаржн", "кк", "кпк", "цк", "цпк", "гк", "гпк", "кас", "купап", "кзпп", "пку", "мку", "зку", "ску", "вс", "вп",
    "кцс", "кгс", "ккс", "оаск", "v", "єрдр", "ecli",
}
KNOWN = TRAILING | LEADING | {"скор", "рис", "винят", "прим", "заст", "жарт"}
INITIALS = {"дж", "ed"}
ALWAYS_PAIRS = {"т е", "т к", "т н", "и о", "к н", "к п", "п н", "к т", "л д", "і т", "ст ст", "а с"}
PAIRS = ALWAYS_PAIRS | {"т п", "т д", "у е", "н э", "p m", "a m", "с г", "р х", "с ш", "з д", "л с", "ч т", "ед ч", "мн ч", "повел накл"}

_LOWER = {ord(u): ord(u.lower()) for u in "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯҐЄІЇ"}
_LETTER = f"A-Za-z{UK}"
_PIECE = re.compile(f"[{_LETTER}_{EXTRA}]+|[0-9]+|[^{SPACE}]")
_SMILE = re.compile(r"[=:;]-?[()]{1,3}")
_CANDIDATE = re.compile(f"[=:;]-?[()]{{1,3}}|[{re.escape(DELIMITERS)}]")
_ALL_LETTERS = re.compile(f"[{_LETTER}{EXTRA}]+")
_COMPOUND = re.compile(f"([{_LETTER}_{EXTRA}0-9][{_LETTER}_{EXTRA}0-9./-]*)[{SPACE}]*\\Z")
_DOTTED = re.compile(f"([{_LETTER}_{EXTRA}0-9]+)[{SPACE}]*\\.[{SPACE}]*\\Z")
_PAIR = re.compile(f"([{_LETTER}_{EXTRA}0-9]+)[{SPACE}]*\\.[{SPACE}]*([{_LETTER}_{EXTRA}0-9]+)[{SPACE}]*\\Z")
_BULLET_RIGHT = re.compile(f"[{SPACE}]*[{_LETTER}]\\)(?:[{SPACE}]|\\Z)")
_HEADING = re.compile("[ \t]*==")
_WORD = re.compile(f"[{_LETTER}_{EXTRA}]+|[0-9]+")


def lowered(text: str) -> str:
    """ASCII and Ukrainian letters in lower case, others as they are."""
    return text.translate(_LOWER)


def _greek(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "\u0391" <= c <= "\u03a9" else {"Å": "å", "Ğ": "ğ"}.get(c, c) for c in lowered(text))


def is_lower_word(token: str) -> bool:
    return bool(_ALL_LETTERS.fullmatch(token)) and _greek(token) == token


def may_follow(token: str) -> bool:
    """Whether a sentence may go on with this token after an abbreviation's full stop: all but a capitalised word."""
    return not re.fullmatch(f"[{_LETTER}]+", token) or is_lower_word(token)


def is_bullet(token: str) -> bool:
    return token.isascii() and token.isdigit() or token in (".", ")") or lowered(token) in "§абвгдеabcdef" or not token.strip("IVXML")


@dataclass
class Boundary:
    """A candidate: up to ten characters on either side, the sentence so far if it is short, and whether its last line began a heading."""

    left: str
    mark: str
    right: str
    short: str
    heading: bool

    def __post_init__(self):
        self.before, self.after = _PIECE.findall(self.left), _PIECE.findall(self.right)

    @property
    def last(self) -> str:
        return self.before[-1]

    @property
    def next(self) -> str:
        return self.after[0]

    @property
    def abbreviation(self) -> str:
        """The last word, whole if it holds hyphens, stops or slashes, in lower case."""
        found = _COMPOUND.search(self.left)
        word = found[1] if found else ""
        while found and not re.match(f"[{_LETTER}_{EXTRA}0-9]", word):
            word = word[1:]
        return lowered(word if re.search("[-./]", found[1] if found else "") else self.last)


def _in_heading(b: Boundary) -> bool:
    return b.heading and b.right.lstrip(" \t\r\n").startswith("==")


def _new_line(b: Boundary) -> bool:
    return bool(re.match("[ \t]*[\r\n]", b.right))


def _measure(b: Boundary) -> bool:
    """``5 м.`` ends a sentence, where ``м.`` alone would go on to a name."""
    return b.mark == "." and b.abbreviation in ("м", "с") and len(b.before) > 1 and b.before[-2].isdigit()


def _numbers(b: Boundary) -> bool:
    return b.mark == "." and re.fullmatch("[0-9]+", b.last) is not None and re.fullmatch("[0-9]+", b.next) is not None


def _abbreviated(b: Boundary) -> bool:
    if b.mark != ".":
        return False
    dotted, pair, own = _DOTTED.search(b.left), _PAIR.search(b.left), b.abbreviation
    if dotted and lowered(dotted[1]) in KNOWN and may_follow(b.next):
        return True
    both = lowered(f"{pair[1]} {pair[2]}") if pair else ""
    if both in ALWAYS_PAIRS or both in PAIRS and may_follow(b.next):
        return True
    if both not in PAIRS:
        leads = re.fullmatch("[0-9]+|[IVXLCDM]+", b.next) is not None if own == "ст" else own in LEADING
        if leads or own in KNOWN and may_follow(b.next) or lowered(f"{own} {b.next}") in PAIRS:
            return True
    return own in INITIALS or len(b.last) == 1 and bool(_ALL_LETTERS.fullmatch(b.last)) and _greek(b.last) != b.last


def _list_item(b: Boundary) -> bool:
    pieces = _PIECE.findall(b.short) if b.mark in (".", ")") and len(b.short.encode()) <= 20 else []
    return bool(pieces) and all(map(is_bullet, pieces))


def _inner_close(b: Boundary) -> bool:
    """A quote or bracket closes inside a sentence, unless an ending stands before it."""
    if b.mark[0] not in CLOSERS + GENERIC_QUOTES:
        return False
    return b.last[0] not in ENDINGS or b.mark[0] in GENERIC_QUOTES and b.left[-1:] in SPACE and b.left != ""


def _dash(b: Boundary) -> bool:
    word = _WORD.search(b.right)
    return b.next[0] in DASHES and word is not None and is_lower_word(word[0])


def _more_marks(b: Boundary) -> bool:
    return b.next[0] not in GENERIC_QUOTES and (b.next[0] in DELIMITERS or _SMILE.match(b.right.lstrip(SPACE)) is not None)


#: In order: the first rule that holds says whether the sentence ends here; if none does, it ends.
RULES: list[tuple[Callable[[Boundary], bool], bool]] = [
    (lambda b: not b.before or not b.after or b.right[0] not in SPACE, False),
    (_in_heading, False),
    (_new_line, True),
    (lambda b: _BULLET_RIGHT.match(b.right) is not None, True),
    (lambda b: is_lower_word(b.next), False),
    (_more_marks, False),
    (_measure, True),
    (_numbers, False),
    (_abbreviated, False),
    (_list_item, False),
    (_inner_close, False),
    (_dash, False),
]


def ends(b: Boundary) -> bool:
    return next((end for rule, end in RULES if rule(b)), True)


def sentence_cuts(text: str) -> Iterator[tuple[int, int]]:
    """Character spans of sentences, trimmed; blank ones are left out."""
    begin = line = seen = 0
    for m in _CANDIDATE.finditer(text):
        at, to = m.span()
        # the last line break before the candidate; each part of the text is looked through once
        line, seen = max(line, text.rfind("\n", seen, at) + 1, text.rfind("\r", seen, at) + 1), at
        heading = _HEADING.match(text, max(line, begin), at) is not None
        if ends(Boundary(text[max(0, at - 10) : at], m[0], text[to : to + 10], text[begin:at] if at - begin <= 20 else "", heading)):
            yield begin, to
            begin = to
    yield begin, len(text)


# ---- tokens ------------------------------------------------------------------------------------------------------

_ATOM = re.compile(
    f"(?P<legal>№-?[{_LETTER}0-9/-]+)"
    f"|(?P<url>https?://[^{SPACE}<>\"«»“”()\\[\\]{{}}]*)"
    f"|(?P<tag>[@#][{_LETTER}0-9_-]+)"
    f"|(?P<mail>[{_LETTER}0-9][{_LETTER}0-9_.-]*@[{_LETTER}0-9_-]*\\.[{_LETTER}0-9_.-]*)"
    f"|(?P<uk>[{UK}](?:[{UK}]|['’ʼ`](?=[{UK}])(?<=[{UK}].))*)"
    f"|(?P<lat>[A-Za-z]+)|(?P<int>[0-9]+)|(?P<punct>[{re.escape(TOKEN_PUNCT)}])|(?P<other>[^{SPACE}])"
)
_WEB = ("legal", "url", "tag", "mail")


@dataclass
class Atom:
    start: int
    stop: int
    kind: str
    text: str


def atoms(text: str) -> list[Atom]:
    out, at = [], 0
    while m := _ATOM.search(text, at):
        found = m[0].rstrip(".,;:!?") if m.lastgroup in ("url", "mail") else m[0]
        at = m.start() + len(found)
        out.append(Atom(m.start(), at, "other" if m.lastgroup in _WEB else m.lastgroup, found))
    return out


def _beside(marks: str, fits: Callable[[Atom, Atom], bool], l2: Atom | None, l1: Atom, r1: Atom, r2: Atom | None) -> bool:
    """Whether the atoms around a mark of the set, which is the left or the right atom, fit together."""
    if l2 and l1.text[0] in marks and fits(l2, r1):
        return True
    return bool(r2 and r1.text[0] in marks and not (l2 and l1.text[0] == r1.text[0]) and fits(l1, r2))


def joined(l2: Atom | None, l1: Atom, r1: Atom, r2: Atom | None, token: str) -> bool:
    words = ("uk", "lat", "other")
    return (
        _beside("‑–—−-_", lambda a, b: "punct" not in (a.kind, b.kind), l2, l1, r1, r2)
        or _beside(".,/\\", lambda a, b: a.kind == b.kind == "int", l2, l1, r1, r2)
        or l1.kind == r1.kind == "punct"
        and (_SMILE.fullmatch(token + r1.text) is not None or l1.text in ENDINGS and r1.text in ENDINGS or l1.text == r1.text and l1.text in "-*")
        or "other" in (l1.kind, r1.kind)
        and l1.kind in words
        and r1.kind in words
        or l1.kind == "int"
        and r1.kind in ("uk", "lat")
        and lowered(r1.text) in KNOWN
        or r1.text == "!"
        and lowered(l1.text) == "yahoo"
    )


def token_cuts(text: str) -> Iterator[tuple[int, int]]:
    all_ = atoms(text)
    if not all_:
        return
    start, stop = all_[0].start, all_[0].stop
    for i in range(1, len(all_)):
        l1, r1 = all_[i - 1], all_[i]
        if l1.stop == r1.start and joined(all_[i - 2] if i > 1 else None, l1, r1, all_[i + 1] if i + 1 < len(all_) else None, text[start:stop]):
            stop = r1.stop
        else:
            yield start, stop
            start, stop = r1.start, r1.stop
    yield start, stop


def spans(text: str | None, cuts: Callable[[str], Iterator[tuple[int, int]]], trim: bool) -> list[dict] | None:
    """Byte spans of the cuts in order; null for null."""
    if text is None:
        return None
    out, chars, octets = [], 0, 0
    for a, b in cuts(text):
        if trim:
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip(SPACE)), b - len(piece) + len(piece.rstrip(SPACE))
        if a < b:
            octets += len(text[chars:a].encode())
            size = len(text[a:b].encode())
            out.append({"start": octets, "stop": octets + size, "text": text[a:b]})
            chars, octets = b, octets + size
    return out


def split_sentences(text: str | None) -> list[dict] | None:
    return spans(text, sentence_cuts, True)


def tokenize(text: str | None) -> list[dict] | None:
    return spans(text, token_cuts, False)


def sentences(text: Column) -> Column:
    return _udf(split_sentences)(text)


def tokens(text: Column) -> Column:
    return _udf(tokenize)(text)


def _udf(f: Callable[[str | None], list[dict] | None]):
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in column], dtype=object)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, SPANS)


def exploded(df: DataFrame, spans_of: Column, name: str = "place") -> DataFrame:
    """A row per span: its place from 0, start, stop and text, beside df's columns."""
    return df.select("*", F.posexplode(spans_of).alias(name, "span")).select(*df.columns, name, F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), F.col("span.text").alias("piece"))


def exploded_rows(df: DataFrame, text: str, f: Callable[[str | None], list[dict] | None], name: str = "place") -> DataFrame:
    """As ``exploded`` over a kernel of texts, without the column text: a worker holds the spans of a step of bounded bytes, not those of a batch of rows."""
    import pyarrow as pa

    from holosna.llm.common import bounded, steps

    keys = [c for c in df.columns if c != text]
    given = df.select(*keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text, STEP_BYTES):
                of, spans = [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    found = f(t) or []
                    of += [i] * len(found)
                    spans += [(at, *(s.values() if isinstance(s, dict) else s)) for at, s in enumerate(found)]
                own = [part.column(k).take(pa.array(of, pa.int64())) for k in keys]
                place, start, stop, piece = zip(*spans, strict=True) if spans else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([*own, pa.array(place, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(piece, pa.string())], names=[*keys, name, "start", "stop", "piece"])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in given.schema.fields[:-1])
    return bounded(given).mapInArrow(run, f"{schema}, `{name}` int, start long, stop long, piece string")
