"""Which texts the normalisation kernel has work on, as native predicates, and the reading of the others without it.

A text is *plain* if it is made of letters, blanks, line breaks and a few signs, with no figure, no point inside a word,
no abbreviation, acronym or word of the lexicons and vocabulary, no run of Roman digits or of Cyrillic capitals, and no
word of two scripts. Of the passes only four can change such a text: quotes, runs of Latin capitals, transliteration and
blanks; built-in functions express these, so plain rows never leave the JVM. The plan is two branches over one scan's
rows, joined by union: order of rows isn't kept.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holosna.functions import letters, structural, typed
from holosna.functions import tables as T
from holosna.normal.lexicon import CURRENCY
from holosna.operators.normalization import exploded_spans, normalized, normalized_by, options_of
from holosna.operators.segmentation import exploded_rows
from holosna.options import Options

#: Signs that no pass reads where no digit, Cyrillic letter or point inside a word stands beside them.
SIGNS = " \n\t,.!?;()\"'«»"
_EDGE = "[0-9A-Za-z_]"


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def any_word(words: Iterable[str]) -> str:
    """A pattern of any of the words between word bounds of ASCII, tried by their first letter."""
    by_first = defaultdict(list)
    for w in sorted(set(words), key=len, reverse=True):
        by_first[w[0].lower()].append(_escaped(w.lower()[1:]))
    each = (f"{_escaped(first)}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    return f"(?i)(?<!{_EDGE})(?:{'|'.join(each)})(?!{_EDGE})"


def triggers(options: Options) -> list[str]:
    """Patterns (Java's) of which a plain text holds none; the dearest last."""
    from holosna.normal.letters import abbreviation_patterns
    from holosna.normal.lexicon import ACRONYMS, LATIN_WORDS
    from holosna.normal.rules import LETTERS

    letter, word = f"[{LETTERS}]", f"[{LETTERS}A-Za-z0-9]"
    roman = f"(?<!{_EDGE})[MDCLXVI]{{2,}}(?!{_EDGE})"
    scripts = f"[A-Za-z]['’–-]*{letter}|{letter}['’–-]*[A-Za-z]"
    # one pattern each: alternatives beside a class would be tried at every character
    # listed one by one, characters below 256 are looked up in a bitmap; only others are held against the whole class
    short = string.ascii_letters + "".join(c for c in T.DIACRITICS if c < "\u0100") + "".join(c for c in SIGNS if c.isspace())
    signs = _signs().replace(" ", "").replace("\\n", "").replace("\\t", "")
    out = [f"[^{short}{signs}](?<=[^{LETTERS}A-Za-z{''.join(T.DIACRITICS)}{_signs()}])", r"\.[^ \n\t,.!?;()\"'«»]", roman]
    if options.normalize_english_words:
        out.append(any_word({*LATIN_WORDS, *options.vocabulary}))
    known = "|".join(map(_escaped, ACRONYMS))
    return [*out, f"{scripts}|[А-ЯЄІЇҐ]{{2}}|(?<!{letter})(?:{known})(?!{word})|{'|'.join(abbreviation_patterns())}"]


def plain(text: Column, options: Options | str | None = None) -> Column:
    """Whether ``plain_reading`` reads a text as the kernel would. A null text is plain."""
    found = [text.rlike(p) for p in triggers(options_of(options))]
    # mixed words, abbreviations and acronyms have Cyrillic letters, and Roman digits count beside these: a text without any is done
    *first, last = found
    held = text.rlike("[А-Яа-яЄєІіЇїҐґ]") & (text.rlike("[MDCLXVI]") | last)
    for f in reversed(first):
        held = f | held
    return text.isNull() | ~held


def _signs() -> str:
    return "".join("\\" + c if c in "\"'().?!;," else {"\n": "\\n", "\t": "\\t"}.get(c, c) for c in SIGNS)


def plain_reading(text: Column, options: Options | str | None = None) -> Column:
    """The normalisation of a plain text: quotes, runs of capitals by letter names, transliteration, blanks."""
    chosen, names = options_of(options), letters._map(T.LATIN_LETTER_NAMES)
    out = text if chosen.quote_style == "keep" else structural.unicode_forms(text, chosen.quote_style)
    if chosen.normalize_english_words:
        spelled = lambda run: F.array_join(F.transform(F.split(run, "(?<=.)(?=.)"), lambda c: F.try_element_at(names, c)), " ")
        run = f"(?<!{_EDGE})[A-Z]+(?!{_EDGE})"
        out = F.when(out.rlike(run), letters.replaced(out, run, spelled)).otherwise(out)
    if chosen.transliterate_latin:
        out = letters.transliterated(out)
    return structural.output_spacing(letters.trimmed(out))


#: What the detectors know besides words, of texts without figures and Cyrillic letters.
_FLAGGED = rf"\.[^ \n\t,.!?;()\"'«»]|(?<!{_EDGE})[MDCLXVI]{{2,}}(?!{_EDGE})|(?i)(?<!{_EDGE})(?:isbn|issn|vin|swift|bic|www)(?!{_EDGE})|[a-f]{{32}}"


def words_only(text: Column) -> Column:
    """Whether of the detectors only that of foreign words can find something in a text. A null text is such."""
    return text.isNull() | ~text.rlike(f"[^A-Za-z{''.join(T.DIACRITICS)}{_signs()}]|{_FLAGGED}")


def foreign_words(text: str | None, known: frozenset[bytes]) -> list[tuple[int, int, str]]:
    """Start, stop (UTF-8 bytes) and text of the words of Latin letters that aren't known (in lower case) nor runs of two to six capitals."""
    found = (m for m in re.finditer(rb"[A-Za-z][A-Za-z']*|'[A-Za-z']*", (text or "").encode()) if m[0][:1] != b"'")
    return [(m.start(), m.end(), m[0].decode()) for m in found if m[0].lower() not in known and not re.fullmatch(rb"[A-Z]{2,6}", m[0])]


def uncertain_rows(df: DataFrame, text: str, *keys: str, options: Options | str | None = None) -> DataFrame:
    """keys and the uncertain spans of text, a row each: those of texts of Latin words alone by one search for words, the rest by the kernel.

    Words are found where their text lies, by their bytes, so none are shuffled or sorted for their offsets. Equal to ``exploded_spans`` of the keys. keys tell rows apart; rows that share them must have equal texts.
    """
    from holosna.normal.lexicon import LATIN_WORDS

    only, df = words_only(F.col(text)), spread(df.select(*keys, text))
    known = frozenset(k.encode() for k in {*LATIN_WORDS, *(() if options is None else options_of(options).vocabulary)})
    words = exploded_rows(df.where(only), text, lambda t: foreign_words(t, known)).withColumnRenamed("piece", "match")
    said = [F.lit(v).alias(k) for k, v in (("reason", "foreign word (transliteration is approximate)"), ("category", "foreign_word"), ("severity", "info"))]
    others = exploded_spans(df.where(~only).select(*keys, F.col(text).alias("text")), "text", options)
    return words.select(*keys, "start", "stop", F.col("match").alias("text"), *said).unionByName(others)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where a scan has fewer splits than the session has cores: the kernel's time a row is far above a shuffle's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def normalized_rows(df: DataFrame, text: str, out: str, options: Options | str | None = None) -> DataFrame:
    """df with column out, the reading of text: plain rows by built-in functions, the rest by the kernel.

    Equal to ``normalized`` over all rows. Null gives null, an empty text itself; texts are read whole, however long.
    A column of df that is named out is replaced.
    """
    is_plain, df = plain(F.col(text), options), spread(df)
    others = df.where(~is_plain).withColumn(out, normalized(F.col(text), options))
    return df.where(is_plain).withColumn(out, plain_reading(F.col(text), options)).unionByName(others)


#: Amounts that the kernel reads by their figures alone: of two decimals and under a thousand millions (longer ones may be
#: telephone numbers), but not those of 802, which with a point name standards.
AMOUNT = r"\A(?!802\.)(?:0|[1-9][0-9]{0,8})\.[0-9]{2}\z"


def amount_rows(df: DataFrame, amount: str, before: str, written: dict[str, tuple[Column, str]]) -> DataFrame:
    """df with a column for each currency of written, the reading of an amount after the word before: plain amounts by built-in functions, the rest by the kernel.

    written: the text to be read, made of a column named value, and the currency's code, by the columns to be made. amount
    is a column of texts. before is a word that no pass reads, which ends in a blank. Equal to ``normalized`` of all
    texts, under the defaults. Time grows with the rows, however many amounts differ; of amounts that aren't plain each
    is read once. Order of rows isn't kept.
    """
    df = spread(df)
    is_plain = F.coalesce(F.col(amount).rlike(AMOUNT), F.lit(False))
    whole, cents = F.substring_index(amount, ".", 1).cast("long"), F.substring_index(amount, ".", -1).cast("int")
    parts = df.where(is_plain).withColumns({"__whole": whole, "__cents": cents})
    said = parts.withColumns({k: F.concat(F.lit(before), typed.cents_words(F.col("__whole"), F.col("__cents"), CURRENCY[code])) for k, (_, code) in written.items()})
    others = normalized_by(df.where(~is_plain), F.col(amount), {k: text for k, (text, _) in written.items()})
    return said.drop("__whole", "__cents").unionByName(others)
