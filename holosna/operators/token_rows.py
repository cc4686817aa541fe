"""Tokens of a text as rows, by built-in functions: the same as ``segmentation.tokenize``, without Python.

One pattern cuts a text into atoms and blanks. Whether an atom joins the one before depends on at most three atoms before
and one behind, so windows over a text's atoms decide it; offsets are running sums of bytes. Atoms of a text are one key
of one exchange, by which tokens are put together as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holosna.operators.segmentation import DASHES, ENDINGS, EXTRA, KNOWN, SPACE, TOKEN_PUNCT, UK

LETTER = f"A-Za-z{UK}"


def _class(chars: str) -> str:
    """Characters for a Java character class."""
    return "".join(c if c.isalnum() else f"\\u{ord(c):04x}" for c in chars)


BLANK = _class(SPACE)
#: The marks that end an address don't belong to it.
ATOM = (
    f"№-?[{LETTER}0-9/-]+"
    f"|https?://(?:[^{BLANK}<>\"«»“”()\\[\\]{{}}]*[^{BLANK}<>\"«»“”()\\[\\]{{}}.,;:!?])?"
    f"|[@#][{LETTER}0-9_-]+"
    f"|[{LETTER}0-9][{LETTER}0-9_.-]*@(?=[{LETTER}0-9_-]*\\.)(?:[{LETTER}0-9_.-]*[{LETTER}0-9_-])?"
    f"|[{UK}]+(?:['’ʼ`][{UK}]+)*|[A-Za-z]+|[0-9]+|[^{BLANK}]"
)


def kind_of(atom: Column) -> Column:
    """other (an address, a tag, a numbered law, any other sign), uk, lat, int or punct."""
    more = F.length(atom) > 1
    web = more & (atom.rlike("^[№@#]") | F.contains(atom, F.lit("@")) | atom.rlike("^https?://"))
    return (
        F.when(web, "other").when(atom.rlike(f"^[{UK}]"), "uk").when(atom.rlike("^[A-Za-z]"), "lat").when(atom.rlike("^[0-9]"), "int")
        .when(atom.rlike(f"^[{_class(TOKEN_PUNCT)}]"), "punct").otherwise("other")
    )


def lowered(text: Column) -> Column:
    """ASCII and Ukrainian letters in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯҐЄІЇ"
    return F.translate(text, upper, upper.lower())


def _joins() -> Column:
    """Whether an atom (x, kind) joins the one before it, from the atoms beside: x1, x2, x3 before and y behind, with kinds."""

    def among(name: str, chars: str) -> Column:
        # a mark counts by its first character, which is all of it but for addresses
        return F.col(name).rlike(f"^[{_class(chars)}]")

    def beside(marks: str, fits) -> Column:
        left = F.col("x2").isNotNull() & among("x1", marks)
        twice = F.col("x2").isNotNull() & (F.substring("x1", 1, 1) == F.substring("x", 1, 1))
        return (left & fits("k2", "kind")) | (F.col("y").isNotNull() & among("x", marks) & ~twice & fits("k1", "ky"))

    no_punct = lambda a, b: F.coalesce((F.col(a) != "punct") & (F.col(b) != "punct"), F.lit(False))
    figures = lambda a, b: F.coalesce((F.col(a) == "int") & (F.col(b) == "int"), F.lit(False))
    eyes, mouth = "^[=:;]$", "^[()]$"
    smile = F.col("x").rlike(mouth) & (
        F.col("x1").rlike(eyes)
        | (F.col("x1").rlike(mouth) & (F.col("stop2") == F.col("start1")) & (F.col("x2").rlike(eyes) | (F.col("x2").rlike(mouth) & (F.col("stop3") == F.col("start2")) & F.col("x3").rlike(eyes))))
    )
    ends = among("x1", ENDINGS) & among("x", ENDINGS)
    marks = (F.col("k1") == "punct") & (F.col("kind") == "punct") & (smile | ends | ((F.col("x1") == F.col("x")) & F.col("x").isin("-", "*")))
    word = lambda k: F.col(k).isin("uk", "lat", "other")
    others = ((F.col("k1") == "other") | (F.col("kind") == "other")) & word("k1") & word("kind")
    unit = (F.col("k1") == "int") & F.col("kind").isin("uk", "lat") & lowered(F.col("x")).isin(*sorted(KNOWN))
    yahoo = (F.col("x") == "!") & (lowered(F.col("x1")) == "yahoo")
    fit = beside(DASHES + "_", no_punct) | beside(".,/\\", figures) | marks | others | unit | yahoo
    return (F.col("stop1") == F.col("start")) & F.coalesce(fit, F.lit(False))


def token_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, place (from 0), start, stop (offsets in the UTF-8 text) and piece of every token of text.

    keys tell rows apart; rows that share them must not differ in text, or their atoms run into each other. Null and
    empty texts have no tokens. A very long text is sorted in one task, which spills, and read as a stream there.
    """
    atoms = df.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(f"[{BLANK}]+|{ATOM}"), F.lit(0))).alias("at", "x"))
    w = Window.partitionBy(*keys).orderBy("at")
    size = F.octet_length("x").cast("long")
    atoms = atoms.withColumn("stop", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - size)
    atoms = atoms.where(~F.col("x").rlike(f"^[{BLANK}]")).withColumn("kind", kind_of(F.col("x")))
    before = [F.lag(c, n).over(w).alias(f"{new}{n}") for n in (1, 2, 3) for c, new in (("x", "x"), ("kind", "k"), ("start", "start"), ("stop", "stop"))]
    seen = atoms.select("*", *before, F.lead("x").over(w).alias("y"), F.lead("kind").over(w).alias("ky"))
    cut = seen.select(*keys, "at", "x", "start", "stop", F.when(_joins(), 0).otherwise(1).alias("first"))
    numbered = cut.withColumn("place", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]), "")
    whole = numbered.groupBy(*keys, "place").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), pieces.alias("piece"))
    return whole.select(*keys, F.col("place").cast("int").alias("place"), "start", "stop", "piece")
