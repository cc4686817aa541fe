"""Normalisation and uncertainty over columns: Arrow kernels, stateless, so they serve batches and streams alike.

The passes depend on what stands around a match and run one after another over a text, which built-in functions can't
express. A kernel reads each distinct text of a batch once. Null gives null, an empty text itself; other columns are
not touched; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from holosna.operators import segmentation
from holosna.options import Options

SPANS = "array<struct<start:long,stop:long,text:string,reason:string,category:string,severity:string>>"


def options_of(options: Options | str | None) -> Options:
    """Options, those of a preset by its name, or the defaults."""
    return Options() if options is None else Options.preset(options) if isinstance(options, str) else options


def _each(texts: pd.Series, f: Callable) -> pd.Series:
    """f of every text that isn't null, called once for equal ones."""
    known = {t: f(t) for t in texts.dropna().unique()}
    return pd.Series([known[t] if isinstance(t, str) else None for t in texts], dtype=object)


def normalized(text: Column, options: Options | str | None = None) -> Column:
    """The text as it is read aloud, under options or a named preset."""
    chosen = options_of(options)

    @pandas_udf("string")
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from holosna.normal.pipeline import normalized as read

        for texts in batches:
            yield _each(texts, lambda t: read(t, chosen))

    return normalize(text)


def uncertain(text: Column, options: Options | str | None = None) -> Column:
    """Spans of a text whose reading is uncertain, by UTF-8 byte offsets, in order; without options all that these could settle too."""
    chosen = None if options is None else options_of(options)

    @pandas_udf(SPANS)
    def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from holosna.normal.uncertainty import span_rows

        for texts in batches:
            yield _each(texts, lambda t: span_rows(t, chosen))

    return flag(text)


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as the session shuffles to, or has cores, however small it is: adaptive plans would join few rows to one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def normalized_by(df: DataFrame, by: Column, texts: dict[str, Column], options: Options | str | None = None) -> DataFrame:
    """df with the readings of texts that are made of one value: those of each distinct value are read once, however many rows have it.

    texts: by the columns to be made, expressions over a column named value; columns of df of these names are replaced.
    Costs a shuffle of df's rows, so it is worth it where a value is far cheaper to move than its texts are to read.
    Null values are values. Rows, repeated ones too, stay as they are.
    """
    known = dealt(df.select(by.alias("value")).distinct()).select("value", *(normalized(text, options).alias(f"__{k}") for k, text in texts.items()))
    known = known.withColumnRenamed("value", "__known")
    joined = df.withColumn("__value", by).join(known, F.col("__value").eqNullSafe(F.col("__known")), "left")
    return joined.withColumns({k: F.col(f"__{k}") for k in texts}).drop("__value", "__known", *(f"__{k}" for k in texts))


def normalized_once(df: DataFrame, text: str, out: str, options: Options | str | None = None) -> DataFrame:
    """df with column out: every distinct text is normalised once, however many rows have it, and joined back.

    Worth its shuffle where texts repeat much over many batches. Rows, repeated ones too, stay as they are.
    """
    return normalized_by(df, F.col(text), {out: F.col("value")}, options)


def exploded_spans(df: DataFrame, text: str, options: Options | str | None = None) -> DataFrame:
    """A row per uncertain span: the columns of df, but for those of that name, and those of the span."""
    fields = ("start", "stop", "text", "reason", "category", "severity")
    spans = df.withColumn("__span", F.explode(uncertain(F.col(text), options)))
    return spans.select(*(c for c in df.columns if c not in fields), "__span.*")


@udtf(returnType="start long, stop long, text string, reason string, category string, severity string")
class UncertainSpans:
    """Table function: the uncertain spans of one text."""

    def eval(self, text: str):
        from holosna.normal.uncertainty import uncertain_spans

        if text is not None:
            yield from uncertain_spans(text)


def register(spark: SparkSession) -> None:
    """SQL functions of the session: ua_normalize, ua_normalize_preset, ua_uncertain, ua_expand_abbreviations, ua_spell_acronyms,
    ua_transliterate, ua_number, ua_ordinal, ua_case, ua_digits, ua_sentences, ua_tokens; checks ua_valid_roman, _isbn, _issn, _iban, _luhn,
    _vin, _uuid of a text, ua_valid_hash of an algorithm and a digest, ua_valid_date of day, month and year; and the table function ua_uncertain_spans.

    Workers import what they call, as functions may be sent with all that they name.
    """

    def of_text(name: str, module: str, function: str, kind: str = "string") -> None:
        def run(texts: pd.Series) -> pd.Series:
            return _each(texts, getattr(import_module(module), function))

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        spark.udf.register(name, pandas_udf(run, kind))

    def of_number(name: str, function: str, form: bool) -> None:
        def said(n, *forms):
            f = getattr(import_module("holosna.normal.words"), function)
            return None if pd.isna(n) or n < 0 else f(int(n), *forms)

        def plain(n: pd.Series) -> pd.Series:
            return pd.Series([said(x) for x in n], dtype=object)

        def formed(n: pd.Series, form: pd.Series) -> pd.Series:
            return pd.Series([said(x, y) for x, y in zip(n, form, strict=True)], dtype=object)

        run = formed if form else plain
        run.__annotations__ = dict.fromkeys(["n", "form", "return"] if form else ["n", "return"], pd.Series)
        spark.udf.register(name, pandas_udf(run, "string"))

    def of_values(name: str, function: str, n: int) -> None:
        def checked(*values):
            f = getattr(import_module("holosna.normal.checks"), function)
            return pd.Series([None if any(pd.isna(v) for v in row) else f(*(v if isinstance(v, str) else int(v) for v in row)) for row in zip(*values, strict=True)], dtype=object)

        two = lambda a, b: checked(a, b)
        three = lambda a, b, c: checked(a, b, c)
        run = two if n == 2 else three
        run.__annotations__ = dict.fromkeys([*"abc"[:n], "return"], pd.Series)
        spark.udf.register(name, pandas_udf(run, "boolean"))

    def preset(texts: pd.Series, names: pd.Series) -> pd.Series:
        read = import_module("holosna.normal.pipeline").normalized
        return pd.Series([read(t, options_of(n)) if isinstance(t, str) else None for t, n in zip(texts, names, strict=True)], dtype=object)

    preset.__annotations__ = dict.fromkeys(["texts", "names", "return"], pd.Series)
    spark.udf.register("ua_normalize_preset", pandas_udf(preset, "string"))
    of_text("ua_normalize", "holosna.normal.pipeline", "normalized")
    of_text("ua_uncertain", "holosna.normal.uncertainty", "span_rows", SPANS)
    of_text("ua_expand_abbreviations", "holosna.normal.letters", "abbreviations")
    of_text("ua_spell_acronyms", "holosna.normal.letters", "acronyms")
    of_text("ua_transliterate", "holosna.normal.letters", "transliterated")
    of_text("ua_sentences", "holosna.operators.segmentation", "split_sentences", segmentation.SPANS)
    of_text("ua_tokens", "holosna.operators.segmentation", "tokenize", segmentation.SPANS)
    of_text("ua_digits", "holosna.normal.words", "digit_by_digit")
    for kind in ("roman", "isbn", "issn", "iban", "luhn", "vin", "uuid"):
        of_text(f"ua_valid_{kind}", "holosna.normal.checks", f"valid_{kind}", "boolean")
    of_values("ua_valid_hash", "valid_hash_length", 2)
    of_values("ua_valid_date", "valid_date", 3)
    of_number("ua_number", "cardinal", False)
    of_number("ua_ordinal", "ordinal", True)
    of_number("ua_case", "cased", True)
    spark.udtf.register("ua_uncertain_spans", UncertainSpans)
