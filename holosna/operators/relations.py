"""Spans and lexicons as relations: matches with byte offsets, containment of spans, lexicons by rank, vocabularies of any size.

All in DataFrame operations: rows of a text are told by key columns, which may be null or shared (see each function).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Rows up to which a vocabulary is collected and broadcast: with a word, a reading and what a row costs, under some 20 MB.
BROADCAST_ROWS = 100_000


def exploded_matches(df: DataFrame, text: str, pattern: str, *keys: str) -> DataFrame:
    """keys, place (from 0), start, stop (offsets in the UTF-8 text) and match of every match of a Java pattern in text.

    keys tell rows apart; of rows that share them and differ in text, places and offsets would run on, so give such rows
    a key first. The pattern must not match an empty text. Null and empty texts have no matches. Offsets are sums over
    the pieces before, by one exchange of the pieces; a very long text's pieces are sorted in one task, which spills.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.posexplode(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"))).alias("place", "piece")
    rows = df.where(F.size(found) > 0).select(*keys, pieces).select(*keys, "place", F.octet_length("piece.gap").alias("__gap"), "piece.match")
    size = F.octet_length("match").cast("long")
    until = F.sum(F.col("__gap") + size).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stop", until).withColumn("start", F.col("stop") - size).select(*keys, F.col("place").cast("long").alias("place"), "start", "stop", "match")


def without_inside(spans: DataFrame, larger: DataFrame, *keys: str, proper: bool = False) -> DataFrame:
    """spans (keys, start, stop, …) that lie inside none of the larger ones (keys, start, stop) of equal keys.

    A sweep instead of a range join: both in order of start, a span lies inside one if the greatest stop of those that
    begin no later reaches its own. proper: an equal span doesn't count. One exchange by keys, whatever the overlap;
    no pair is ever made. Spans with a null bound lie in none; null keys are keys. Columns of spans stay as they are.
    """
    fields = [c for c in spans.columns if c not in keys]
    own = spans.select(*keys, F.struct(*fields).alias("__span"), F.col("start").alias("__start"), F.lit(None).cast("long").alias("__stop"))
    those = larger.where("start IS NOT NULL AND stop IS NOT NULL").select(*keys, F.lit(None).cast(own.schema["__span"].dataType).alias("__span"), F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    order = Window.partitionBy(*keys).orderBy("__start")
    upto = F.max("__stop").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = F.max("__stop").over(order.rangeBetween(Window.unboundedPreceding, -1))
    stop = F.col("__span.stop")
    inside = (upto > stop) | (earlier >= stop) if proper else upto >= stop
    swept = own.unionByName(those).withColumn("__inside", F.coalesce(inside & F.col("__start").isNotNull(), F.lit(False)))
    return swept.where("__span IS NOT NULL AND NOT __inside").select(*keys, *(F.col(f"__span.{c}").alias(c) for c in fields))


def by_rank(key: str, *lexicons: DataFrame) -> DataFrame:
    """One row a key of lexicons of the same columns: that of the first lexicon that has it, with rank (from 0).

    A lexicon that has a key twice gives the least of its rows. Rows without a key go. Rows are summed before the shuffle.
    """
    columns = lexicons[0].columns
    rest = [c for c in columns if c != key]
    union = None
    for rank, lexicon in enumerate(lexicons):
        rows = lexicon.select(key, F.struct(F.lit(rank).alias("rank"), *rest).alias("__row"))
        union = rows if union is None else union.unionByName(rows)
    first = union.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("__row").alias("__row"))
    return first.select(*(key if c == key else F.col(f"__row.{c}").alias(c) for c in columns), F.col("__row.rank").alias("rank"))


def folded(word: Column) -> Column:
    """ASCII letters in lower case."""
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Readings(dict):
    """word as written -> its reading, or itself; found by its lower case once, and kept for a bounded number of words."""

    LIMIT = 1 << 16

    def __init__(self, known: dict[str, str]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        low = word.lower() if word.isascii() else word.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        self[word] = found = self.known.get(low, word)
        return found


def _read_by_one(text: Column, pattern: str, shared: Broadcast) -> Column:
    """text with the words that one vocabulary knows as their readings."""

    @pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        word, readings = regex.compile(pattern, regex.ASCII), Readings(shared.value)
        for texts in batches:
            yield pd.Series([word.sub(lambda m: readings[m[0]], t) if isinstance(t, str) else None for t in texts], dtype=object)

    return read(text)


def _read_by_own(text: Column, pattern: str, words: Column, readings: Column) -> Column:
    """text with the words that its own arrays know as their readings."""

    @pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        word, out = regex.compile(pattern, regex.ASCII), []
        for columns in batches:
            out = []
            for t, a, b in zip(*columns, strict=True):
                own = None if a is None else Readings(dict(zip(a, b, strict=True)))
                out.append(t if own is None or t is None else word.sub(lambda m, own=own: own[m[0]], t))
            yield pd.Series(out, dtype=object)

    return read(text, words, readings)


def with_readings(df: DataFrame, text: str, out: str, vocabulary: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """df with column out: text with the words that the vocabulary (word, reading; words in lower case) knows as their readings.

    Words are matches of a pattern that Java and Python (regex, with ASCII classes) read alike. A vocabulary of at most
    BROADCAST_ROWS rows is sent to the workers, which look words up where their text lies: nothing is shuffled. For a larger
    one the distinct words of each text are joined by word, and only those that it knows come back, as arrays by key.
    Either way a word costs one look-up by hash, however many others the text or the vocabulary has. Rows that share keys
    share their words, which leaves each text's reading right. A null text gives null. A column named out is replaced.
    """
    vocabulary = vocabulary.where("word IS NOT NULL AND reading IS NOT NULL").groupBy("word").agg(F.min("reading").alias("reading"))
    few = vocabulary.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        return df.withColumn(out, _read_by_one(F.col(text), pattern, df.sparkSession.sparkContext.broadcast({r.word: r.reading for r in few})))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), folded))
    own = [F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]
    found = df.select(*own, F.explode(words).alias("word")).distinct().join(vocabulary, "word")
    arrays = F.collect_list(F.struct("word", "reading")).alias("__known")
    known = found.groupBy(*(f"__{i}" for i in range(len(keys)))).agg(arrays)
    same = None
    for i, k in enumerate(keys):
        equal = df[k].eqNullSafe(F.col(f"__{i}"))
        same = equal if same is None else same & equal
    joined = df.join(known, same, "left")
    return joined.withColumn(out, _read_by_own(F.col(text), pattern, F.col("__known.word"), F.col("__known.reading"))).drop("__known", *(f"__{i}" for i in range(len(keys))))
