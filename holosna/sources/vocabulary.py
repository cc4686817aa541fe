"""Vocabularies of preferred readings: a table of two columns, latin and cyrillic, small enough for a literal in the plan."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

HEADER = ["latin", "cyrillic"]
_WORD = re.compile(r"[A-Za-z](?:[A-Za-z'-]*[A-Za-z])?")


class VocabularyError(ValueError):
    """A vocabulary that breaks a rule; line counts from 1, 0 stands for the whole of it."""

    def __init__(self, line: int, message: str):
        super().__init__(f"vocabulary line {line}: {message}" if line else f"vocabulary {message}")
        self.line = line


def parse_vocabulary(source: str) -> dict[str, str]:
    """Lower-case Latin word -> reading. Empty lines and those that begin with # are passed over; the first other is the header."""
    rows = [(i, x.removesuffix("\r").split("\t")) for i, x in enumerate(source.removeprefix("\ufeff").split("\n"), 1) if x.removesuffix("\r") and x[0] != "#"]
    if not rows:
        raise VocabularyError(0, "has no header latin<TAB>cyrillic")
    if rows[0][1] != HEADER:
        raise VocabularyError(rows[0][0], "the header is latin<TAB>cyrillic")
    found: dict[str, str] = {}
    for line, row in rows[1:]:
        if len(row) != 2:
            raise VocabularyError(line, "a row has two columns")
        word, reading = row
        if not _WORD.fullmatch(word):
            raise VocabularyError(line, "latin is one word of ASCII letters, hyphens and apostrophes")
        if not reading or reading != reading.strip():
            raise VocabularyError(line, "cyrillic is neither empty nor padded")
        if word.lower() in found:
            raise VocabularyError(line, "the word is given twice")
        found[word.lower()] = reading
    return found


def load_vocabulary(spark: SparkSession, path: str) -> dict[str, str]:
    """Reads the file by Spark, so that any path the cluster knows will do; it goes to the driver, as part of a plan."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) > 1:
        raise VocabularyError(0, "is one file, not several")
    return parse_vocabulary(found[0][0] if found else "")
