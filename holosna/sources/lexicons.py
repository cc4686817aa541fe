"""Lexicon files as relations: tab-separated, a header, comments and empty lines; errors by file and line.

Spark reads the files, so any path that the cluster knows will do, a folder of many files too; a file is one row of one
task, as its lines are numbered. Rows stay distributed, so that a lexicon may be of any size (see ``relations``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"\A[A-Za-z](?:[A-Za-z'-]*[A-Za-z])?\z"


class LexiconError(ValueError):
    """The first line, by file and number, that breaks a rule; 0 stands for the whole of a file."""

    def __init__(self, path: str, line: int, message: str):
        super().__init__(f"{path}, line {line}: {message}" if line else f"{path}: {message}")
        self.path, self.line = path, line


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and raw of every line: no byte-order mark, no carriage return at the end."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))
    lines = files.select("file", F.posexplode(F.split("content", "\n", -1)).alias("at", "raw"))
    raw = F.regexp_replace(F.when(F.col("at") == 0, F.regexp_replace("raw", r"\A\x{FEFF}", "")).otherwise(F.col("raw")), r"\r\z", "")
    return lines.select("file", (F.col("at") + 1).alias("line"), raw.alias("raw"))


def checked(spark: SparkSession, path: str, columns: list[str], key: str, pattern: str = WORD) -> tuple[DataFrame, DataFrame]:
    """Rows (file, line, the columns; the key in lower case) and errors (file, line, message) of lexicon files.

    Every file begins with the header; rows have as many fields; the key fits the pattern and is given once in all files;
    no other field is empty or padded. A row has one error at most, the first of these. A file without a header is an
    error of line 0; Spark passes over files of no bytes, which count only where there are no others (see ``lexicon``).
    """
    lines = numbered_lines(spark, path)
    told = lines.where(~F.col("raw").rlike(r"\A(?:#|\z)"))
    head = told.groupBy("file").agg(F.min("line").alias("first"))
    rows = told.join(head, "file").withColumn("fields", F.split("raw", "\t", -1))
    fields = {c: F.get("fields", i) for i, c in enumerate(columns)}
    once = F.row_number().over(Window.partitionBy(F.lower(fields[key]), F.col("line") == F.col("first")).orderBy("file", "line"))
    padded = None
    for name, value in fields.items():
        if name != key:
            bad = (value == "") | value.rlike(r"\A\s|\s\z")
            padded = bad if padded is None else padded | bad
    message: Column = (
        F.when((F.col("line") == F.col("first")) & (F.col("raw") != "\t".join(columns)), f"the header is {'<TAB>'.join(columns)}")
        .when(F.col("line") == F.col("first"), F.lit(None).cast("string"))
        .when(F.size("fields") != len(columns), f"a row has {len(columns)} columns")
        .when(~fields[key].rlike(pattern), f"{key} does not fit {pattern}")
        .when(F.lit(False) if padded is None else padded, "a field is empty or padded")
        .when(F.col("once") > 1, f"{key} is given twice")
    )
    judged = rows.withColumn("once", once).withColumn("message", message)
    empty = lines.groupBy("file").agg(F.max((~F.col("raw").rlike(r"\A(?:#|\z)")).cast("int")).alias("any")).where("any = 0")
    errors = judged.where("message IS NOT NULL").select("file", "line", "message").unionByName(empty.select("file", F.lit(0).alias("line"), F.lit(f"has no header {'<TAB>'.join(columns)}").alias("message")))
    good = judged.where("message IS NULL AND line > first").select("file", "line", *((F.lower(v) if c == key else v).alias(c) for c, v in fields.items()))
    return good, errors


def lexicon(spark: SparkSession, path: str, columns: list[str], key: str, pattern: str = WORD) -> DataFrame:
    """The columns of lexicon files; raises LexiconError for the first error there is, and Spark's own for a path that isn't there."""
    rows, errors = checked(spark, path, columns, key, pattern)
    first = errors.orderBy("file", "line").limit(1).collect()
    if first:
        raise LexiconError(*first[0])
    if numbered_lines(spark, path).isEmpty():
        raise LexiconError(path, 0, f"has no header {'<TAB>'.join(columns)}")
    return rows.select(*columns)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word and reading of files with the header latin<TAB>cyrillic, as ``relations.with_readings`` takes them."""
    return lexicon(spark, path, ["latin", "cyrillic"], "latin").toDF("word", "reading")
