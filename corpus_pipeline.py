"""A corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holosna.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from holosna.llm.common import dropped, scratch, small, stored

#: The stages' methods are no SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep; trusted are those labelled as of quality 1.

    Null and empty texts have fewer words than the rules ask for, and go. A null id is never trusted, and is judged by
    its text like any other; rows that share an id are judged each. Columns of docs stay as they are, whatever their names.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    return quality_rules.judged(own, trusted).where("kept").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that are similar to an earlier line; documents left without a word go. n_chars is counted anew.

    Rows of null or shared ids are told apart by their texts; a row repeated whole keeps its lines each time.
    """
    kept: list[DataFrame] = []
    with scratch(spark, kept):
        kept.append(line_dedup.removed_lines(docs))
    return line_dedup.without(docs, kept[0]).withColumn("n_chars", F.length("text").cast("long"))


def row_key() -> Column:
    """Tells rows apart by id and text, either of which may be null; rows of equal id and text have one key."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 or more, one row stays.

    It is that of the smallest id, null ids last; of texts that share the id, that of the least hash; of rows of equal
    id and text, the least by the other columns, nulls first. Rows of an id are linked by their texts alone. Texts
    without words have no links: all of their rows stay.
    """
    kept: list[DataFrame] = []
    with scratch(spark, kept):
        linked = ngram_join.link(docs.select(row_key().alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "n_shingles", "component_id").distinct()
        placed = docs.select("doc_id", row_key().alias("__key")).distinct().join(linked, "__key")
        least = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("least"), (F.max("n_shingles") > 0).alias("__one"))
        kept.append(stored(least.select("least.__key", "__one"), "survivors"))
    kept = docs.withColumn("__key", row_key()).join(small(kept[0]), "__key")
    # rows without words are each a group of their own
    kept = kept.withColumn("__row", F.when(F.col("__one"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return kept.groupBy("__key", "__row").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go; rows that share their id but not their text stay."""
    kept: list[DataFrame] = []
    with scratch(spark, kept):
        found = decontamination.matches(docs.select(row_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        kept.append(stored(found.where("n_hit > 0").select(F.col("doc_id").alias("__hit")).distinct(), "hits"))
    return docs.join(small(kept[0]), row_key() == F.col("__hit"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stores on its way is deleted when its result is stored, and so is that result after its next stage."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        kept = []
        with scratch(spark, kept):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
