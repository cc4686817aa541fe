"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holosna.llm import chat, decontamination, language_id, line_dedup, manifest, ngram_join, odd_sketch, packing, quality_classifier, quality_rules, resampling, sharding, toxicity
from holosna.llm.common import held_out, table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judged(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.sha256_of(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.windows(turns.unionByName(own)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))).where("doc_id IS NOT NULL"))
    return language_id.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")).drop("fill")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a map of 39 shards is stored, then edited for one more: version 2 places the rows
    slots = table_path(spark, "slots")
    sharding.shard(docs, slots, 39)
    placed = sharding.grow(docs, slots, 1, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, num=85, den=100)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.predict(docs, toxicity.train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return quality_classifier.predict(docs, quality_classifier.train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, num=85, den=100)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    n_chars = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = manifest.digest([n_chars if c == "n_chars" else F.col(c) for c in columns])
    path = F.concat("own_path", "top_path")
    made = manifest.manifest(docs, columns, "lang", ["doc_id"], F.col("doc_id"), tampered.alias("read"))
    folded = manifest.folded(manifest.folded(F.col("read"), F.col("own_at"), F.col("own_path")), F.col("top_at"), F.col("top_path"))
    made = made.select("doc_id", "leaf", "subroot", "root", manifest.proof(path).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_chat_formatting, op4_language_id, op5_packing, op6_sharding, op7_ngram_join, op8_line_dedup, op9_toxicity, op10_quality_classifier, op11_importance_resampling, op12_odd_sketches, op13_merkle_manifest)}
