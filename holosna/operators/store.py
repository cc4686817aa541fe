"""Readings kept from run to run: a text that was once read under some options is not read again.

A store is a folder of Parquet tables, one for each set of options and batch: sha256 of the text, and its reading. A
batch writes only what no other batch has; written again, as after a failure, it replaces its own rows. So a stream that
is restarted, and a job that runs twice, leave the same store.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holosna.operators.gating import normalized_rows
from holosna.operators.normalization import options_of
from holosna.options import Options

SCHEMA = "key string, reading string"


def _key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class ReadingStore:
    """The readings of one set of options in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, options: Options | str | None = None):
        self.spark, self.options = spark, options_of(options)
        said = json.dumps(asdict(self.options), sort_keys=True, ensure_ascii=False, default=dict)
        self.path = f"{path.rstrip('/')}/options={hashlib.sha256(said.encode()).hexdigest()[:16]}"

    def readings(self) -> DataFrame:
        """key, reading and batch of all that is stored; no rows where nothing is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMA + ", batch string")
        return self.spark.read.schema(SCHEMA + ", batch string").option("basePath", self.path).parquet(self.path)

    def unread(self, df: DataFrame, text: str, batch: str) -> DataFrame:
        """key and text of the distinct texts of df that no other batch has. Null texts are none."""
        texts = df.where(F.col(text).isNotNull()).select(_key(F.col(text)).alias("key"), F.col(text).alias("text"))
        once = texts.groupBy("key").agg(F.first("text").alias("text"))
        return once.join(self.readings().where(F.col("batch") != batch).select("key"), "key", "left_anti")

    def add(self, df: DataFrame, text: str, batch: str) -> None:
        """Reads the texts of df that no other batch has, and stores them as this batch, in place of what it held."""
        read = normalized_rows(self.unread(df, text, batch), "text", "reading", self.options).select("key", "reading")
        read.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """df with column out, the stored readings of its texts; null for null texts and for those that aren't stored."""
        known = self.readings().groupBy(F.col("key").alias("__key")).agg(F.first("reading").alias("__reading"))
        joined = df.withColumn("__own", _key(F.col(text))).join(known, F.col("__own") == F.col("__key"), "left")
        return joined.withColumn(out, F.col("__reading")).drop("__own", "__key", "__reading")

    def started(self, stream: DataFrame, text: str, out: str, path: str, checkpoint: str) -> StreamingQuery:
        """Reads a stream's texts by the store, and writes its rows with column out to path, each batch to its own folder, once."""

        def step(rows: DataFrame, number: int) -> None:
            self.add(rows, text, str(number))
            self.read(rows, text, out).write.mode("overwrite").parquet(f"{path}/batch={number}")

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
