"""Tables of texts from files, and back: the same schema, doc_id-less or not, for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "tsv", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, stream: bool = False) -> DataFrame:
    """A table of texts. text: column ``text``, a row a line. json, csv, tsv and streams need a schema, so that no pass infers one."""
    if kind not in FORMATS:
        raise ValueError(f"kind is one of {', '.join(FORMATS)}, not {kind!r}")
    if kind == "text":
        schema = "text string"
    elif schema is None and (stream or kind in ("json", "csv", "tsv")):
        raise ValueError(f"{kind}{' streams' if stream else ''} need a schema")
    reader = spark.readStream if stream else spark.read
    if kind in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", kind == "csv").option("escape", '"')
        kind = "csv"
    reader = reader.format(kind)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes df as it is partitioned. Arrays of structs (spans) go to parquet, orc and json alone."""
    if kind not in FORMATS:
        raise ValueError(f"kind is one of {', '.join(FORMATS)}, not {kind!r}")
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if kind in ("csv", "tsv"):
        writer = writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"')
        kind = "csv"
    writer.format(kind).save(path)
