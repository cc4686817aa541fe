"""What the corpus operators share: shared-folder tables, Arrow batches of texts, and word hashing with numpy."""

from __future__ import annotations

import gc
import hashlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer single text is a step of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch, about, where the session bounds batches by rows alone: ten thousand long texts would fill a worker.
ARROW_BYTES, ARROW_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes up to which a table may be broadcast, and what a row costs besides its values.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 32
#: Words beyond this many bytes are hashed by blake2b: a sum of powers has known collisions of long words only.
LONG_WORD = 255

_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on a local master (tests); else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="holosna-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    if _made:
        _made[-1].append(path)
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and a lost executor loses nothing."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, kept: list[DataFrame]):
    """Owns the tables that are made inside it: at its end they are deleted, but for those the caller has put in kept."""
    _made.append([])
    try:
        yield
    finally:
        stay = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for df in kept for f in df.inputFiles()}
        paths = _made.pop()
        removed(spark, [p for p in paths if p.split(":", 1)[-1].lstrip("/") not in stay])
        if _made:
            _made[-1] += [p for p in paths if p.split(":", 1)[-1].lstrip("/") in stay]
        released(spark)


def removed(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in paths:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def dropped(*tables: DataFrame, release: bool = True) -> None:
    """Deletes the files of tables that stored() made and that no later step reads; release: and shuffle files, at the cost of a collection."""
    spark = tables[0].sparkSession
    removed(spark, list({f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles() if "/tables/" in f}))
    if release:
        released(spark)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver's next collection."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, *arrays: str) -> DataFrame:
    """df (a stored table) with a broadcast hint if its counted bytes stay under the bound, else as it is; arrays are counted by their entries."""
    size = F.lit(ROW_BYTES + 8 * len(df.columns))
    for name in arrays:
        size = size + F.coalesce(F.size(name), F.lit(0)) * 32
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def ranked(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df with at, each row's place (from 0) in its group by order, and n, the rows of its group. Columns of group have no nulls.

    Rows are dealt by ranges of group and order, and sorted there; so a large group takes as many tasks as it needs, and
    rows equal in all of these are dealt by where they were read. A task's rows of a group begin where those of the tasks
    before end: a table of one row a task and group.
    """
    keys = [*group, *order, F.col("__read")]
    spread = df.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(spread.drop("__read").withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    pieces = rows.groupBy(*group, part).agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = stored(pieces.select(*group, "__part", (before - F.col("__low")).alias("__shift"), F.sum("__n").over(own).alias("n")), "pieces")
    placed = rows.withColumn("__part", part).join(small(pieces), [*group, "__part"])
    return placed.withColumn("at", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is never held out, nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; a null one has none."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have a bound in bytes: its own, or else ARROW_BYTES."""
    if df.sparkSession.conf.get(ARROW_SETTING, None) is None:
        df.sparkSession.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    return df


Batch = Callable[[list[bytes], dict[str, pa.Array]], dict[str, object]]


def by_batch(df: DataFrame, f: Batch, schema: str, text: str = "text_utf8", per_step: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with f on steps of bounded bytes: f gets the texts and the columns of a step, and returns columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text, per_step):
                texts = [x or b"" for x in part.column(text).to_pylist()]
                made = f(texts, {n: part.column(n) for n in part.schema.names if n != text})
                yield pa.RecordBatch.from_arrays([x if isinstance(x := made[n.name], pa.Array) else pa.array(x, n.type) for n in out], schema=out)

    return bounded(df).mapInArrow(run, schema)


def steps(batch: pa.RecordBatch, text: str, per_step: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + per_step, "right")))
        yield batch.slice(at, to - at)
        at = to


def by_list(rows: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """mapInArrow with f on runs of whole lists (rows of a key, which lie together)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            key = now.column("key").to_numpy()
            cut = int(np.searchsorted(key[::-1] != key[-1], True)) if len(key) else 0
            if cut < len(key):
                yield from f(now.slice(0, len(key) - cut)).to_batches()
            held = now.slice(len(key) - cut)
        if held is not None and held.num_rows:
            yield from f(held).to_batches()

    return bounded(rows).mapInArrow(run, schema)


# ---- words and hashes -------------------------------------------------------------------------------------------

#: ASCII lower case; everything that isn't a word character becomes 0. Words are runs of what is not white space.
SPACED = np.array([0 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The same, with words as runs of ASCII letters, digits and bytes beyond ASCII.
ALNUM = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, mod 2**64.

    They are kept in a module of the process, not in a global: functions may be sent to workers with the globals they name.
    """
    kept = sys.modules.setdefault("holosna_worker", types.ModuleType("holosna_worker")).__dict__.setdefault("powers", {})
    if len(kept.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, v in (("up", _P), ("down", inverse)):
            a = np.full(size, v, np.uint64)
            a[0] = 1
            kept[k] = np.multiply.accumulate(a)
    return kept["up"][:n], kept["down"][:n]


def words(texts: list[bytes], table: np.ndarray, breaks: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts at once: where words start and end in the joined bytes, their 64-bit hashes, and each text's first word (one more at the end)."""
    raw = np.frombuffer(breaks.join(texts) + breaks, np.uint8)
    low = table[raw]
    is_word = np.zeros(len(low) + 1, bool)
    np.not_equal(low, 0, out=is_word[1:])
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    # in place: a second array of eight bytes a character would leave the processor's cache
    np.multiply(low, up[: len(low)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    return start, end, hashes, first


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _M + hashes[j : j + n]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's set of k-word shingles as sorted 64-bit hashes. Fewer words, but some, are one shingle; none: an empty set."""
    _, _, hashes, first = words(texts, SPACED)
    every = grams(hashes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(every[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(mix(grams(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


class Overlaps:
    """Exact sizes of the intersections of a set with others, over sorted arrays that lie in one flat array."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.ids = np.unique(flat, return_inverse=True)[1]
        self.at, self.flag = at, np.zeros(int(self.ids.max(initial=-1)) + 1, np.int32)

    def of(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set x with the others, none of which is empty."""
        own, size = self.ids[self.at[x] : self.at[x + 1]], self.at[others + 1] - self.at[others]
        first = np.cumsum(size) - size
        self.flag[own] = 1
        got = np.add.reduceat(self.flag[self.ids[np.repeat(self.at[others] - first, size) + np.arange(size.sum())]], first)
        self.flag[own] = 0
        return got
