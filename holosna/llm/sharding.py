"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash by doc_id and text into ``n_slots`` slots, which never change, so that null or shared ids spread over many. Rows and bytes are summed per slot (a few thousand
rows at any size of input); the map from slots to shards gives the slots, largest first, to the shard with the fewest
bytes. Rebalancing edits the map and stores a new version; records are never hashed anew.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 8192
MAP_SCHEMA = "version int, vslot int, shard int, n_rows long, bytes long, first long"


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(doc_id: Column, crc32: Column, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, crc32), F.lit(n_slots)).cast("int")


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every row. Null text: size 16, crc 0. Rows that share id and text share a slot."""
    crc32 = text_crc32(F.col("text"))
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), crc32.alias("text_crc32"), slot_of(F.col("doc_id"), crc32, n_slots).alias("vslot")
    )


def slot_sums(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, rows, bytes) of each slot with rows: n_slots entries at most."""
    return [tuple(r) for r in slotted.groupBy("vslot").agg(F.count("*"), F.sum("size")).collect()]


def first_map(sums: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Slots, largest first, each to the shard with the fewest bytes; slots without rows in turn, so that the map is total."""
    size = {v: b for v, _, b in sums}
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for v in sorted(range(n_slots), key=lambda v: (-size.get(v, 0), v)):
        b, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (b + size.get(v, 0), s))
    return out


def grown_map(old: dict[int, int], sums: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """The map edited for one or more added shards: slots move from the fullest shards into the new ones, and nowhere else."""
    size = {v: b for v, _, b in sums}
    load, own = dict.fromkeys(range(n_shards), 0), {}
    for v, s in old.items():
        load[s] += size.get(v, 0)
        own.setdefault(s, []).append(v)
    for slots in own.values():
        slots.sort(key=lambda v: (size.get(v, 0), v))
    goal, new, out = sum(load.values()) / n_shards, set(range(max(old.values()) + 1, n_shards)), dict(old)
    while new:
        to = min(new, key=lambda s: (load[s], s))
        source = max(own, key=lambda s: (load[s], -s) if own[s] else (-1, -s))
        if not own[source] or load[to] + size.get(own[source][-1], 0) > goal:
            new.discard(to)
            continue
        v = own[source].pop()
        out[v] = to
        load[source] -= size.get(v, 0)
        load[to] += size.get(v, 0)
    return out


def store_map(spark: SparkSession, path: str, version: int, slots: dict[int, int], sums: list[tuple[int, int, int]]) -> None:
    """Writes a version of the map: each slot's shard, its rows and bytes, and the place in the shard where its rows begin."""
    by = {v: (n, b) for v, n, b in sums}
    at: dict[int, int] = {}
    rows = []
    for v in sorted(slots):
        n, b = by.get(v, (0, 0))
        rows.append((version, v, slots[v], n, b, at.get(slots[v], 0)))
        at[slots[v]] = at.get(slots[v], 0) + n
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/v{version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{version}")


def grow(docs: DataFrame, map_path: str, version: int, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Stores the next version of the map, edited for n_shards, and gives the documents' places under it as shard() does.

    Rows of slots that don't move keep their shard; the sums are of docs as they are now.
    """
    slotted = with_slots(docs, n_slots)
    sums = slot_sums(slotted)
    old = {r.vslot: r.shard for r in read_map(docs.sparkSession, map_path, version).select("vslot", "shard").collect()}
    store_map(docs.sparkSession, map_path, version + 1, grown_map(old, sums, n_shards), sums)
    return assigned(slotted, read_map(docs.sparkSession, map_path, version + 1))


def assigned(slotted: DataFrame, slots: DataFrame) -> DataFrame:
    """Adds shard and the gapless place in it: where the virtual slot begins, plus the row's number inside the slot.

    Rows are numbered inside virtual slots, so that no task sorts a whole shard. Equal rows take any order among them.
    The map has n_slots rows, whatever the input: it is broadcast.
    """
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(slots.select("vslot", "shard", "first")), "vslot")
        .withColumn("slot", (F.col("first") + F.col("inside")).cast("long"))
        .drop("inside", "first")
    )


def shard(docs: DataFrame, map_path: str, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, vslot, shard, slot, under version 1 of the map, stored at map_path.

    Empty input: no rows and a map without bytes. Repeated rows count each. Other columns are not read.
    """
    slotted = with_slots(docs, n_slots)
    sums = slot_sums(slotted)
    store_map(docs.sparkSession, map_path, 1, first_map(sums, n_shards, n_slots), sums)
    return assigned(slotted, read_map(docs.sparkSession, map_path, 1))


def write_shards(docs: DataFrame, slots: DataFrame, path: str, n_slots: int = N_SLOTS) -> None:
    """Writes the documents' files, a folder per shard; each task writes one virtual slot's rows or several's, never a whole shard."""
    key = slot_of(F.col("doc_id"), text_crc32(F.col("text")), n_slots)
    (
        docs.withColumn("__vslot", key)
        .join(F.broadcast(slots.select(F.col("vslot").alias("__vslot"), F.col("shard").alias("__shard"))), "__vslot")
        .drop("__vslot")
        .write.partitionBy("__shard")
        .parquet(path)
    )
