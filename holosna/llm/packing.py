"""Bounded-space online best-fit packing of token sequences.

Each task tokenises its documents and packs their pieces as they come. A fixed number of bins is open; a bitset has
the bit of every free space that some open bin has, so the tightest bin is the lowest bit from the piece's length on.
If none fits and all bins are open, the fullest closes. The bins open at a task's end are at most ``open_bins`` a
task: their pieces are packed once more by the same rule, bin after bin, in groups of tasks of bounded pieces, so that
many tasks leave few half-empty sequences.
"""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import bounded, small, stored, utf8

CAPACITY, OPEN_BINS, END_ID = 2048, 512, 0
#: Pieces that a group of tasks' open bins has at most, but for a single task with more (at most OPEN_BINS * CAPACITY).
GROUP_PIECES = 200_000
#: Characters for which the fast tokenizer is known to split text as the reference one does; texts with others take the latter.
PLAIN = r"[^\x00-\x7e\xa0-ſ‐-›€]"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, bin long, offset long, fill int, left boolean"


class Bins:
    """Open bins by free space. put() returns the bin and its fill before, closed() the bins to write out."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit, self.bits, self.made, self.n = capacity, open_bins, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}
        self.done: list[int] = []

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        bin_ = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.n -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        if length == self.capacity:  # a full piece needs no open bin, so none closes for it
            self.made += 1
            self.done.append(self.made - 1)
            return self.made - 1, 0
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            bin_ = self._take(free)
        else:
            if self.n == self.limit:
                self.done.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.by_free.setdefault(rest, []).append(bin_)
            self.bits |= 1 << rest
            self.n += 1
        else:
            self.done.append(bin_)
        return bin_, self.capacity - free

    def closed(self) -> list[int]:
        out, self.done = self.done, []
        return out

    def rest(self) -> list[int]:
        return [b for own in self.by_free.values() for b in own]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: all of full capacity but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def encoder(json_path: str, ranks_path: str | None):
    """texts -> token ids. One per worker process. With a rank file of the same vocabulary, plain texts take a faster library."""
    kept = sys.modules.setdefault("holosna_worker", types.ModuleType("holosna_worker")).__dict__
    if (json_path, ranks_path) not in kept:
        import base64
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        slow.encode_special_tokens = True
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast, odd = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), re.compile(PLAIN)
            kept[json_path, ranks_path] = lambda t: slow.encode(t, add_special_tokens=False).ids if odd.search(t) else fast.encode_ordinary(t)
        else:
            kept[json_path, ranks_path] = lambda t: slow.encode(t, add_special_tokens=False).ids
    return kept[json_path, ranks_path]


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and fill, the tokens of its sequence.

    Null and empty texts are the end id alone. Repeated rows are packed each. Other columns are ignored. Empty docs: no
    rows. The pieces (no tokens) are stored once, so sequence numbers hold whatever task is run again later.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, bins, held, part = encoder(json_path, ranks_path), Bins(capacity, open_bins), {}, TaskContext.get().partitionId()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "fill", "left"]
        types_ = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

        def out(which: list[int], left: bool) -> list[tuple]:
            rows = []
            for b in which:
                own = held.pop(b)
                fill = own[-1][6] + own[-1][3]
                rows += [(*r[:5], part, b, r[6], fill, left) for r in own]
            return rows

        def table(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types_, strict=True)], names=names)

        ready: list[tuple] = []
        for batch in batches:
            ids_, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                ids = np.array([*encode((texts[i].as_py() or b"").decode("utf-8", "replace")), end_id], "<u4")
                doc = ids_[i].as_py()
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    b, offset = bins.put(n)
                    held.setdefault(b, []).append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), b, offset))
                ready += out(bins.closed(), False)
                if len(ready) > 20_000:
                    yield table(ready)
                    ready = []
        ready += out(bins.rest(), True)
        if ready:
            yield table(ready)

    pieces = stored(bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("t"))).mapInArrow(run, PIECES), "pieces")
    return _again(pieces, capacity, open_bins)


def _again(pieces: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Packs the pieces of the bins left open at the ends of tasks once more by the same rule, in their order in the bins, in groups of tasks."""
    # one row per task reaches the driver; a group's number is that of its first task, and the table of groups is broadcast if it is small
    group, size = [], GROUP_PIECES
    for r in pieces.where("left").groupBy("part").count().orderBy("part").collect():
        if size + r["count"] > GROUP_PIECES:
            first, size = r["part"], 0
        size += r["count"]
        group.append((r["part"], first))
    groups = pieces.sparkSession.createDataFrame(group, "part int, first int")

    def repack(frame):
        frame = frame.sort_values(["part", "bin", "offset"], ignore_index=True)
        bins, fill = Bins(capacity, open_bins), {}
        placed = [bins.put(int(n)) for n in frame["length"]]
        for (b, offset), n in zip(placed, frame["length"], strict=True):
            fill[b] = offset + n
        frame["bin"], frame["offset"] = [b for b, _ in placed], [o for _, o in placed]
        frame["fill"] = [fill[b] for b, _ in placed]
        frame["part"] = frame["first"]
        return frame.drop(columns="first")

    left = pieces.where("left").join(small(groups), "part").select(*pieces.columns, "first").groupBy("first").applyInPandas(repack, PIECES)
    number = F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
    return (
        pieces.where("NOT left").withColumn("sequence_id", number).unionByName(left.withColumn("sequence_id", -1 - number))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill")
    )
