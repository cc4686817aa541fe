"""Benchmark decontamination with a positional inverted index.

The corpus is cut into segments of bounded bytes. A segment is one row of a stored table: its documents, and the
postings (sorted word places) of every word, so that any number of benchmarks can be searched over it. A search reads
the segments in place, without a shuffle: it takes the terms of a phrase from the rarest in the segment on, intersects
their places less their offsets in the phrase, and stops when none is left. Every task holds one segment and the
phrases of one block of benchmark items; more items mean more blocks, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import ALNUM, by_batch, stored, utf8, words

WINDOW = 10
#: Items, and bytes of their texts, that one search holds in memory (their windows are sent to every task).
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 1 << 20
#: Bytes of text of a segment; a longer text is one of its own.
SEGMENT_BYTES = 1 << 21
SEGMENT = "doc_ids array<bigint>, n_words array<int>, terms array<bigint>, counts array<int>, postings binary"


@dataclass
class Phrases:
    """Distinct windows of benchmark items, by length: term numbers, and the items that hold each."""

    terms: np.ndarray  # sorted 64-bit hashes of words
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, list[list[int]]] = field(default_factory=dict)
    ids: list[str] = field(default_factory=list)


def phrases(items: list[tuple[object, bytes]], width: int = WINDOW) -> Phrases:
    """The windows of ``width`` words of each item; an item of fewer words, but some, is one window; without words: none."""
    _, _, hashes, first = words([t for _, t in items], ALNUM)
    terms = np.unique(hashes)
    number = np.searchsorted(terms, hashes)
    found: dict[int, dict[tuple, list[int]]] = {}
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        size = min(width, b - a)
        for i in range(a, b - size + 1) if size else ():
            own = found.setdefault(size, {}).setdefault(tuple(number[i : i + size].tolist()), [])
            if not own or own[-1] != k:
                own.append(k)
    return Phrases(terms, {n: np.array(list(x), np.int64).reshape(-1, n) for n, x in found.items()}, {n: list(x.values()) for n, x in found.items()}, ["" if i is None else str(i) for i, _ in items])


def index(docs: DataFrame) -> DataFrame:
    """The stored segments of docs (doc_id, text), with the postings of all words. Null and empty texts are documents without words."""

    def build(texts: list[bytes], more: dict) -> dict:
        _, _, hashes, first = words(texts, ALNUM)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]]))
        counts = np.diff(np.concatenate([begin, [len(ranked)]]))
        return {
            "doc_ids": [more["doc_id"].to_pylist()],
            "n_words": [np.diff(first).astype(np.int32)],
            "terms": [ranked[begin].view(np.int64)],
            "counts": [counts.astype(np.int32)],
            "postings": [order.astype("<u4").tobytes()],
        }

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text_utf8"))
    return stored(by_batch(texts, build, SEGMENT, per_step=SEGMENT_BYTES).withColumn("segment", F.monotonically_increasing_id()), "postings")


class Segment:
    """A segment's row in memory."""

    def __init__(self, n_words: np.ndarray, hashes: np.ndarray, counts: np.ndarray, postings: bytes, terms: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        self.count, self.start = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        if len(hashes) and len(terms):
            i = np.minimum(np.searchsorted(hashes, terms), len(hashes) - 1)
            held = hashes[i] == terms
            self.count[held] = counts[i[held]]
            self.start[held] = (np.cumsum(counts) - counts)[i[held]]
        self.places = np.frombuffer(postings, "<u4").astype(np.int64)

    def of(self, term: int) -> np.ndarray:
        return self.places[self.start[term] : self.start[term] + self.count[term]]

    def whole(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those of the places whose ``size`` words lie in one document."""
        doc = np.searchsorted(self.first, at, "right") - 1
        return at[at + size <= self.first[doc + 1]] if len(at) else at

    def exact(self, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase begins: rarest term first, the others' places less their offsets intersected one by one."""
        order = np.argsort(self.count[phrase], kind="stable")
        at = self.of(phrase[order[0]]) - order[0]
        at = at[at >= 0]
        for k in order[1:]:
            own = self.of(phrase[k])
            i = np.searchsorted(own, at + k)
            i[i == len(own)] = 0
            at = at[own[i] == at + k]
            if not len(at):
                break
        return self.whole(at, len(phrase)) if len(at) else at

    def near(self, phrase: np.ndarray, span: int) -> np.ndarray:
        """Where stretches of ``span`` words begin that hold all terms of the phrase, in any order; the rarest term anchors."""
        need = np.unique(phrase)
        need = need[np.argsort(self.count[need], kind="stable")]
        if self.count[need[0]] == 0:
            return np.zeros(0, np.int64)
        anchor = self.of(need[0])
        doc = np.searchsorted(self.first, anchor, "right") - 1
        starts = np.unique(np.concatenate([np.maximum(anchor - d, self.first[doc]) for d in range(span)]))
        for term in need:
            own = self.of(term)
            i = np.searchsorted(own, starts)
            ends = np.minimum(starts + span, self.first[np.searchsorted(self.first, starts, "right")])
            starts = starts[(i < len(own)) & (own[np.minimum(i, len(own) - 1)] < ends)]
            if not len(starts):
                break
        return starts


def search(segments: DataFrame, what: Phrases, span: int | None = None) -> DataFrame:
    """Per document: segment and place in it, doc_id, n_words, n_hit (words inside matches), items (their ids, sorted as strings), spans (merged
    stretches of hit words, end excluded). Exact phrases, or proximity within ``span`` words where that is given."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                out = look(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    def look(row: dict) -> dict:
        n_words = np.array(row["n_words"], np.int64)
        seg = Segment(n_words, np.array(row["terms"], np.int64).view(np.uint64), np.array(row["counts"], np.int64), row["postings"], what.terms)
        hit, items = np.zeros(int(seg.first[-1]) + 1, np.int64), [set() for _ in n_words]
        for size, many in what.windows.items():
            for k in np.flatnonzero((seg.count[many] > 0).all(1)):
                at = seg.exact(many[k]) if span is None else seg.near(many[k], span)
                if len(at):
                    doc = np.searchsorted(seg.first, at, "right") - 1
                    np.add.at(hit, at, 1)
                    np.add.at(hit, np.minimum(at + (size if span is None else span), seg.first[doc + 1]), -1)
                    for d in np.unique(doc).tolist():
                        items[d].update(what.items[size][k])
        is_hit = np.cumsum(hit)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(is_hit)])
        n_hit = total[seg.first[1:]] - total[seg.first[:-1]]
        spans = [[] for _ in n_words]
        for d in np.flatnonzero(n_hit):
            own = is_hit[seg.first[d] : seg.first[d + 1]].astype(np.int8)
            edge = np.flatnonzero(np.diff(own, prepend=0, append=0))
            spans[d] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return {"segment": [row["segment"]] * len(spans), "place": list(range(len(spans))), "doc_id": row["doc_ids"], "n_words": n_words.tolist(), "n_hit": n_hit.tolist(), "items": [sorted({what.ids[i] for i in x}) for x in items], "spans": spans}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = "segment long, place int, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    schema = to_arrow_schema(_parse_datatype_string(kind))
    return segments.mapInArrow(run, kind)


def item_blocks(benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded rows and bytes (a longer item is a block's, whole), dealt by hash; one block is on the driver at a time. Null texts have no words."""
    rows, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(utf8(F.col("text")))), F.lit(0))).first()
    n = max(1, -(-rows // block_items), -(-size // block_bytes))
    dealt = benchmark.select("item_id", utf8(F.col("text")).alias("t"), F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("b"))
    return ([(r[0], bytes(r[1])) for r in dealt.where(F.col("b") == k).select("item_id", "t").collect()] for k in range(n))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, span: int | None = None, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """search() over all docs and all items. Repeated documents are searched each; repeated items count once by id.

    With several blocks of items, each block in turn is searched over the same segments and what it finds is stored;
    then that is put together per document. A null item_id is named by the empty string. Empty benchmark: no hits.
    Empty docs: no rows. Other columns are ignored.
    """
    segments = index(docs)
    blocks = item_blocks(benchmark, block_items, block_bytes)
    first = search(segments, phrases(next(blocks), width), span)
    found = []
    for block in blocks:
        first = first if found else stored(first, "found")
        found.append(stored(search(segments, phrases(block, width), span).where("n_hit > 0"), "found"))
    if not found:
        return first.drop("segment", "place")
    every = reduce(DataFrame.unionByName, [first, *found]).groupBy("segment", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["end"] - 1))))
    return every.select("doc_id", "n_words", F.size(hit).cast("long").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort("spans").alias("spans"))


def sha256_of(items: Column) -> Column:
    """Lowercase hex digest of the ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
