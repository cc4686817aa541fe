"""Line deduplication by an exact set-similarity join over all lines of all documents.

A line is the set of its words. Words are ordered by rarity: those of the ``HEAD`` most frequent by their count
in the corpus, all others before these, by hash; any order that is the same everywhere keeps the join exact.
Lines of equal sets are one class. Two classes with Jaccard >= num / den share a word among the first
n - ceil(n * num / den) + 1 of each; they are compared if their lengths and the places of the shared word leave room
for enough overlap. A line goes if an earlier one (by doc_id, then line number) is similar, removed itself or not.

Classes post (word, length, place, 128 bits of the set) for the words of their prefixes. Tasks pack postings by bucket
of the word, so that few rows are shuffled, and a bucket's lists are compared at once: sorted by length, a class is held
against those of like length only, and in its list a class names the earlier one that its bits differ least from. Lists
longer than a tile are compared in square tiles of hashed blocks. The named pairs are verified on the words; for classes
that a failed pair leaves undecided, their lists are compared once more with the words at hand, exactly. Each step makes
at most a row per posting. Words and sets are compared by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import CHUNK_BYTES, SPACED, Overlaps, bounded, by_batch, by_list, dropped, mix, small, steps, stored, utf8, words

HEAD = 1 << 19
#: Bytes of text of a step that makes sets: its arrays of eight bytes a character or word stay in the processor's cache.
SET_BYTES = CHUNK_BYTES >> 1
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 20
#: Postings of a word that are compared at a time; longer lists are cut into blocks, which meet two by two.
TILE = 8192
#: Postings of a bucket, about: a task holds one at a time, and the few of a batch.
BUCKET = 1 << 18


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line number (over all texts) and hash of each word; number of each text's first line, one more at the end."""
    start, _, hashes, _ = words(texts, SPACED)
    breaks = np.cumsum(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) == 10, dtype=np.int32)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return breaks[start].astype(np.int64), hashes, np.concatenate([[0], breaks[ends - 1]])


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, at = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
    return word, np.bincount(at, np.concatenate([n for _, n in found]), len(word)).astype(np.int64)


def step_of(n: np.ndarray) -> np.ndarray:
    """Counts as at most some 16000 steps that keep their order."""
    return np.where(n < 4096, n, 4096 + (256 * np.log2(np.maximum(n, 4096) / 4096)).astype(np.int64))


def frequent_words(docs: DataFrame, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and their counts, least frequent first; all words of all texts are counted.

    They are those above the least step of counts that leaves at most ``head`` of them, which is what reaches the driver.
    """
    buckets = max(64, 2 * docs.rdd.getNumPartitions())
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)

    def table(counted: tuple[np.ndarray, np.ndarray]):
        word, n = counted
        cut = np.searchsorted(word, edges)
        cut = np.concatenate([cut, [len(word)]])
        some = np.flatnonzero(cut[1:] > cut[:-1])
        slices = [slice(cut[k], cut[k + 1]) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array([word[x].tobytes() for x in slices], pa.binary()), pa.array([n[x].tobytes() for x in slices], pa.binary())], names=["key", "words", "n"])

    def tally(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in steps(batch, "t", CHUNK_BYTES):
                _, _, word, _ = words([x or b"" for x in part.column("t").to_pylist()], SPACED)
                held.append(np.unique(word, return_counts=True))
                if sum(len(w) for w, _ in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield table(held.pop())
        if held:
            yield table(merged(held))

    def read(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.frombuffer(w, "<u8"), np.frombuffer(n, "<i8")) for w, n in zip(rows.column("words").to_pylist(), rows.column("n").to_pylist(), strict=True)]

    def add(rows: pa.Table) -> pa.Table:
        key = rows.column("key").to_numpy()
        out = [(k, *merged(read(rows.filter(pa.array(key == k))))) for k in np.unique(key).tolist()]
        return pa.table({"key": [k for k, _, _ in out], "words": pa.array([w.tobytes() for _, w, _ in out], pa.binary()), "n": pa.array([n.tobytes() for _, _, n in out], pa.binary())})

    def histogram(batches):
        for batch in batches:
            step, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(step_of(n) for _, n in read(pa.Table.from_batches([batch])))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], names=["step", "n"])

    schema = "key long, words binary, n binary"
    dealt = bounded(docs.select(utf8(F.col("text")).alias("t"))).mapInArrow(tally, schema).repartition("key").sortWithinPartitions("key")
    counts = stored(by_list(dealt, add, schema), "counts", "snappy")  # hashes don't compress
    sizes = counts.mapInArrow(histogram, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    least, left = 0, head
    for r in sizes:
        if (left := left - r.n) < 0:
            break
        least = r.step

    def chosen(batches):
        for batch in batches:
            found = read(pa.Table.from_batches([batch]))
            word, n = (np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in ((0, np.uint64), (1, np.int64)))
            keep = step_of(n) >= max(least, 1)
            yield pa.RecordBatch.from_arrays([pa.array(word[keep].view(np.int64)), pa.array(n[keep])], names=["word", "n"])

    top = counts.mapInArrow(chosen, "word long, n long").toArrow() if sizes and least else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    dropped(counts, release=False)
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((word, n))
    return word[order], n[order]


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-n * num // den)


def ranks(head: np.ndarray):
    """hashes -> 63-bit numbers that sort words by rarity: the place among the head words, 0 for others, above the hash."""
    order = np.argsort(head)
    held, place = head[order], (order + 1).astype(np.int32)
    shift = np.uint64(64 - max(1, len(held).bit_length()))
    # held words by their first bits: a word is looked for among the one or two that share them
    first = np.searchsorted(held >> shift, np.arange((1 << (64 - int(shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def of(hashes: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(hashes), np.uint64)
        part = (hashes >> shift).astype(np.int64)
        at, end = first[part], first[part + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = held[at] == hashes[left]
            rank[left[hit]] = place[at[hit]]
            at = at + 1
            keep = ~hit & (at < end)
            left, at, end = left[keep], at[keep], end[keep]
        return (rank << np.uint64(42)) | (hashes >> np.uint64(22))

    return of


def by_rarity(line: np.ndarray, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of words by line, rarity, and hash."""
    if not len(line):
        return np.zeros(0, np.int64)
    bits = max(1, int(line[-1]).bit_length())
    key = (line.astype(np.uint64) << np.uint64(64 - bits)) | (rank >> np.uint64(bits - 1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    # where the short key doesn't tell two words apart, the long one does
    return np.lexsort((word, rank, line)) if (same & (word[order][1:] != word[order][:-1])).any() else order


def bitmap(word: np.ndarray, begin: np.ndarray, half: int) -> np.ndarray:
    """Per line, 64 of 128 bits of its words' hashes: bits that differ between two lines are no more than words that differ."""
    bit = word >> np.uint64(57)
    own = np.where(bit >> np.uint64(6) == half, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
    return (np.bitwise_or.reduceat(own, begin) if len(begin) else own).view(np.int64)


def line_sets(docs: DataFrame, head: np.ndarray, num: int, den: int) -> DataFrame:
    """A row per line with a word: doc_id, dk (hash of the text), line (from 0), class, n (distinct words), b0 and b1 (bitmap), prefix (rarest first)."""

    ranked = ranks(head)

    def look(texts: list[bytes], more: dict) -> dict:
        line, word, first = line_words(texts)
        order = by_rarity(line, word, ranked(word))
        line, word = line[order], word[order]
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (word[1:] != word[:-1])]) if len(word) else np.zeros(0, bool)
        line, word = line[new], word[new]
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([begin, [len(line)]]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word), dtype=np.uint64)])
        kind = mix(total[begin + n] - total[begin] + n.astype(np.uint64))
        size = n - least_overlap(n, num, den) + 1
        inside = np.arange(len(line)) - np.repeat(begin, n) < np.repeat(size, n)
        number = line[begin]
        doc = np.searchsorted(first, number, "right") - 1
        return {
            "doc_id": more["doc_id"].take(pa.array(doc)),
            "dk": more["dk"].take(pa.array(doc)),
            "line": (number - first[doc]).astype(np.int32),
            "class": kind.view(np.int64),
            "n": n.astype(np.int32),
            "b0": bitmap(word, begin, 0),
            "b1": bitmap(word, begin, 1),
            "prefix": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(word[inside].view(np.int64))),
        }

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dk"), utf8(F.col("text")).alias("text_utf8"))
    return by_batch(texts, look, "doc_id long, dk long, line int, class long, n int, b0 long, b1 long, prefix array<long>", per_step=SET_BYTES)


def sets_of(need: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """ord, words (sorted hashes) of the classes numbered in need, from the texts that hold their first lines."""
    wanted = need.join(classes.select("ord", "doc_id", "dk", "line"), "ord").groupBy("doc_id", "dk").agg(F.collect_list(F.struct("line", "ord")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), utf8(F.col("text")).alias("text_utf8"))
    own = own.join(small(wanted, "wanted"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("dk") == F.col("key"))).select("wanted", "text_utf8")

    def look(texts: list[bytes], more: dict) -> dict:
        kinds, sets = [], []
        for text, lines in zip(texts, more["wanted"].to_pylist(), strict=True):
            rows = text.split(b"\n")
            _, _, h, first = words([rows[x["line"]] for x in lines], SPACED)
            for k, x in enumerate(lines):
                kinds.append(x["ord"])
                sets.append(np.unique(h[first[k] : first[k + 1]]).view(np.int64))
        return {"ord": kinds, "words": sets}

    # rows repeated whole give a class's words more than once
    out = stored(by_batch(own, look, "ord long, words array<long>").groupBy("ord").agg(F.first("words").alias("words")), "words", "snappy")
    dropped(wanted, release=False)
    return out


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b of classes by number) whose sets have the similarity."""
    found = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("ord")).distinct(), classes, docs)
    both = pairs.join(found.select(F.col("ord").alias("a"), F.col("words").alias("x")), "a").join(found.select(F.col("ord").alias("b"), F.col("words").alias("y")), "b")
    overlap = F.size(F.array_intersect("x", "y"))
    out = stored(both.where(overlap * den >= num * (F.size("x") + F.size("y") - overlap)).select("a", "b"), "similar")
    dropped(found, release=False)
    return out


POSTING = np.dtype([("ord", "<i8"), ("b0", "<i8"), ("b1", "<i8"), ("key", "<u4"), ("n", "<u4"), ("pos", "<u4")])


def long_lists(classes: DataFrame, often: np.ndarray) -> dict[int, int]:
    """Blocks of the lists that are longer than a tile, by word; only words of often (sorted) may have one."""
    if not len(often):
        return {}

    def tally(batches):
        for batch in batches:
            word = batch.column(0).flatten().to_numpy().view(np.uint64)
            found, n = np.unique(word[np.isin(word, often)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "m"])

    counts = classes.select("prefix").mapInArrow(tally, "word long, m long").groupBy("word").agg(F.sum("m").alias("m"))
    return {r.word & ((1 << 64) - 1): -(-r.m // TILE) for r in counts.where(F.col("m") > TILE).collect()}


def packed(classes: DataFrame, blocks: dict[int, int], buckets: int) -> DataFrame:
    """bucket and postings: the postings of a batch of classes for a bucket, in the POSTING layout.

    The list of a word is told by its bucket and 32 bits; a posting of a long list goes to as many tiles as that has blocks.
    """
    long = np.array(sorted(blocks), np.uint64)

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ord_, prefix = batch.column("ord").to_numpy(), batch.column("prefix")
            size = np.diff(prefix.offsets.to_numpy())
            word, of = prefix.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(batch.num_rows), size)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            key = mix(word)
            if len(long):
                extra = [(key[~np.isin(word, long)], *(x[~np.isin(word, long)] for x in (of, pos)))]
                for i in np.flatnonzero(np.isin(word, long)).tolist():
                    m = blocks[int(word[i])]
                    own, other = int(mix(ord_[of[i] : of[i] + 1].view(np.uint64))[0]) % m, np.arange(m, dtype=np.uint64)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    extra.append((mix(key[i] ^ mix(low * np.uint64(m) + high)), np.full(m, of[i]), np.full(m, pos[i])))
                key, of, pos = (np.concatenate(x) for x in zip(*extra, strict=True))
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            rows = np.empty(len(key), POSTING)
            rows["key"], rows["pos"] = key & np.uint64(0xFFFFFFFF), pos
            for name in ("ord", "n", "b0", "b1"):
                rows[name] = batch.column(name).to_numpy()[of]
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = rows[order]
            some = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())], names=["key", "postings"])

    return classes.select("ord", "n", "b0", "b1", "prefix").mapInArrow(pack, "key int, postings binary")


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The postings of a bucket, sorted by list and length."""
    rows = np.concatenate([np.frombuffer(x, POSTING) for x in blobs])
    order = np.argsort((rows["key"].astype(np.uint64) << np.uint64(32)) | rows["n"])
    out = {name: rows[name][order] for name in POSTING.names}
    return {**out, "key": out["key"].astype(np.int64)}


def meetings(c: dict[str, np.ndarray], num: int, den: int):
    """Places of the earlier and the later posting of a list, and bits that differ, of pairs that lengths, places and bits let be similar."""
    key, n, pos, size = c["key"], c["n"].astype(np.int64), c["pos"].astype(np.int64), len(c["key"])
    b0, b1 = c["b0"].view(np.uint64), c["b1"].view(np.uint64)
    # the shorter of a pair (the first, by the order) needs room for an overlap with one of its own length at least
    i, d = np.flatnonzero((n - pos) * (num + den) >= 2 * num * n), 1
    while len(i := i[i + d < size]):
        j = i + d
        i = i[(key[j] == key[i]) & (n[i] * den >= num * n[j])]
        j = i + d
        x = i[np.minimum(n[i] - pos[i], n[j] - pos[j]) * (num + den) >= num * (n[i] + n[j])]
        y = x + d
        differ = np.bitwise_count(b0[x] ^ b0[y]).astype(np.int64) + np.bitwise_count(b1[x] ^ b1[y])
        may = ((n[x] + n[y] - differ) * (num + den) >= 2 * num * (n[x] + n[y])) & (c["ord"][x] != c["ord"][y])
        if may.any():
            early, late = np.where(c["ord"][x[may]] < c["ord"][y[may]], (x[may], y[may]), (y[may], x[may]))
            yield early, late, differ[may]
        d += 1


MET = "list long, ord long, n int, pos int, b0 long, b1 long, near long, more boolean"


def met(blobs: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """The postings of pairs that lengths, places and bits don't tell apart; near is the earlier class that differs least, more whether there are others."""
    none = np.iinfo(np.int64).max

    def look(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        c = unpacked(blobs)
        best, seen, used = np.full(len(c["key"]), none), np.zeros(len(c["key"]), np.int64), np.zeros(len(c["key"]), bool)
        for early, late, differ in meetings(c, num, den):
            np.minimum.at(best, late, (differ << 54) | c["ord"][early])
            np.add.at(seen, late, 1)
            used[early] = used[late] = True
        k = np.flatnonzero(used)
        near = pa.array(best[k] & ((1 << 54) - 1), mask=best[k] == none)
        columns = {"list": (bucket << 32) | c["key"][k], "ord": c["ord"][k], "n": c["n"][k].astype(np.int32), "pos": c["pos"][k].astype(np.int32), "b0": c["b0"][k], "b1": c["b1"][k], "near": near, "more": seen[k] > 1}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        held: list[bytes] = []
        bucket = None
        for batch in batches:
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key != bucket and held:
                    yield look(bucket, held)
                    held = []
                bucket = key
                held.append(batch.column("postings")[i].as_py())
        if held:
            yield look(bucket, held)

    # a partition has some two buckets, and so do its Arrow batches
    return blobs.repartition(buckets // 2, "key").sortWithinPartitions("key").mapInArrow(run, MET)


def settled(posts: DataFrame, num: int, den: int) -> DataFrame:
    """b: the undecided classes (column open) that are similar to an earlier one of a list, by the words of both."""

    def look(rows: pa.Table) -> pa.Table:
        c = {name: rows.column(name).to_numpy() for name in ("key", "ord", "n", "pos", "b0", "b1")}
        open_, sets = rows.column("open").to_numpy(zero_copy_only=False), rows.column("words").combine_chunks()
        at, gone = sets.offsets.to_numpy().astype(np.int64), np.zeros(len(rows), bool)
        lists = Overlaps(sets.flatten().to_numpy(), at := at - at[0])
        for early, late, _ in meetings(c, num, den):
            for a, b in zip(early.tolist(), late.tolist(), strict=True):
                if open_[b] and not gone[b]:
                    both = int(lists.of(b, np.array([a]))[0])
                    gone[b] = both * den >= num * (at[a + 1] - at[a] + at[b + 1] - at[b] - both)
        return pa.table({"b": c["ord"][gone]})

    return by_list(posts.withColumnRenamed("list", "key").repartition("key").sortWithinPartitions("key", "n"), look, "b long")


def removed_classes(classes: DataFrame, docs: DataFrame, often: np.ndarray, num: int, den: int) -> DataFrame:
    """ord of the classes that are similar to an earlier class."""
    c = F.col
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = total // BUCKET + 8
    found = stored(met(packed(classes, long_lists(classes, often), buckets), buckets, num, den), "met", "snappy")
    pairs = stored(found.where("near IS NOT NULL").select(c("near").alias("a"), c("ord").alias("b")).distinct(), "near")
    gone = stored(similar(pairs, classes, docs, num, den).select(c("b").alias("ord")).distinct(), "gone")
    # a class that its nearest fails is undecided where a list has others
    undecided = stored(found.where("more").join(gone, "ord", "left_anti").select("list", "ord").distinct(), "undecided")
    again = found.drop("near", "more").join(small(undecided.select("list").distinct()), "list", "left_semi")
    again = stored(again.join(small(undecided.withColumn("open", F.lit(True))), ["list", "ord"], "left").fillna(False, ["open"]), "again", "snappy")
    dropped(found, pairs, undecided)
    sets = sets_of(again.select("ord").distinct(), classes, docs)
    more = stored(settled(again.join(sets, "ord"), num, den).distinct(), "gone")
    dropped(again, sets, release=False)
    return gone.unionByName(more.select(c("b").alias("ord")))


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, dk and removed (sorted line numbers from 0) of the documents that lose lines.

    Lines are split at \\n; lines without words never go. A row repeated whole is one document, and keeps its lines
    once decided; rows that share an id but not a text are told apart by dk, the hash of the text. A null doc_id comes
    before all others. Other columns are ignored. Empty docs: no rows.
    """
    c = F.col
    head, counts = frequent_words(docs)
    # a word outside the head is no more frequent than the head's least; a list is at most that long, or cut into tiles
    often = np.sort(head[counts > TILE])
    lines = stored(line_sets(docs, head, num, den), "lines", "snappy")
    place = lines.select("doc_id", "dk", "line", "class")
    kinds = lines.groupBy("class").agg(F.min(F.struct("doc_id", "dk", "line")).alias("f"), *(F.first(x).alias(x) for x in ("n", "b0", "b1", "prefix")), F.count("*").alias("n_lines"))
    kinds = stored(kinds.select("class", "f.*", "n", "b0", "b1", "prefix", "n_lines"), "kinds", "snappy")
    # classes are numbered in the order of their first lines: one long is a class's key and its place in time
    classes = stored(kinds.orderBy("doc_id", "dk", "line").withColumn("ord", F.monotonically_increasing_id()), "classes", "snappy")
    dropped(kinds)
    gone = removed_classes(classes, docs, often, num, den)
    marked = classes.select("class", c("doc_id").alias("f_doc"), c("dk").alias("f_dk"), c("line").alias("f_line"), "n_lines", "ord").join(gone.withColumn("gone", F.lit(True)), "ord", "left")
    first = c("doc_id").eqNullSafe(c("f_doc")) & (c("dk") == c("f_dk")) & (c("line") == c("f_line"))
    marked = stored(marked.where("gone OR n_lines > 1").drop("ord"), "marked")
    out = place.join(small(marked), "class").where(F.coalesce("gone", F.lit(False)) | ~first)
    out = stored(out.groupBy("doc_id", "dk").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    dropped(lines, classes, gone, marked)
    return out


def line_count(text: Column) -> Column:
    """Pieces that \\n parts a text into, counted by bytes; a null text has none."""
    return F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))


def decisions(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_lines (split at \\n; null text: 0), n_removed and removed (line numbers from 0) of every row."""
    removed = small(removed_lines(docs, num, den), "removed").withColumnRenamed("doc_id", "__id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__dk"), line_count(F.col("text")).alias("n_lines"))
    none = F.array().cast("array<int>")
    return own.join(removed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__dk") == F.col("dk")), "left").select("doc_id", "n_lines", F.size(F.coalesce("removed", none)).alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the lines in removed (of removed_lines) taken out of text; documents that keep no word, but had one, are left out."""
    gone = small(removed, "removed").select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk"), F.col("removed").alias("__removed"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__dk")), "left")
    out = joined.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept))
    return out.where(F.col("__removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def deduplicated(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    return without(docs, removed_lines(docs, num, den))
