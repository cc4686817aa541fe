"""N-gram Jaccard join over size-banded tiles, exact for every link.

Sets of equal shingles are one class. Class sizes fall into bands; a tile holds the classes of a band and those just
small enough below it to link into it. In a tile two linked sets differ in at most k shingles, k from the tile's
largest size, so if the hash range is cut into more than k parts, some part is equal in both: classes meet by
(tile, part, content of the part). A passage that many texts share is rarely all that a part holds, so it makes few
meetings. Parts are cut finer (``spare``), so that linked sets share an equal part that isn't empty, and empty parts
are left out unless a class has more than ``spare`` of them. These must be few: an empty part is alike in a share of
all such classes, so its meetings grow with the input, and the pairs in them with its square.

Classes that meet are compared with the first of their meeting, and, where the meeting then still spans components,
with a few more; components of these links are found. Only meetings that still span some, each set of members once,
are looked at whole, in square tiles of bounded rows, by size and bitmap: the bits that differ bound the overlap from
above. A tile names the classes that some class of another component may link to, one row each, and which components
it holds together; so all possible links lie inside groups of components, and groups are far smaller than meetings are
many. The classes of a group meet once more with their sorted arrays, in tiles again, for the exact intersections. A
tile joins the components that it links as it goes, so it makes at most as many links as it has rows.
Shingles, parts and classes are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import Overlaps, by_batch, by_list, dropped, mix, shingle_sets, small, stored, utf8
from holosna.llm.components import components

BAND, TILE_ROWS = 1.6, 4096
#: Classes of a group that a tile holds with their arrays, if these have so many shingles each on average; of longer ones fewer.
GROUP_ROWS, GROUP_SHINGLES = 2048, 512
#: 64-bit words of the bitmaps that tiles of meetings compare, at least (they grow with the set, see narrow_width), of
#: those that pairs are held against before their texts are read; bits a shingle, at least, in tiles of groups.
NARROW, WIDE, TILE_BITS = 16, 96, 8
#: Classes of a meeting that the others are compared with in the second step.
STARS = 3


@cache
def spare(k: int, n: int) -> int:
    """Parts beyond k + 1: so many that sets of n shingles or more have as many empty ones at most, but for some in a thousand.

    Where twice k parts don't do (low similarities), more of them would not pay: one or two.
    """
    if k == 0:
        return 0
    for extra in range(few := 1 if k < 10 else 2, k + 8, max(1, k // 100)):
        parts = k + 1 + extra
        one, two = (1 - 1 / parts) ** n, (1 - 2 / parts) ** n  # that a part, that two given ones are empty
        mean = parts * one
        if mean + 3 * math.sqrt(max(0, mean + parts * (parts - 1) * two - mean * mean)) <= extra:
            return extra
    return few


@cache
def band_edges(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return out


@cache
def tile_of(band: int, num: int, den: int) -> tuple[int, int, int]:
    """Of the tile of a band: the smallest size that links into it, the most differing shingles, the number of parts."""
    low, high = band_edges()[band], band_edges()[band + 1] - 1
    k = 2 * high - 2 * -(-num * 2 * high // (num + den))  # |A| + |B| - 2 * least overlap, at the largest sizes
    k = max(k, math.floor((den - num) * 2 * high / (num + den)))
    least = -(-num * low // den)
    return least, k, k + 1 + spare(k, least)


def keys(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """The meetings of a set (sorted hashes) in its own band's tile and in the next one, if it can link into that."""
    edges, n, out = band_edges(), len(x), []
    own = int(np.searchsorted(edges, n, "right")) - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)])
    for band in (own, own + 1):
        least, k, parts = tile_of(band, num, den)
        if k == 0 or n < least:  # without a difference: equal sets, which are one class
            continue
        cut = np.searchsorted(x, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts))
        cut = np.concatenate([[0], cut, [n]])
        content = total[cut[1:]] - total[cut[:-1]]
        key = mix(content + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)))
        empty = cut[1:] == cut[:-1]
        out.append(key if empty.sum() > parts - k - 1 else key[~empty])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def narrow_width(n: int) -> int:
    """Words of the bitmap of a set of n: a power of two, of 1.5 to 3 bits a shingle, so that long sets don't fill it."""
    return max(NARROW, 1 << (-(-3 * n // 128) - 1).bit_length())


def signature(x: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of the set: bits that differ between two bitmaps are no more than shingles that differ."""
    bits = np.zeros(size * 64, np.uint8)
    bits[(x % np.uint64(size * 64)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8")


def row_key() -> Column:
    """Tells rows apart by id and text, either of which may be null."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def class_of(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


@dataclass(frozen=True)
class Bands:
    """How sets meet, and what is known of a pair before the sets are read: here by equal parts, and by bitmaps that bound the overlap."""

    num: int
    den: int

    def features(self, own: list[np.ndarray]) -> dict[str, list]:
        """keys (meetings), narrow and wide (bitmaps as 64-bit words, for tiles of meetings and for pairs) of sets that aren't empty."""
        return {
            "keys": [keys(x, self.num, self.den).view(np.int64) for x in own],
            "narrow": [signature(x, narrow_width(len(x))) for x in own],
            "wide": [signature(x, WIDE) for x in own],
        }

    def may_link(self, na, nb, differ):
        """Whether sets of these sizes whose bitmaps differ in so many bits may link, for columns and arrays alike: 2 * overlap <= na + nb - differ."""
        most = (na + nb - differ) / 2
        return most * self.den >= self.num * (na + nb - most)


def sets(docs: DataFrame, width: int, scheme: Bands) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, class (hash of the set; null if empty), keys and bitmaps of every row."""

    def look(texts: list[bytes], more: dict) -> dict:
        own = shingle_sets(texts, width)
        made = scheme.features([x for x in own if len(x)])
        made = {k: iter(v) for k, v in made.items()}
        return {
            "doc_id": more["doc_id"],
            "row": more["row"],
            "n_shingles": [len(x) for x in own],
            "class": [class_of(x) if len(x) else None for x in own],
        } | {k: [next(v) if len(x) else [] for x in own] for k, v in made.items()}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), utf8(F.col("text")).alias("text_utf8"))
    return by_batch(texts, look, "doc_id long, row long, n_shingles long, class long, keys array<long>, narrow array<long>, wide array<long>")


def possible(scheme: Bands) -> Column:
    """Whether sizes and bitmaps let a pair with columns na, nb, sa, sb link."""
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return scheme.may_link(F.col("na"), F.col("nb"), differ) & (F.least("na", "nb") * scheme.den >= scheme.num * F.greatest("na", "nb"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, scheme: Bands) -> DataFrame:
    """The pairs (a, b of classes) whose sets do link: bitmaps first, then the sorted arrays of the texts."""
    short = classes.select("class", "n_shingles", "wide", "row")
    side = lambda x: short.select(F.col("class").alias(x), F.col("n_shingles").alias("n" + x), F.col("wide").alias("s" + x), F.col("row").alias("f" + x))
    # the shuffle moves texts, which are half the size of their arrays, and only those of classes in a possible pair
    likely = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(possible(scheme)).select("a", "b", "fa", "fb"), "likely")
    need = stored(likely.select(F.col("a").alias("class"), F.col("fa").alias("id")).unionByName(likely.select(F.col("b").alias("class"), F.col("fb").alias("id"))).distinct(), "need")
    texts = docs.select(row_key().alias("id"), utf8(F.col("text")).alias("t")).join(small(need), "id").select("class", "t")
    texts = stored(by_class(texts, width), "texts")
    both = likely.select("a", "b").join(texts.select(F.col("class").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("class").alias("b"), F.col("t").alias("text_utf8")), "b")

    def look(found: list[bytes], more: dict) -> dict:
        first = [x or b"" for x in more["ta"].to_pylist()]
        kinds = {t: i for i, t in enumerate(dict.fromkeys(first + found))}
        own = shingle_sets(list(kinds), width)
        keep = []
        for p, q in zip(first, found, strict=True):
            x, y = own[kinds[p]], own[kinds[q]]
            both_ = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(scheme.den * both_ >= scheme.num * (len(x) + len(y) - both_))
        return {"a": more["a"].filter(pa_mask(keep)), "b": more["b"].filter(pa_mask(keep))}

    out = stored(by_batch(both, look, "a long, b long"), "verified")
    dropped(likely, need, texts)
    return out


def pa_mask(keep: list[bool]):
    import pyarrow as pa

    return pa.array(keep, pa.bool_())


def by_class(texts: DataFrame, width: int) -> DataFrame:
    """One text a class, of rows repeated whole; the hash of the set is compared once more."""

    def look(found: list[bytes], more: dict) -> dict:
        import pyarrow as pa

        keep = [class_of(x) == c for x, c in zip(shingle_sets(found, width), more["class"].to_pylist(), strict=True)]
        return {"class": more["class"].filter(pa.array(keep, pa.bool_())), "t": pa.array([t for t, k in zip(found, keep, strict=True) if k], pa.binary())}

    return by_batch(texts.select("class", F.col("t").alias("text_utf8")), look, "class long, t binary").dropDuplicates(["class"])


def meetings(classes: DataFrame) -> DataFrame:
    """key, class and rep (the least class) of the classes of each key that several have.

    One exchange, sorted; a task looks at a row and the ones beside it, so it holds a batch however many classes a key has.
    """
    import pyarrow as pa

    def run(batches):
        held, rep, inside = None, None, False  # the last row so far, its rep, and whether the row before is of its key
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls = batch.column("key").to_numpy(), batch.column("class").to_numpy()
            if held is not None:
                key, cls = np.append(held[0], key), np.append(held[1], cls)
            new = np.append(held is None or not inside, key[1:] != key[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            reps = cls[start]
            if not new[0]:
                reps[start == 0] = rep
            shared = ~new | np.append(key[1:] == key[:-1], False)
            keep = shared[:-1]
            yield pa.RecordBatch.from_pydict({"key": key[:-1][keep], "class": cls[:-1][keep], "rep": reps[:-1][keep]})
            held, rep, inside = (key[-1:], cls[-1:]), reps[-1], not new[-1]
        if held is not None and inside:
            yield pa.RecordBatch.from_pydict({"key": held[0], "class": held[1], "rep": np.array([rep])})

    meet = classes.select(F.explode("keys").alias("key"), "class")
    return meet.repartition("key").sortWithinPartitions("key", "class").mapInArrow(run, "key long, class long, rep long")


def placed_in(met: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The meetings' classes with their components' roots, and the meetings of three or more that span components."""
    placed = met.join(roots, met["class"] == roots["node"], "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("members"), *(F.min(F.struct(F.xxhash64("class", F.lit(k)).alias("h"), "class", "root")).alias(f"s{k}") for k in range(STARS)))
    return placed, open_.where("low <> high AND n > 2")


def more_stars(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of each class with STARS others of its meeting, the same few in most meetings of a group, if their components differ."""
    placed, open_ = placed_in(met, roots)
    reps = open_.select("key", F.explode(F.array(*(f"s{k}" for k in range(STARS)))).alias("rep"))
    return placed.join(reps, "key").where("rep.root <> root").select(F.least("class", "rep.class").alias("a"), F.greatest("class", "rep.class").alias("b")).distinct()


def arrays(need: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """class and words (sorted shingles) of the classes in need, from their texts."""
    need = stored(classes.join(need, "class", "left_semi").select("class", F.col("row").alias("id")), "need")
    texts = docs.select(row_key().alias("id"), utf8(F.col("text")).alias("t")).join(small(need), "id").select("class", F.col("t").alias("text_utf8"))

    def look(found: list[bytes], more: dict) -> dict:
        own = [(c, x.view(np.int64)) for c, x in zip(more["class"].to_pylist(), shingle_sets(found, width), strict=True) if class_of(x) == c]
        return {"class": [c for c, _ in own], "words": [x for _, x in own]}

    # rows repeated whole give a class more than once
    out = stored(by_batch(texts, look, "class long, words array<long>").groupBy("class").agg(F.first("words").alias("words")), "arrays")
    dropped(need)
    return out


def blocked(rows: DataFrame, size: DataFrame, most: int) -> DataFrame:
    """rows (key, class, …) in tiles of about ``most`` classes, or two blocks of half as many: adds block and two, and tells key by tile."""
    half = max(1, most // 2)
    blocks = F.when(F.col("n") <= most, F.lit(1)).otherwise(F.ceil(F.col("n") / half)).cast("int")
    rows = rows.join(size, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return rows.withColumn("key", F.xxhash64("key", i, j)).withColumn("two", i != j).drop("n", "blocks", "other")


def by_tile(rows: DataFrame, f, schema: str) -> DataFrame:
    """f of each tile, which stays whole in a partition and in order, so that a tile is all that a task holds besides a batch."""
    import pyarrow as pa

    def look(table):
        made = [f(table.slice(s, e - s)) for s, e in runs(table.column("key").to_numpy())]
        return pa.concat_tables(made)

    return by_list(rows.repartition("key").sortWithinPartitions("key"), look, schema)


def crossing(met: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, width: int, scheme: Bands) -> DataFrame:
    """Links between classes that meet and lie in different components, enough of them to join all such components."""
    import pyarrow as pa

    placed, open_ = placed_in(met, roots)
    # meetings of the same members are looked at once
    size = stored(open_.groupBy("n", "members").agg(F.min("key").alias("key")).select("key", "n"), "open")
    rows = blocked(placed.join(size.select("key"), "key", "left_semi"), size, TILE_ROWS).join(classes.select("class", "n_shingles", F.col("narrow").alias("signature")), "class")
    rows = rows.repartition("key").sortWithinPartitions("key")
    near = stored(by_list(rows, lambda t: possible_rows(t, scheme), "class long, root long, rep long, n_shingles long").distinct(), "near")
    groups = stored(components(near.select(F.col("root").alias("a"), F.col("rep").alias("b"))).toDF("root", "key"), "groups")
    inside = stored(near.select("class", "root", "n_shingles").distinct().join(groups, "root"), "inside")
    # a tile is bounded by what its arrays hold, so a group of long sets counts as one of more rows
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES))
    sizes = stored(inside.groupBy("key").agg(weight.alias("n")), "sizes")
    inside = inside.drop("n_shingles")
    sets_ = arrays(inside.select("class"), classes, docs, width)

    def look(t):
        links = tile(t, scheme.num, scheme.den)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    out = stored(by_tile(blocked(inside, sizes, GROUP_ROWS).join(sets_, "class"), look, "a long, b long"), "crossing")
    dropped(size, near, groups, inside, sizes, sets_)
    return out


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes one of the sets of a and b, pair by pair; parent names the least of each set, before and after."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def folded(lists, width: np.ndarray, least: int) -> np.ndarray:
    """Bitmaps (a list array of words) of unequal widths, folded to the least."""
    at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
    out = np.empty((len(width), least), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[rows] = np.bitwise_or.reduce(flat[at[rows][:, None] + np.arange(w)].reshape(len(rows), w // least, least), axis=1)
    return out


def possible_rows(table, scheme: Bands):
    """class, root, rep and n_shingles of the rows that size and bitmap let link to one of another component of their tile; rep is the least root of those held together.

    The table has whole tiles, rows of a key each. Most have a few rows, so all are looked at together: in order of tile
    and size, each row is held against the next one, then all against the one after, as long as tile and size allow.
    """
    import pyarrow as pa

    key, width = table.column("key").to_numpy(), table.column("signature").combine_chunks().value_lengths().to_numpy()
    # sizes in a tile differ less than twofold, so the least width of its bitmaps is near to all
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.repeat(np.minimum.reduceat(width, start), np.diff(np.append(start, len(key))))
    made = [_possible(table.filter(pa.array(least == w)), int(w), scheme) for w in np.unique(least)]
    return pa.concat_tables(made)


def _possible(table, least: int, scheme: Bands):
    import pyarrow as pa

    num, den = scheme.num, scheme.den
    key, n = table.column("key").to_numpy(), table.column("n_shingles").to_numpy()
    tile_ = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    order = np.lexsort((n, tile_))
    lists = table.column("signature").combine_chunks()
    bits = folded(lists, lists.value_lengths().to_numpy(), least)[order]
    cls, root, block, two = (table.column(c).to_numpy()[order] for c in ("class", "root", "block", "two"))
    n, size = n[order], len(order)
    # components by tile and root, numbered in this order: the least number is the least root
    by = np.lexsort((root, tile_))
    new = np.concatenate([[True], (root[by][1:] != root[by][:-1]) | (tile_[by][1:] != tile_[by][:-1])])
    own, low = np.empty(size, np.int64), root[by][new]
    own[by] = np.cumsum(new) - 1
    parent, used = np.arange(len(low)), np.zeros(size, bool)
    i, d = np.arange(size), 1
    while len(i := i[i + d < size]):
        i = i[(tile_[i + d] == tile_[i]) & (n[i] * den >= num * n[i + d])]
        x = i[(root[i] != root[i + d]) & ((block[i] != block[i + d]) | ~two[i])]
        x = x[scheme.may_link(n[x + d], n[x], np.bitwise_count(bits[x + d] ^ bits[x]).sum(1).astype(np.int64))]
        if len(x):
            used[x] = used[x + d] = True
            joined(parent, own[x], own[x + d])
        d += 1
    return pa.table({"class": cls[used], "root": root[used], "rep": low[parent[own[used]]], "n_shingles": n[used]})


def runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return [(s, e) for s, e in zip(edge[:-1], edge[1:], strict=True) if e > s]


def tile(table, num: int, den: int) -> list[tuple[int, int]]:
    """Links (a, b of classes) of a tile that join its components: by size, component, bitmap, and exact intersection."""
    cls, root, block = (table.column(c).to_numpy() for c in ("class", "root", "block"))
    two = bool(table.column("two")[0].as_py())
    words = table.column("words").combine_chunks()
    at, flat = words.offsets.to_numpy().astype(np.int64), words.flatten().to_numpy().view(np.uint64)
    at = at - at[0]
    n, own, lists = np.diff(at), np.unique(root, return_inverse=True)[1], Overlaps(flat, at)
    size = -(-TILE_BITS * int(n.max()) // 64)
    bits = np.stack([signature(flat[s:e], size).view(np.uint64) for s, e in zip(at[:-1], at[1:], strict=True)])
    links = []
    for x in range(len(cls) - 1):
        y = np.arange(x + 1, len(cls))
        y = y[(own[y] != own[x]) & ((block[y] != block[x]) | (not two)) & (np.minimum(n[y], n[x]) * den >= num * np.maximum(n[y], n[x]))]
        if len(y):
            most = (n[y] + n[x] - np.bitwise_count(bits[y] ^ bits[x]).sum(1).astype(np.int64)) / 2
            y = y[most * den >= num * (n[y] + n[x] - most)]
        if len(y):
            both = lists.of(x, y)
            for z in y[both * den >= num * (n[y] + n[x] - both)].tolist():
                if own[z] != own[x]:
                    links.append((int(cls[x]), int(cls[z])))
                    own[own == own[z]] = own[x]
    return links


def link(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, by equal parts and bitmaps; see linked."""
    return linked(docs, width, Bands(num, den))


def linked(docs: DataFrame, width: int, scheme: Bands) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links of Jaccard >= num / den (of the scheme) reach.

    Texts without words have no shingles and no links. Rows with equal sets link; so do repeated rows. A null doc_id
    links as any other, but never names a component unless all of it are null. Other columns are ignored. Empty docs:
    no rows.
    """
    every = stored(sets(docs, width, scheme), "sets")
    classes = stored(every.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("narrow").alias("narrow"), F.first("wide").alias("wide"), F.count("*").alias("n_docs")), "classes")
    member = stored(every.select("doc_id", "n_shingles", "class"), "member")
    dropped(every)
    met = stored(meetings(classes), "met")
    star = met.where("class <> rep").select(F.col("rep").alias("a"), F.col("class").alias("b")).distinct()
    links = verified(star, classes, docs, width, scheme)
    roots = stored(components(links), "roots")
    more = stored(more_stars(met.select("key", "class"), roots), "more")
    if not more.isEmpty():
        links = links.unionByName(verified(more, classes, docs, width, scheme))
        roots = stored(components(links), "roots")
    found = crossing(met.select("key", "class"), roots, classes, docs, width, scheme)
    if not found.isEmpty():
        roots = stored(components(links.unionByName(found)), "roots")
    dropped(more)
    dropped(met)
    placed = classes.join(roots, classes["class"] == roots["node"], "left").select("class", F.coalesce("root", "class").alias("root"), "first", "n_docs")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_classes"), F.sum("n_docs").alias("n_docs"))
    named = placed.select("class", "root").join(least.where("n_docs > 1"), "root").select("class", "component_id")
    return member.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
