"""op11 to op13 against brute-force versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from holosna.llm import manifest, odd_sketch, resampling
from holosna.llm.common import ranked, shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, grp string, n long, node string, key long, class long, root long, bucket int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(50)]
    for t in texts[:30]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1].upper(), "", None, " \n\t", "word", "Éa-b c_d über" * 9, " ".join(rng.choices(words, k=200_000))]
    out = [(i, t, rng.choice(["en", "de", None, "ß", "fr"]), None if i % 9 == 0 else "s", None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[4], "en", "s", 1), (None, "word", None, None, None), (7, "another text of an id that is shared", "xx", "s", 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "g", 2, "n", 3, 4, 5, 6) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hexed("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def beside(tree, i):
    out = []
    for level in tree[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else None)
        i >>= 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 16, 31])
def test_traversal_of_a_block(n):
    leaves = [hexed(str(i)) for i in range(n)]
    tree = levels(leaves)
    height = manifest.heights(n, 5)
    assert list(manifest.paths(leaves, height)) == [beside(tree, i) for i in range(n)] and manifest.root(leaves, height) == tree[-1][0]


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_tree_of_tiers(spark, bits):
    groups = {"a": 1, "b": 2, "c": 3, "d": 37, "e": 64, "": 9}
    nodes = {g: [hexed(f"{g}{i}") for i in range(n)] for g, n in groups.items()}
    df = spark.createDataFrame([(g, i, len(x), y) for g, x in nodes.items() for i, y in enumerate(x)], "grp string, at long, n long, node string").repartition(7)
    got = manifest.tree(df, bits).withColumn("leaf", F.lit(None)).collect()
    assert len(got) == sum(groups.values())
    for r in got:
        tree = levels(nodes[r.grp])
        assert r.root == tree[-1][0] and r.path == beside(tree, r.at)


def test_manifest(spark, docs, rows, empty):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    say = lambda r: hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, say(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: levels([x[2] for x in sorted(groups[g])]) for g in order}
    top = levels([own[g][-1][0] for g in order])
    want = collections.Counter()
    for k, g in enumerate(order):
        for i, leaf in enumerate(own[g][0]):
            want[leaf, own[g][-1][0], top[-1][0], tuple(beside(own[g], i)), tuple(beside(top, k))] += 1
    wrong = F.sha2(F.lit("x"), 256)
    made = manifest.manifest(docs, columns, "lang", ["doc_id"], F.col("doc_id"), wrong.alias("wrong"))
    fold = lambda leaf: manifest.folded(manifest.folded(F.col(leaf), F.col("own_at"), F.col("own_path")), F.col("top_at"), F.col("top_path"))
    got = made.select("*", (fold("leaf") == F.col("root")).alias("right"), (fold("wrong") == F.col("root")).alias("bad"), manifest.proof(F.col("own_path")).alias("proof")).collect()
    assert collections.Counter((r.leaf, r.subroot, r.root, tuple(r.own_path), tuple(r.top_path)) for r in got) == want
    assert all(r.right and not r.bad and r.proof == hexed("".join(x or "" for x in r.own_path)) for r in got)
    assert manifest.manifest(empty, columns, "lang", ["doc_id"]).count() == 0
    assert manifest.manifest(docs.where("doc_id = 6"), columns, "lang", ["doc_id"]).select("leaf", "subroot", "root").distinct().count() == 1


def test_ranked(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 50 * 7 % 31).alias("v"), F.lit(0).alias("n2")).repartition(6)
    got = ranked(df, ["g"], [F.col("v").desc()]).toPandas()
    for _, own in got.groupby("g"):
        own = own.sort_values("at")
        assert own["at"].tolist() == list(range(len(own))) and own["v"].is_monotonic_decreasing and set(own["n"]) == {len(own)}


def brute_draw(rows, target, order, buckets, seed, least, percent):
    grams = lambda t: [" ".join(w[i - k + 1 : i + 1]) for w in [[x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]] for i in range(len(w)) for k in range(1, order + 1) if i - k + 1 >= 0]
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = collections.Counter(at(g) for r in rows for g in grams(r[1])), collections.Counter(at(g) for x in target for g in grams(x))
    total = lambda c: float(sum(c.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total(s) + buckets) / ((s[b] + 1) * (total(t) + buckets)))) for b in range(buckets)]
    out = []
    for r in rows:
        own = grams(r[1])
        h = int(hexed(f"{seed}:{'' if r[0] is None else r[0]}")[:8], 16)
        weight = sum(gain[at(g)] for g in own)
        n_words = len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").encode().lower()))
        out.append([r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words >= least])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[2]))
    for k, x in enumerate(may[: len(may) * percent // 100], 1):
        x[4] = k
    return out


@pytest.mark.parametrize("order, buckets, percent", [(1, 10000, 10), (3, 70000, 60), (2, 50, 100)])
def test_resampling(spark, docs, rows, empty, order, buckets, percent):
    target = [rows[2][1], rows[5][1] + " changed", None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(docs, bench, order, buckets, 11, 20, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same = lambda x: sorted(map(repr, x))
    assert same(tuple(r) for r in got.collect()) == same(tuple(x[:5]) for x in brute_draw(rows, target, order, buckets, 11, 20, percent))
    assert resampling.resampled(empty, bench).count() == 0 and resampling.resampled(docs, empty).count() == len(rows)


def test_ring_of_states():
    words = [b"a", b"bc", b"\xc3\xa9", b"d" * 999]
    for order in (1, 2, 3, 9):
        want = [zlib.crc32(b" ".join(words[i - k : i + 1])) for i in range(4) for k in range(min(i, order - 1), -1, -1)]
        assert resampling.scan(words, order) == want
    assert resampling.scan([], 2) == []


@pytest.mark.parametrize("width, num, den", [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates(spark, docs, rows, empty, width, num, den):
    found = shingle_sets([(r[1] or "").encode() for r in rows], width)
    root = list(range(len(rows)))
    for i, x in enumerate(found):
        for j in range(i):
            both = len(np.intersect1d(x, found[j]))
            if len(x) and len(found[j]) and den * both >= num * (len(x) + len(found[j]) - both):
                root = [root[i] if r == root[j] else r for r in root]
    least = {}
    for r, k in zip(rows, root, strict=True):
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    got = odd_sketch.near_duplicates(docs, width, num, den)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(r[0], len(x), least[k], r[0] == least[k]) for r, x, k in zip(rows, found, root, strict=True)]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert odd_sketch.near_duplicates(empty).count() == 0


def test_sketches_estimate_high_similarities():
    rng, scheme = np.random.default_rng(3), odd_sketch.OddSketches(85, 100)
    for j, most in ((0.97, 0.03), (0.9, 0.06), (0.85, 0.08)):
        errors, over = [], 0
        for _ in range(150):
            n = 400
            both, apart = round(n * j), n - round(n * j)
            x = rng.integers(0, 1 << 63, both + apart, dtype=np.uint64)
            a, b = np.sort(x[: both + apart // 2]), np.sort(np.concatenate([x[:both], x[both + apart // 2 :]]))
            s = odd_sketch.sketches(odd_sketch.samples_of([a, b], 160), 512).view(np.uint64)
            differ = int(np.bitwise_count(s[0] ^ s[1]).sum())
            errors.append(abs(odd_sketch.estimate(differ) - j))
            over += not scheme.may_link(len(a), len(b), differ)
        assert np.mean(errors) < most and over == 0
    # sets that share little are told apart by the sketch alone
    x = [np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(60)]
    s = odd_sketch.sketches(odd_sketch.samples_of(x, 160), 512).view(np.uint64)
    assert all(not scheme.may_link(300, 300, np.bitwise_count(s[i] ^ s[j]).sum()) for i in range(60) for j in range(i))


def test_common_bands():
    values = np.arange(320, dtype=np.uint32).reshape(2, 160)
    values[1, :5] = values[0, :5]
    same = odd_sketch.bands(values, 5)[0] == odd_sketch.bands(values, 5)[1]
    assert same.tolist() == [True] + [False] * 31
