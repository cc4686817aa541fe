"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties and repeats."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holosna.llm import chat, decontamination, language_id, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, first long, class string, word string"


def split(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().lower())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(60)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for t in texts[:25]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1].upper(), "", None, " \n\t", "word", " ".join(rng.choices(words, k=6000)), "a b c d e f g h a b c d e f g h", "é È über\n\né È über"]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, (3, texts[3]), (None, texts[4])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "c", "w") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(spark, docs, rows, empty):
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    got = quality_rules.judged(docs, trusted)
    assert got.count() == len(rows) and quality_rules.judged(empty, trusted).count() == 0
    for r in got.collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", r.text or "")
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_decontamination(spark, docs, rows, empty):
    long = rows[10][1].split()
    items = [(1, " ".join(long[2:14])), (2, "changed"), (3, None), (4, "nowhere at all"), (10, " ".join(long[:10])), (10, " ".join(long[:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = lambda t: split(t, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = collections.defaultdict(set)
    for i, t in items:
        w = own(t)
        for j in range(len(w) - min(10, len(w)) + 1) if w else ():
            want[tuple(w[j : j + min(10, len(w))])].add(str(i))

    def brute(text):
        w = own(text)
        found = [(j, g) for g in want for j in range(len(w) - len(g) + 1) if tuple(w[j : j + len(g)]) == g]
        return len(w), len({k for j, g in found for k in range(j, j + len(g))}), sorted(set().union(*(want[g] for _, g in found)))

    for blocks in (100, 2):
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r["items"]) for r in decontamination.matches(docs, bench, block_items=blocks).collect())
        assert got == sorted(((i is None, i or 0), *brute(t)) for i, t in rows)
    near = decontamination.matches(docs, bench.where("item_id = 1"), span=40).where("n_hit > 0")
    assert near.where("doc_id = 10").count() == 1
    assert decontamination.matches(empty, bench).count() == 0 and decontamination.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(3)
    odd = ["\\", "<|", "|>", "<|end|>", "<\\|", "|", "<", ">", "\n", "é", "a b"]
    turns = [(c, t, ["system", "user", "assistant"][0 if t == 0 and c % 2 else 1 + t % 2], None if rng.random() < 0.05 else "".join(rng.choices(odd, k=rng.randint(0, 40))) * rng.randint(1, 30)) for c in range(30) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, budget=256).cache()
    read = collections.defaultdict(list)
    loss = collections.defaultdict(str)
    for r in w.select("*", chat.own_turns(F.col("formatted"), F.col("n_context")).alias("own"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("masked")).orderBy("conv_id", "window").collect():
        read[r.conv_id] += [tuple(x) for x in r.own]
        loss[r.conv_id] += r.masked
        assert r.n_tokens <= 256 or len(r.own) - (r.own[0].role == "system") == 1
    for c in range(30):
        own = [(r, t or "") for k, _, r, t in sorted(turns, key=lambda x: x[:2]) if k == c]
        assert read[c] == own and loss[c] == "".join(t for r, t in own if r == "assistant")
    assert chat.windows(df.limit(0)).count() == 0


def test_language_id():
    rng = random.Random(1)
    speak = {"x": "abcde", "y": "vwxyz"}
    say = lambda k, n: " ".join("".join(rng.choices(speak[k], k=5)) for _ in range(n)).encode()
    p = np.full((2, 1 << 13), 0.5)
    for i, k in enumerate("xy"):
        _, b, n = language_id.counted([say(k, 3000)])
        p[i, b] += n
    model = language_id.Model(["x", "y"], (p / p.sum(1, keepdims=True)).astype(np.float32))
    full, chosen = language_id.inferred([say("x", 50), say("y", 50), say("x", 100) + b" " + say("y", 50), b"a"], model)
    assert full[0, 0] > 0.95 and full[1, 1] > 0.95 and 0.55 < full[2, 0] < 0.8
    assert (chosen[2] > 0).all() and (chosen[0] > 0).sum() == 1


def test_language_query(spark, docs, empty):
    model = language_id.train(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert got[0] == "en" and got[87] == "und" and got[88] == "und" and language_id.predict(empty, language_id.train(empty)).count() == 0


def test_packing(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path
    out = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=256).collect()
    assert packing.pack(empty, path("byte_bpe_50k.json"), capacity=256).count() == 0
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for _, x in rows for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 0]] for a, n in packing.cuts(len(ids), 256))
    assert sorted(r.ids_crc32 for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 256
    assert len(bins) <= 1.1 * sum(r.length for r in out) / 256 + 3


def test_sharding(spark, docs, rows, empty, tmp_path):
    got = sharding.shard(docs, f"file://{tmp_path}/m", 5, 64)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == len(rows) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shard(empty, f"file://{tmp_path}/e", 5, 64).count() == 0
    sums = [(v, 1, 10 + v % 7) for v in range(64)]
    old = sharding.first_map(sums, 5, 64)
    new = sharding.grown_map(old, sums, 6)
    assert all(new[v] in (old[v], 5) for v in old) and 5 in new.values()


def brute_components(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = split(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)].append(i)
    return sorted((i is None, i or 0, len(s), min(least[find(a)], default=None)) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "num", "den"), [(2, 1, 2), (3, 4, 5), (1, 17, 20)])
def test_ngram_join(spark, docs, rows, empty, k, num, den):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.link(docs, k, num, den).collect())
    assert got == brute_components(rows, k, num, den)
    if k == 3:
        assert ngram_join.link(empty, k, num, den).count() == 0


def test_ngram_keys_never_miss():
    rng = np.random.default_rng(5)
    for n in (5, 12, 40, 150, 700):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, int(0.16 * n)) + 1)
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[drop:]], rng.integers(0, 1 << 64, rng.integers(0, drop + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 0 < both < len(x) + len(y) - both and 100 * both >= 85 * (len(x) + len(y) - both):
                assert len(np.intersect1d(ngram_join.keys(x, 85, 100), ngram_join.keys(y, 85, 100)))


def test_ngram_tiles():
    """A tile joins all components that links of its sets join, by at most one link a row."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    sets = [np.sort(base[:n]) for n in (600, 640, 682, 683, 700)] + [np.sort(rng.integers(0, 1 << 63, 690, dtype=np.uint64)) for _ in range(3)]
    order = rng.permutation(len(sets)).tolist()
    table = pa.table({"key": [7] * 8, "two": [False] * 8, "block": [0] * 8, "class": order, "root": order, "words": pa.array([sets[i].view(np.int64) for i in order], pa.list_(pa.int64()))})
    found = ngram_join.tile(table, 85, 100)
    near = {(a, b) for a in range(5) for b in range(5) if len(sets[a]) >= 0.85 * len(sets[b])}
    assert len(found) == 4 and all((a, b) in near for a, b in found) and {x for p in found for x in p} == set(range(5))


def test_ngram_tiles_of_unequal_bitmaps():
    """Bitmaps of unequal widths in one tile are folded; every class that may link is named with its group, far ones aren't."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    sets = [np.sort(base[:n]) for n in (600, 640, 682, 683, 700)] + [np.sort(rng.integers(0, 1 << 63, 690, dtype=np.uint64))]
    assert {ngram_join.narrow_width(len(x)) for x in sets} == {16, 32}
    signatures = pa.array([ngram_join.signature(x, ngram_join.narrow_width(len(x))) for x in sets], pa.list_(pa.int64()))
    table = pa.table({"key": [7] * 6, "two": [False] * 6, "block": [0] * 6, "class": range(10, 16), "root": range(6), "n_shingles": [len(x) for x in sets], "signature": signatures})
    assert ngram_join.possible_rows(table, ngram_join.Bands(85, 100)).to_pylist() == [{"class": 10 + k, "root": k, "rep": 0, "n_shingles": len(sets[k])} for k in range(5)]


def test_ngram_meetings_over_batches(spark):
    """A key's classes may lie in several batches; keys of one class meet nothing."""
    rng = random.Random(3)
    rows = [(c, sorted(rng.sample(range(30), 4)) + [1000 + c]) for c in range(-40, 40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = sorted(map(tuple, ngram_join.meetings(spark.createDataFrame(rows, "class long, keys array<long>")).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = collections.defaultdict(list)
    for c, keys in rows:
        for k in keys:
            by[k].append(c)
    assert got == sorted((k, c, min(own)) for k, own in by.items() if len(own) > 1 for c in own)


def test_ngram_join_unsettled_meetings(spark, monkeypatch):
    """Near copies that link neither the first nor the sampled ones of their meetings, over several tiles."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 6)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(25):
        own = list(base)
        for i in rng.sample(range(60), 9):
            own[i] = f"g{g}x{i}"
        rows.append((2 * g, " ".join(own)))
        own[rng.randrange(60)] = f"near{g}"
        rows.append((2 * g + 1, " ".join(own)))
    rows += [(None, rows[7][1] + " more"), (77, "")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, 4, 5).collect()))
    assert got == brute_components(rows, 1, 4, 5) and len({r[3] for r in got}) > 10


@pytest.mark.parametrize("tile", [8, 8192])
def test_line_dedup_near_lines(spark, monkeypatch, tile):
    """Many variants of few lines, most of them near the threshold, against brute force; long lists in tiles."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(tile)
    bases = [[f"b{k}w{i}" for i in range(20)] for k in range(3)] + [["a", "b", "c", "d", "e"]]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(4):
            own = list(rng.choice(bases))
            for i in rng.sample(range(len(own)), rng.randrange(len(own) // 4 + 1)):
                own[i] = f"x{rng.randrange(60)}"
            lines.append(" ".join(own))
        rows.append((d, "\n".join(lines)))
    seen, want = [], {}
    for i, t in rows:
        sets = [set(line.split()) for line in t.split("\n")]
        want[i] = [k for k, s in enumerate(sets) if any(5 * len(s & o) >= 4 * len(s | o) for o in seen + sets[:k])]
        seen += sets
    got = {r.doc_id: r.removed for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_line_dedup(spark, docs, rows, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.removed) for r in line_dedup.decisions(docs).collect())
    seen, want = [], {}
    for i, t in sorted({(i, t) for i, t in rows if t}, key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = []
        for k, line in enumerate(t.split("\n")):
            s = set(split(line))
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.append(k)
            if s:
                seen.append(s)
        want[i, t] = gone
    assert got == sorted((i is None, i or 0, 0 if t is None else len(t.split("\n")), want.get((i, t), [])) for i, t in rows)
    assert line_dedup.decisions(empty).count() == 0 and line_dedup.deduplicated(empty).count() == 0
    assert line_dedup.deduplicated(docs).columns == docs.columns


def test_classifiers(spark, docs, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("aeiounrst", k=6))
    texts = [(i, " ".join([word() for _ in range(30)] + (["nastyword"] if i % 3 == 0 else []))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(df, spark.range(0, 200).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label")))
    right = [(r.predicted == 1) == (r.doc_id % 3 == 0) for r in toxicity.predict(df, model).collect() if r.doc_id >= 200]
    assert sum(right) >= 0.95 * len(right)
    shout = spark.createDataFrame([(i, t.upper() + "!!" if i % 3 == 0 else t) for i, t in texts], "doc_id long, text string")
    m = quality_classifier.train(shout, spark.range(0, 200).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("label")))
    right = [(r.predicted == 1) == (r.doc_id % 3 != 0) for r in quality_classifier.predict(shout, m).collect() if r.doc_id >= 200]
    assert sum(right) >= 0.95 * len(right)
    none = spark.createDataFrame([], "doc_id long, label int")
    for own in (toxicity, quality_classifier):
        assert own.predict(empty, own.train(empty, none)).count() == 0
        assert all(0 <= r.score <= 1 for r in own.predict(docs, own.train(docs, none)).collect())


def test_decontamination_index_of_all_words(docs, rows):
    """One stored index serves any benchmark; it holds every word of every text."""
    segments = decontamination.index(docs)
    own = [split(t, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for _, t in rows]
    assert sum(sum(r.counts) for r in segments.collect()) == sum(map(len, own))
    for k in (10, 20):
        phrase = rows[k][1].split()[:10]
        found = {r.doc_id for r in decontamination.search(segments, decontamination.phrases([(1, " ".join(phrase).encode())])).where("n_hit > 0").collect()}
        want = [w.encode() for w in phrase]
        assert found == {i for (i, _), w in zip(rows, own, strict=True) if any(w[j : j + len(want)] == want for j in range(len(w)))} and k in found


def test_packing_bounded():
    """The fullest bin closes when none fits and all are open; a piece goes to the tightest."""
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 7, 5, 3, 5)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]
    assert bins.closed() == [1, 2] and bins.rest() == [0]


def test_packing_rest_keeps_the_rule(spark):
    """The bins left open are packed by the same rule, not longest first."""
    import public_tokenizers

    df = spark.createDataFrame([(k, " ".join("a" * (n - 1))) for k, n in enumerate((5, 2, 4, 3))], "doc_id long, text string").coalesce(1)
    by = collections.defaultdict(list)
    for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=8).collect():
        by[r.sequence_id].append(r.length)
    assert sorted(sorted(x) for x in by.values()) == [[2, 5], [3, 4]]


def test_ngram_join_near_null_ids(spark):
    """Classes of null ids only link, and link those of others."""
    w, x = [f"w{i}" for i in range(100)], [f"x{i}" for i in range(8)]
    v = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(w)), (None, " ".join(w[:92] + x)), (2, " ".join(w[16:92] + x)), (None, " ".join(v)), (None, " ".join(v[:92] + x)), (3, " ".join(v[::-1]))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 4, 5).collect()]
    assert sorted(got, key=repr) == sorted([(1, 98, 1), (None, 98, 1), (2, 82, 1), (None, 98, None), (None, 98, None), (3, 98, 3)], key=repr)


def test_ngram_tiles_of_a_task_are_looked_at_together():
    """Tiles of a table link inside themselves alone, blocks only with the other, and chains of links are one group."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    rows = [(1, False, 0, 10, 5, base[:100]), (1, False, 0, 11, 4, base[:110]), (1, False, 0, 12, 9, base[:121]), (1, False, 0, 13, 2, rng.integers(0, 1 << 63, 100, dtype=np.uint64))]
    rows += [(2, True, 0, 10, 5, base[:100]), (2, True, 0, 11, 4, base[:110]), (3, True, 0, 10, 5, base[:100]), (3, True, 1, 11, 4, base[:110]), (4, False, 0, 12, 9, base[:121])]
    key, two, block, cls, root, sets = zip(*rows, strict=True)
    signatures = pa.array([ngram_join.signature(np.sort(x), ngram_join.narrow_width(len(x))) for x in sets], pa.list_(pa.int64()))
    table = pa.table({"key": key, "two": two, "block": block, "class": cls, "root": root, "n_shingles": [len(x) for x in sets], "signature": signatures})
    found = ngram_join.possible_rows(table, ngram_join.Bands(9, 10)).to_pylist()
    assert [(x["class"], x["root"], x["rep"]) for x in found] == [(10, 5, 4), (11, 4, 4), (12, 9, 4), (10, 5, 4), (11, 4, 4)]
