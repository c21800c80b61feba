import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import simhash
from driftline.llm.components import components


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    """ids and fingerprints -> least id reachable."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def joined(ids, linked):
    """Least id reachable over the pairs of ids that linked says are near."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(ids)
    for a in range(len(ids)):
        for b in range(a):
            if linked(ids[a], ids[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def brute_wide(text, k):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64(b" ".join(w[i : i + k]), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))] if w else []
    out = 0
    for n, m in enumerate(simhash.MIXERS.tolist()):
        own = []
        for h in hs:
            x = h * m % (1 << 64)
            x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            own.append(x ^ (x >> 32))
        out |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own)) << (64 * n)
    return out, set(sorted(set(hs))[:8])


def brute_near(texts, k, radius, wide):
    """ids and texts -> least id reachable by either fingerprint."""
    fps, wides = {i: brute_fp(t, k) for i, t in texts.items()}, {i: brute_wide(t, k) for i, t in texts.items()}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= radius or ((wides[a][0] ^ wides[b][0]).bit_count() <= wide and wides[a][1] & wides[b][1])
    return joined(texts, near)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("dealt", [2048, 8])
def test_similar_texts_meet(spark, monkeypatch, dealt):
    """Pairs of similarity 0.8 or more end in one component, texts that share a passage do not; dealt 8: by way of large buckets."""
    monkeypatch.setattr(simhash, "DEALT", dealt)
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = " ".join(word() for _ in range(40))
    texts = {}
    for g in range(12):
        base = [word() for _ in range(rnd.randrange(100, 300))]
        for i in range(rnd.randrange(1, 30)):
            texts[100 * g + i] = edited(rnd, base, len(base) * rnd.randrange(3) // 200)
    for i in range(60):
        texts[5000 + i] = " ".join([word() for _ in range(60)] + [passage] + [word() for _ in range(60)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, shingle=5, radius=3, wide=46).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in texts for b in texts if a < b and alike(a, b) >= 0.8]
    assert len(pairs) > 300 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(got[i] == i for i in texts if i >= 5000)
    assert all(got[i] // 100 == i // 100 for i in texts if i < 5000)


def test_texts_stay_in_large_buckets(spark, monkeypatch):
    """Versions that differ from each other share large buckets only; hashes that no other text has take none of them out."""
    monkeypatch.setattr(simhash, "DEALT", 8)
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts = {i: edited(rnd, base, 6) for i in range(400)}
    wides = {i: brute_wide(t, 5) for i, t in texts.items()}
    shared = {}
    for i in texts:
        for h in wides[i][1]:
            shared[h] = shared.get(h, 0) + 1
    outside = [i for i in texts if sum(shared[h] <= 8 for h in wides[i][1]) >= 3]
    assert outside
    want = joined(texts, lambda a, b: (wides[a][0] ^ wides[b][0]).bit_count() <= 46 and wides[a][1] & wides[b][1])
    df = spark.createDataFrame([(int(i), np.array([wides[i][0] >> 64 * n & (1 << 64) - 1 for n in range(4)], np.uint64).tobytes(), [int(np.uint64(h).view(np.int64)) for h in wides[i][1]]) for i in texts], "fp long, wide binary, sketch array<long>")
    got = {r.node: r.root for r in components(simhash.wide_links(df, 46)).collect()}
    assert {i: got.get(i, i) for i in texts} == want


@pytest.mark.parametrize("dealt", [2048, 8])
def test_exact_similarity(spark, sf, monkeypatch, dealt):
    """Components are those of exact sets of shingles of similarity 0.8; dealt 8: by way of large buckets and groups."""
    monkeypatch.setattr(simhash, "DEALT", dealt)
    rnd = random.Random(8)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for g in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(40, 300))]
        for i in range(12):
            texts[10**6 + 100 * g + i] = edited(rnd, base, len(base) * rnd.randrange(6) // 100)
    texts[10**7], texts[10**7 + 1] = "a b c d e f " * 2, "a b c d e f " * 50  # the same set
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    want = joined(texts, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, shingle=5, wide=46, similar=0.8).collect()}
    assert got == want


def test_spark_hash_is_xxh64(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b ü")).alias("h")).first().h
    assert got % (1 << 64) == xxhash.xxh64("a b ü".encode(), seed=42).intdigest()


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fp(t) for i, t in rows.items()}
    want = brute_components(fps, 2)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_links_reach_what_brute_force_reaches(spark, monkeypatch, radius):
    rnd = random.Random(radius)
    fps, centre = [], [rnd.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    for c in centre:
        x = c
        for _ in range(rnd.randrange(12)):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(radius + 3)))
            fps.append(x)
    fps = sorted(set(fps + centre))
    want = brute_components(dict(enumerate(fps)), radius)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    number = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fps)}
    for dealt in (2048, 4):  # the second: large buckets are dealt out
        monkeypatch.setattr(simhash, "DEALT", dealt)
        edges = [(number[r.u], number[r.v]) for r in simhash.links(df, radius).collect()]
        got = {i: i for i in range(len(fps))}
        for _ in range(len(fps)):
            new = dict(got)
            for a, b in edges:
                new[a] = new[b] = min(new[a], new[b])
            if new == got:
                break
            got = new
        assert got == want


def test_tiles_of_a_large_group():
    rng = np.random.default_rng(1)
    a = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)))
    found = simhash.forest(a[:, None], None, 2)
    n = sum(len(x) for x, _ in found)
    assert n < 40 * len(a)
    assert all((np.bitwise_count(a[x] ^ a[y]) <= 2).all() for x, y in found)


def test_cases(spark):
    t = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(3, t, 1), (1, t.upper(), 2), (1, t.upper(), 2), (7, None, 3), (8, " \n", 4), (9, "solo", 5), (None, "nobody here", 6)], "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id, r.copies) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(3, 1, 3), (1, 1, 3), (7, 7, 2), (8, 7, 2), (9, 9, 1), (None, None, 1)}
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 7, 9]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    far = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long"), few=0).collect()}
    assert far == got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_only_duplicates_go(spark):
    """Rows without a key, or with one that others have too, stay unless their text has a near copy."""
    say = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(None, say("a"), 1), (None, say("b"), 1), (None, say("c"), 1), (5, say("d"), 1), (5, say("e"), 1), (6, say("e"), 1), (7, say("f"), 1), (7, say("f"), 1), (None, say("f"), 1), (8, say("g") + " x", 1), (9, say("g"), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").repartition(3)
    left = simhash.one_of_each(docs, similar=0.8)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text[0]) for r in left.collect()) == [(0, "a"), (0, "b"), (0, "c"), (5, "d"), (5, "e"), (7, "f"), (8, "g")]
