import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[x]
        ids = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def held(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_against_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(x[4] for x in want.values())
    assert held(decontam.contamination(docs, bench)) == want
    assert held(decontam.contamination(docs, bench, block_words=5000)) == want


def test_small_cases(spark):
    docs = [(1, "one two three"), (2, None), (3, ""), (4, "Alpha, BETA gamma-delta é ß"), (5, "x y x y x y"), (6, "x y x y x y"), (7, "beta gamma")]
    items = [(1, "two"), (2, None), (3, "---"), (4, "beta gamma delta"), (5, "x y x"), (5, "y x y"), (None, "three"), (11, "TWO")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert held(decontam.contamination(d, b)) == want
    assert held(decontam.contamination(d, b, block_words=12)) == want
    assert want[1][1:3] == (2, 2)
    assert sorted(r.doc_id for r in decontam.clean_documents(d, b).collect()) == [2, 3, 7]
    assert decontam.clean_documents(d, b).columns == d.columns
    assert held(decontam.contamination(d.where("false"), b)) == {}
    assert not any(x[4] for x in held(decontam.contamination(d, b.where("false"))).values())


def test_proximity_of_whole_texts(spark):
    rnd = random.Random(6)
    words_ = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choice(words_) for _ in range(rnd.randrange(0, 60)))) for i in range(80)]
    items = [(i, " ".join(rnd.choice(words_) for _ in range(rnd.randrange(2, 6)))) for i in range(25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (10_000, 30):
        got = {r.doc_id: r.n_near for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(1), bench, window=3, block_words=block_words, near=4).collect()}
        freq = Counter(w for _, t in docs for w in t.split())
        for d, t in docs:
            w, found = t.split(), set()
            for i, q in items:
                q = q.split()
                for k in range(max(1, len(q) - 2)):
                    own = q[k : k + 3]
                    rare = min(own, key=lambda x: (freq[x], own.index(x)))
                    if any(x == rare and all(any(y == z for z in w[max(0, at - 4) : at + 5]) for y in own) for at, x in enumerate(w)):
                        found.add(i)
            assert got[d] == len(found)


def test_proximity_does_not_depend_on_partitions(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = [sorted((r.doc_id, r.n_near, r.n_hit) for r in decontam.contamination(docs.repartition(n), bench, carry=["doc_id"], near=20, block_words=b).collect()) for n, b in ((1, decontam.BLOCK_WORDS), (7, decontam.BLOCK_WORDS), (3, 2000))]
    assert got[0] == got[1] == got[2] and any(n for _, n, _ in got[0])


def test_clashing_names(spark):
    """Names inside the operator and names with a dot keep their values, with one block of items and with many."""
    docs = spark.createDataFrame([(1, "one two three", 5, 6, 7, 8), (1, "one two three", 5, 6, 7, 8), (None, None, None, None, None, None)], "doc_id long, text string, k1 long, hits long, `a.b` long, c0 long")
    bench = spark.createDataFrame([(i, f"two w{i}") for i in range(20)], "item_id long, text string")
    for block_words in (10_000, 10):
        got = decontam.contamination(docs, bench, window=1, block_words=block_words)
        assert got.columns[:6] == docs.columns and sorted(tuple(r)[:6] for r in got.collect() if r.doc_id) == [(1, "one two three", 5, 6, 7, 8)] * 2
        assert {r.n_items for r in got.collect() if r.doc_id} == {20}


def test_proximity():
    q = {w: i for i, w in enumerate([b"a", b"b", b"c"])}
    seg = decontam.Segment([b"a x x b", b"b x a c", b"c"], q)
    places = lambda terms, k: [p for _, x in seg.near(np.array([terms]), k) for p in x.tolist()]
    assert places([0, 1], 3) == seg.postings(0).tolist()
    assert len(places([0, 1], 2)) == 1
    assert len(places([0, 1, 2], 2)) == 1
