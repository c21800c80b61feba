import math
import mmap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import ngram_lm
from driftline.llm.trie import NAME, VALUES, EliasFano, Trie, pack, quantise, unpack

def TRAIN():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2


def tokens(t):
    return [*(t or "").encode().lower().split(), "END"]


def brute(rows, order=3, discount=0.75):
    """doc_id -> (held_out, n_tokens, n_known, N, base, score), from plain dictionaries."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    grams = [Counter() for _ in range(order)]
    for i, t in rows:
        if not held[i]:
            w = ["START"] * (order - 1) + tokens(t)
            for j in range(order - 1, len(w)):
                for k in range(order):
                    grams[k][tuple(w[j - k : j + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    after = [defaultdict(list) for _ in range(order)]
    for k in range(1, order):
        for g, c in grams[k].items():
            after[k][g[:-1]].append(c)
    q = lambda p: VALUES[quantise(np.array([p]))[0]]
    out = {}
    for i, t in rows:
        w = ["START"] * (order - 1) + tokens(t)
        base = score = known = 0
        for j in range(order - 1, len(w)):
            c = grams[0][(w[j],)]
            known += c > 0
            p = (c + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, order):
                ctx = tuple(w[j - k : j])
                cs = after[k].get(ctx)
                if cs:
                    c = grams[k][(*ctx, w[j])]
                    p = (q((c - discount) / sum(cs)) if c else 0) + q(discount * len(cs) / sum(cs)) * p
            score += math.log10(min(p, 1))
        out[i] = (held[i], len(tokens(t)), known, n, base, score)
    return out


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = ngram_lm.scored(docs, TRAIN(), carry=["doc_id"], stable=True, batch_bytes=1 << 16).collect()
    compare(got, want)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)  # held-out texts are better known by their contexts


def test_cases(spark):
    rows = [(1, "a b a b c"), (2, None), (3, ""), (None, "A B\ta é"), (15, "b a b"), (4, "new words only \x1f"), (7, "a " * 300), (8, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    want = brute(rows)
    assert any(x[0] for x in want.values()) or True
    for order in (1, 2, 3, 4):
        compare(ngram_lm.scored(docs, TRAIN(), carry=["doc_id"], order=order, shards=3).collect(), brute(rows, order))
    assert ngram_lm.scored(docs.where("false"), TRAIN()).count() == 0
    none = ngram_lm.scored(docs, F.lit(False), carry=["doc_id"]).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, most in ((0, 0), (1, 5), (1000, 1 << 63), (5000, 6000), (300, 40)):
        x = np.sort(rng.integers(0, most + 1, n, dtype=np.uint64))
        e = EliasFano.of(x, most)
        assert (e.values() == x).all()
        asks = np.concatenate([x, rng.integers(0, most + 1, 500, dtype=np.uint64)])
        if n:
            at, ok = e.successor(asks)
            assert (ok == np.isin(asks, x)).all() and (x[at[ok]] == asks[ok]).all()
    for width in (0, 1, 7, 40, 63):
        v = rng.integers(0, 1 << width, 100, dtype=np.uint64)
        assert (unpack(pack(v, width), width, np.arange(100)) == v).all()


def test_trie_in_a_mapped_file(tmp_path):
    words = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64))
    keys = np.unique((np.random.default_rng(1).integers(0, 50, 400, dtype=np.uint64) << np.uint64(NAME)) | np.random.default_rng(2).integers(0, 1 << NAME, 400, dtype=np.uint64))
    t = Trie.build(words, np.arange(50), [(keys, np.ones(len(keys)))])
    (tmp_path / "trie").write_bytes(t.to_bytes())
    with (tmp_path / "trie").open("rb") as f:
        m = Trie.read(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    assert (m.find_words(words) == np.arange(50)).all() and (m.find_words(words + np.uint64(1)) == -1).all()
    got = m.find_after(1, (keys >> np.uint64(NAME)).astype(np.int64), keys & np.uint64((1 << NAME) - 1))
    assert (got == np.arange(len(keys))).all()
    assert len(t.to_bytes()) < 8 * (len(words) + len(keys))


def test_widths():
    big = np.array([5_000_000_000], np.float64)
    t = Trie.build(np.array([7], np.uint64), big, [(np.array([7], np.uint64), big)])
    assert int(Trie.read(t.to_bytes()).counts[0]) == 5_000_000_000
    with pytest.raises(OverflowError):
        ngram_lm.check_width(1 << 24)
    ngram_lm.check_width((1 << 24) - 1)
