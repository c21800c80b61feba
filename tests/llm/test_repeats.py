import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftline.llm import repeats, runindex


def covered(raw, length):
    """Marks of the bytes of every text that a string which starts twice or more covers."""
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        hit = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i + 1 : i + length + 1] = 1
        out.append(hit)
    return out


def brute(texts, length, short=240, over=50):
    raw = [(t or "").encode() for t in texts]
    out = []
    for t, hit, some in zip(raw, covered(raw, length), covered(raw, short)):
        kept = bytes(b for b, h in zip(t, hit[1:]) if not h)
        step, words = np.diff(some), []
        for a, z in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            words.append(sum(a <= m.start() and m.end() <= z for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)))
        words = [w for w in words if w > over]
        out.append((len(t), int(hit.sum()), int((np.diff(hit) == 1).sum()), hashlib.sha256(kept).hexdigest(), len(words), sum(words)))
    return out


def held(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.passage_words) for r in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("ab") for _ in range(60))
    strings = [bytes("".join(rnd.choice([base[i : i + 9], "a", "b", "ab"]) for i in range(rnd.randrange(1, 50))), "ascii") for _ in range(7)]
    index, starts = runindex.build(strings)
    got = index.matching_statistics()
    assert index.n_runs <= index.n
    for i, s in enumerate(strings):
        for p in range(len(s)):
            best = 0
            for j, t in enumerate(strings):
                for q in range(len(t)):
                    if (i, p) != (j, q):
                        m = 0
                        while p + m < len(s) and q + m < len(t) and s[p + m] == t[q + m]:
                            m += 1
                        best = max(best, m)
            assert got[starts[i] + p] == best


def made(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passages = [say(60), say(90), say(200)]
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, "x" * 3000, "ab" * 700, "ab" * 700, "abc" * 5000]
    for i in range(n):
        t = say(rnd.randrange(5, 250))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 3)
            t += p[a : len(p) - rnd.randrange(len(p) // 3)] + say(rnd.randrange(1, 60))
        texts.append(t)
        if i % 5 == 0:
            w = t.split()
            w[rnd.randrange(len(w))] = "changed"
            texts += [t, " ".join(w)]
    return texts


@pytest.mark.parametrize("hot, crowd", [(256, 64), (2, 64), (256, 1), (3, 2)])
def test_against_brute_force(spark, hot, crowd):
    texts = made(hot + crowd)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = dict(enumerate(brute(texts, 400)))
    assert sum(x[1] > 0 for x in want.values()) > 20
    assert held(repeats.removed(docs, carry=["doc_id"], hot=hot, crowd=crowd, parcel_bytes=20_000)) == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 400)))
    assert held(repeats.removed(docs, carry=["doc_id"], with_text=False)) == want


def test_other_lengths(spark):
    texts = made(9, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = dict(enumerate(brute(texts, 100, 64, 12)))
    assert held(repeats.removed(docs, length=100, deal=64, over=12, carry=["doc_id"], index_bytes=2000)) == want
    with pytest.raises(ValueError):
        repeats.removed(docs, length=20)


def test_clashing_names(spark):
    """Names of the tables inside, names with a dot and names of results."""
    t = "word " * 100
    names = ["c1", "parcel", "shard", "texts", "k1", "a.b", "n_bytes"]
    docs = spark.createDataFrame([(t, *range(7)), (t, *range(7)), (None, *[None] * 7)], "text string, " + ", ".join(f"`{n}` long" for n in names))
    got = repeats.removed(docs, with_text=False)
    assert got.columns == ["text", *names[:-1], "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"]
    assert sorted(tuple(r)[1:9] for r in got.collect() if r.text) == [(0, 1, 2, 3, 4, 5, 500, 500)] * 2


def test_equal_rows_and_clashing_columns(spark):
    rnd = random.Random(5)
    t = " ".join(str(rnd.random()) for _ in range(40))
    docs = spark.createDataFrame([(1, t, "c"), (1, t, "c"), (None, "short", "c"), (2, t[:450] + "!", "c")], "doc_id long, text string, kept string")
    got = repeats.removed(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in got) == [(0, 0, b"short"), (1, len(t), b""), (1, len(t), b""), (2, 450, b"!")]
    assert repeats.removed(docs.where("false")).count() == 0
