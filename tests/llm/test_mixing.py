import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftline.llm import mixing, queries
from tests.oracle import connection, differences


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > most * sizes[s]}
        if not over:
            return fixed | t
        fixed |= {s: most * sizes[s] for s in over}
        open_ -= over
    return fixed


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    largest = max((r["size"] for r in rows), default=0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest
    return taken


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = mixing.mixed(docs, carry=["doc_id", "source"])
    rows = first.collect()
    assert len(rows) == docs.count() and {r.doc_id: r.size for r in rows} == {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    check(rows)
    again = {r.doc_id: r.taken for r in mixing.mixed(docs.repartition(5), carry=["doc_id", "source"]).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_cases(spark):
    rows = [(i, "a b c" * (i % 4), s, 0) for i, s in enumerate(["x"] * 30 + ["y"] * 9 + [None] * 5 + ["z"])] + [(None, None, "x", 0), (3, "a b", "x", 0), (3, "a b", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    check(mixing.mixed(docs).collect())
    assert mixing.mixed(docs.where("false")).count() == 0
    assert {r.taken for r in mixing.mixed(docs.where("text IS NULL")).collect()} == {0}


def test_prior_favours(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b", 5.0 if i % 3 else 0.2) for i in range(3000)], "doc_id long, text string, source string, prior double")
    got = mixing.mixed(docs, prior="prior", share=1.2, weights=(1.0,)).where("source = 'b'").groupBy("prior").avg("copies").collect()
    by = {r.prior: r["avg(copies)"] for r in got}
    assert by[5.0] > by[0.2]


def test_hash(spark):
    u = spark.createDataFrame([(5,)], "doc_id long").select(mixing.unit("doc_id", 7).alias("u")).first().u
    assert u == int(hashlib.md5(b"5:7").hexdigest()[:10], 16) >> 1


def brute_copies(rows, share=1.5, power=0.5, seed=7):
    """Copies of every document: whole ones, and one more in the order of Pareto's numbers while that brings the words nearer to the target."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, out = brute_targets(sizes, share), {}
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        whole = math.floor(rate)
        need, p = want[s] - whole * sizes[s], rate - whole
        laid = []
        for r in own:
            out[r["doc_id"]] = whole
            if r["size"] and need > 0 and p > 0:
                u = ((int(hashlib.md5(f"{r['doc_id']}:{seed}".encode()).hexdigest()[:10], 16) >> 1) + 0.5) / 2**39
                laid.append((u / (1 - u) / (p / (1 - p) * r["size"] ** power), r))
        done = 0
        for _, r in sorted(laid, key=lambda x: x[0]):
            if abs(done + r["size"] - need) > abs(done - need):
                break
            done += r["size"]
            out[r["doc_id"]] += 1
    return out


def test_selection_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in mixing.mixed(docs, carry=["doc_id", "source"], size_power=0.5).collect()]
    check(rows)
    assert {r["doc_id"]: r["copies"] for r in rows} == brute_copies(rows)
    more = [r["size"] for r in rows if r["copies"] > min(x["copies"] for x in rows if x["source"] == r["source"])]
    assert sum(more) / len(more) > sum(r["size"] for r in rows) / len(rows)


def test_against_sql(spark, sf):
    assert not differences(queries.op7_mixing(spark, sf), connection(sf), queries.OP7_SQL)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a b", "x", 1, 2, 3) for i in range(8)], "doc_id long, text string, source string, last int, odds int, `a.b` int")
    got = mixing.mixed(docs)
    assert got.columns[:6] == docs.columns and {tuple(r)[3:6] for r in got.collect()} == {(1, 2, 3)}
    assert mixing.mixed(docs.limit(1).withColumn("text", F.repeat(F.lit("w "), 300_000))).first().size == 300_000
