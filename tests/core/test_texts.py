import json
import random
import re

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import contexts as cx
from driftline.operators import checks, frequency, scoring, vectors
from driftline.operators.order import placed
from driftline.sources import corpus as cp
from driftline.sources import fixtures as fx
from driftline.sources import sinks


def test_spans_are_the_tokens(spark, sf):
    t = fx.texts(spark, sf)
    rows = t.collect()
    spans = cx.token_spans(t).select("record_id", "token", "begin", "end", "text").collect()
    assert all(r.text[r.begin : r.end].lower() == r.token for r in spans)
    listed = {r.record_id: r.w for r in t.select("record_id", tx.words(F.col("text")).alias("w")).collect()}
    assert len(spans) == sum(map(len, listed.values())) and len(rows) == len(listed)


def test_dictionary(spark):
    terms = ["meth", "meth lab", "coke", "lab"]
    texts = ["Meth lab, coke-like METH.", "methlab cokes", None, "a meth  lab"]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string")
    want = {(i, t, m.start(), m.end()) for i, x in enumerate(texts) if x for t in terms for m in re.finditer(rf"(?<![^\W_]){t}(?![^\W_])", x.lower())}
    assert {(r.record_id, r.token, r.begin, r.end) for r in cx.dict_matches(df, terms).collect()} == want
    assert cx.dict_matches(df, []).count() == 0


def context_by_hand(t, a, b):
    ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s|$)", t)]
    begin = max((e for e in ends if e <= a), default=0)
    end = min((e for e in ends if e > a), default=len(t))
    if len(t[begin:end].split()) < 7:
        begin, end = 0, len(t)
    return " ".join([*t[begin:a].split()[-32:], "[MASK]", *t[b:end].split()[:32]])


def test_contexts(spark):
    long = "Short one. " + " ".join(f"w{i}" for i in range(100)) + " target, tail."
    cases = [(long, long.index("target"), long.index("target") + 6), ("Go on. It is so. Now.", 7, 9), ("abc", 2, 9), (None, 0, 1), ("one", 0, 3), ("a " * 2000 + "x. y", 4000, 4001), ("v" * 3000 + " x yy", 3001, 3002)]
    rnd = random.Random(8)
    for _ in range(120):
        t = "".join(rnd.choice(["a", "bb", "target", " ", " ", " ", ".", "!?", ","]) for _ in range(rnd.randrange(1, 400))).strip()
        cases += [(t, m.start(), m.end()) for m in re.finditer("target", t)][:3]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], 'i long, text string, begin int, end int')
    got = {r.i: (r.context, r.drop_reason) for r in cx.contexts(df).collect()}
    for i, (t, a, b) in enumerate(cases):
        assert got[i] == ((context_by_hand(t, a, b), None) if t and b <= len(t) else (None, "mask_lost")), cases[i]
    assert got[0][0].split()[-3:] == ["[MASK]", ",", "tail."] and len(got[0][0].split()) == 35


def test_whole_table_of_contexts(spark, sf):
    t = fx.texts(spark, sf)
    rows = cx.contexts(cx.token_spans(t, ["ononst", "inoran", "hehely"])).collect()
    assert rows and all(r.context == context_by_hand(r.text, r.begin, r.end) for r in rows)


def test_span_embeddings(spark):
    df = spark.createDataFrame([(1, "one two three four", 4, 13), (2, "one two", 50, 60), (3, None, 0, 1)], "i long, text string, begin int, end int")
    own = cx.SpanEmbedder(lambda: 10.0, lambda m, ws: [[[m, float(len(p)), float(len(w))] for p in w] for w in ws])
    out = cx.span_embeddings(df, own, side=1, batch=1)
    assert {r.i: r.embedding for r in out.collect()} == {1: [10.0, 4.0, 4.0], 2: None, 3: None}
    assert tuple(cx.embedding_stats(out).first()) == (3, 1, 2, True)


def test_checks():
    checks.vocabulary_fits(5, 5)
    checks.same_scope({"scope": {"mode": "all", "hash": None}}, "all", None)
    for call in (lambda: checks.vocabulary_fits(6, 5), lambda: checks.same_scope({"scope": {"mode": "all"}}, "subreddits", "x")):
        with pytest.raises(ValueError):
            call()


def test_checks_of_tables(spark):
    s = spark.createDataFrame([("a", 1, "2001-02", "2001H1"), ("a", 2, "2001-08", "2001H2")], "scope string, floor int, month string, half_year string")
    assert checks.agreed(s, scope="scope").count() == 2 and checks.in_place(s).count() == 2
    with pytest.raises(ValueError, match="floor"):
        checks.agreed(s, scope="scope", floor="floor")
    with pytest.raises(ValueError, match="2001-08"):
        checks.in_place(s.withColumn("half_year", F.lit("2001H1")))
    assert checks.label_order(s.withColumn("half_year", F.lit("2001-H1"))).count() == 2
    terms = spark.createDataFrame([("x",), ("a b",)], "term string")
    vocabulary = spark.createDataFrame([("x", 7), ("y", 8)], "token string, id long")
    assert [tuple(r) for r in scoring.term_ids(terms, vocabulary).collect()] == [(7, "x")]
    with pytest.raises(ValueError):
        scoring.term_ids(terms.where("term = 'a b'"), vocabulary)


def test_vectors_of_any_length(spark):
    df = spark.createDataFrame([("a", [float(i)] * 70) for i in range(3)], "word string, embedding array<double>")
    assert len(vectors.centroids(df, ["word"]).first().centroid) == 70
    assert vectors.centroids(df.where("false"), ["word"]).count() == 0
    with pytest.raises(ValueError):
        vectors.centroids(df.union(spark.createDataFrame([("a", [1.0])], df.schema)), ["word"])


def test_places_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert {r.place - r.x for r in placed(df, "place", "x").collect()} == {1}


def test_readers_and_writers(spark, tmp_path):
    raw = "\n".join(f'{{"subreddit": "r/A", "body": "line {i}", "created_utc": "{1262304000 + i}"}}' for i in range(50)) + "\n"
    (tmp_path / "RC_2010-01.zst").write_bytes(zstandard.compress(raw.encode()))
    (tmp_path / "RC_2010-02.zst").write_bytes(zstandard.compress(raw.encode())[:60])
    (tmp_path / "RS_2010-03.jsonl").write_text(raw)
    found = cp.lines(spark, str(tmp_path / "RC_2010-01.zst"), str(tmp_path / "RS_2010-03.jsonl"), str(tmp_path / "RS_2010-03.jsonl"))
    kept = cp.records(found, spark.createDataFrame([("a",)], "channel string"), (2009, 2011))
    assert kept.count() == 100 and {r.half_year for r in kept.collect()} == {"2010H1"}
    status = cp.file_status(spark, str(tmp_path))
    assert {r.file.rsplit("/", 1)[1]: (r.ok, r.n_lines) for r in status.collect() if r.ok} == {"RC_2010-01.zst": (True, 50), "RS_2010-03.jsonl": (True, 50)}
    months = cp.months_of(status).join(status, "file")
    assert {r.month: r.month_ok for r in cp.month_status(months).collect()} == {"2010-01": True, "2010-02": False, "2010-03": True}
    (tmp_path / "with.dot").mkdir()
    (tmp_path / "with.dot" / "RS_2011-01.jsonl").write_text(raw)
    assert cp.lines(spark, str(tmp_path / "with.dot")).count() == 50
    assert {r.file.rsplit("/", 1)[1] for r in cp.monthly_lines(spark, str(tmp_path), tolerant=True).select("file").distinct().collect()} >= {"RC_2010-01.zst"}
    with pytest.warns(UserWarning):
        assert [r.month for r in cp.pick_months(months, months=["2010-02", "1999-01"]).select("month").distinct().collect()] == ["2010-02"]
    assert {r.month for r in cp.pick_months(months, first=2).collect()} == {"2010-01", "2010-02"} and cp.pick_months(months, first=2, at=5).count() == 0
    with pytest.raises(FileNotFoundError):
        cp.shards(spark, str(tmp_path))
    (tmp_path / "m01.part.json").write_text("{}")
    assert cp.shards(spark, str(tmp_path)).count() == 1
    (tmp_path / "rows").mkdir()
    for h in ("2010H1", "2010H2"):
        np.savez(tmp_path / "rows" / f"cosine_{h}.npz", half_year=np.array(h), scores=np.array([0.5, np.nan], np.float32), occurrence_counts=np.array([3, 0]))
    merged = cp.npz_rows(spark, str(tmp_path / "rows"), ["2010H1", "2010H2"], ["alpha", "beta"])
    assert sorted(tuple(r) for r in merged.where("cosine IS NOT NULL").collect()) == [("2010H1", "alpha", 0.5, 3), ("2010H2", "alpha", 0.5, 3)] and merged.count() == 4
    with pytest.raises(FileNotFoundError):
        cp.npz_rows(spark, str(tmp_path / "rows"), ["2010H1", "2010H2", "2011H1"], ["alpha", "beta"])
    with pytest.raises(ValueError):
        cp.npz_rows(spark, str(tmp_path / "rows"), ["2010H1"], ["alpha", "beta"])
    np.save(tmp_path / "m.npy", np.array([[1, 2]]))
    (tmp_path / "hy.csv").write_text("half_year\n2010H1\n")
    (tmp_path / "ws.csv").write_text("word\na\nb\n")
    assert sorted(tuple(r) for r in cp.npy_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "hy.csv"), str(tmp_path / "ws.csv")).collect()) == [("2010H1", "a", 1), ("2010H1", "b", 2)]
    (tmp_path / "i.jsonl").write_text('{"word": "a", "sentence": "s", "timestamp": "2020-01-01", "category": "c"}\n')
    assert cp.instances(spark, str(tmp_path / "i.jsonl")).first().sentence == "s"
    ranked = spark.createDataFrame([("2010H1", 2, "b"), ("2010H1", 1, "a")], "half_year string, rank int, word string")
    sinks.top_words(ranked, str(tmp_path / "top"))
    assert json.loads(spark.read.text(str(tmp_path / "top")).first().value) == {"2010H1": ["a", "b"]}
    sinks.csv(ranked.withColumn("many", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "csv"))
    assert {r.many for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {"x;y"}
    cent = spark.createDataFrame([("a", [1.0], 2)], "word string, centroid array<double>, n long")
    sinks.centroid(cent, cent.drop("word"), str(tmp_path / "cent"), spark.createDataFrame([("a", "2010-01", 2)], "word string, month string, n long"), spark.range(1))
    assert spark.read.json(str(tmp_path / "cent")).count() == 2 and spark.read.json(str(tmp_path / "cent_stats")).count() == 1
    (tmp_path / "w.csv").write_text("﻿word,n\nalpha,1\n")
    (tmp_path / "x.csv").write_text("alpha\nbeta\n")
    assert [r.word for r in cp.csv_column(spark, str(tmp_path / "w.csv"), "word").collect()] == ["alpha"]
    assert [r.word for r in cp.csv_column(spark, str(tmp_path / "x.csv"), "word").collect()] == ["alpha", "beta"]
    counts = spark.createDataFrame([("2010H1", "alpha", 3), ("2010H2", "beta", 4)], "half_year string, word string, c long")
    totals = counts.groupBy("half_year").agg(F.sum("c").alias("total_tokens"))
    sinks.frequency(counts, totals, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/freq")).count() == 2
    with pytest.raises(OverflowError):
        sinks.frequency(counts, totals, str(tmp_path / "out2"), widest=3)
    with pytest.raises(ValueError):
        cp.matrix(spark, [[1, 2]], ["a"], ["x"])
    assert cp.matrix(spark, [[1.0, float("nan")]], ["a"], ["x", "y"]).where("value IS NULL").count() == 1
    assert cp.pilot_words('{"groups": {"a": ["x"]}}') == [("a", "x")] and cp.pilot_words('{"pilot_words": [{"word": "y"}]}') == [("pilot_words", "y")]


def test_scorers(spark):
    contexts = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "ctx long, left string, right string")
    own = scoring.PandasScorer(lambda: 2.0, lambda m, f: pd.DataFrame({"ctx": f.ctx, "token": f.left, "logit": m})).logits(contexts)
    assert {tuple(r) for r in own.collect()} == {(1, "a", 2.0), (2, "c", 2.0)}
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate("a x b a x b a y b".split())], "record_id long, pos int, token string")
    got = {r.token: r.logit for r in scoring.CountScorer(tokens).logits(contexts).where("ctx = 1").collect()}
    assert max(got, key=got.get) == "x" and set(got) == {"x", "y"}
    near = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("u", "a", 1), ("u", "c", 2)], "target string, word string, place int")
    chosen = {r.target: r.word for r in vectors.greedy_negatives(near, 1, 1).collect()}
    assert chosen == {"t": "a", "u": "c"}


def test_count_scorer_by_surroundings(spark):
    """The likeliest words from packed neighbours, against a row for each context and token; ties, edges of texts, and no table of all tokens."""
    body = ["aa Ononst bb", "ononst bb aa", "aa inoran", "x aa ononst bb aa ononst cc", "zz bb aa bb cc", "aa aa bb bb ononst inoran ononst bb", "", None, "ononst", "aa zz bb, yy bb; aa yy. bb"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(body)], "record_id long, text string")
    tokens = frequency.tokens(texts)
    near = lambda k, name: tokens.select("record_id", (F.col("pos") - k).alias("pos"), F.col("token").alias(name))
    at = tokens.where(F.col("token").isin("ononst", "inoran")).join(near(-1, "left"), ["record_id", "pos"]).join(near(1, "right"), ["record_id", "pos"])
    rows = lambda df, *c: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    contexts = scoring.surroundings(texts, ["ononst", "inoran"])
    assert rows(contexts, "ctx", "left", "right") == rows(at.select(F.concat_ws(":", "record_id", "pos").alias("ctx"), "left", "right"), "ctx", "left", "right") != []
    scorer = scoring.CountScorer.of_texts(texts, contexts)
    for k in (1, 3, 50):
        found = scoring.top_k(scoring.CountScorer(tokens).logits(contexts), k)
        assert rows(scorer.top_k(contexts, k), "ctx", "rank", "token", "p") == rows(found, "ctx", "rank", "token", "p")
