import json

import pandas as pd
from pyspark.sql import functions as F

from driftline import flows
from driftline.operators import scoring
from driftline.sources import fixtures as fx


class Neighbours:
    """A scorer that deems the words of a context likely, the earlier the more."""

    def logits(self, contexts):
        def score(_, f):
            return pd.DataFrame([(c, w, -float(i)) for c, t in zip(f.ctx, f.context) for i, w in enumerate(dict.fromkeys(t.lower().split()))], columns=["ctx", "token", "logit"])

        return scoring.PandasScorer(lambda: None, score).logits(contexts)


def test_frequency(spark):
    rows = [("2015-03-01", "with word word cedar"), ("2015-09-01", "word word"), ("1999-01-01", "word")]
    lines = spark.createDataFrame([(json.dumps({"subreddit": "a", "body": b, "created_utc": pd.Timestamp(d).timestamp()}),) for d, b in rows], "value string")
    f = flows.build_frequency(lines, min_freq=2)
    assert sorted(tuple(r) for r in f.counts.collect()) == [("2015H1", "word", 2), ("2015H2", "word", 2)]
    assert {tuple(r) for r in f.totals.collect()} == {("2015H1", 4, 2), ("2015H2", 2, 2)}
    assert {tuple(r) for r in f.dropped.collect()} == {("kept", 2), ("year", 1)} and dict(f.removed.collect())["stop_words"] == 1


def test_hits_and_candidates(spark):
    texts = spark.createDataFrame([(1, "2015H1", "alpha beta gamma delta"), (2, "2015H2", "beta alpha. alpha gamma")], "record_id long, half_year string, text string")
    freq = spark.createDataFrame([("2015H1", "alpha", 1), ("2015H2", "alpha", 2)], "half_year string, word string, c long")
    hits = {r.half_year: r for r in flows.build_hits(texts, freq, spark.createDataFrame([("gamma",)], "token string"), Neighbours(), 2).collect()}
    assert set(hits) == {"2015H2"} and hits["2015H2"].n_scored == 2 and hits["2015H2"].frequency == 2 and hits["2015H2"].min_rank == 4
    found = flows.detect_candidates(texts, ["alpha", "beta", "gamma"], Neighbours(), threshold=50).collect()
    assert {(r.half_year, r.word) for r in found} >= {("2015H1", "delta"), ("2015H1", "[mask]")} and all(r.rank >= 1 for r in found)


def test_pilot_and_samples(spark, sf):
    freq = fx.dense(spark, sf)
    positives = spark.createDataFrame([(f"Brand#{i}",) for i in range(1, 9)], "word string")
    roles = {}
    for r in flows.pilot_selection(freq, positives, 3, 5, 4).collect():
        roles.setdefault(r.role, set()).add(r.word)
    assert len(roles["pilot_positives"]) == 3 and len(roles["pilot_negatives"]) == 3 and not roles["pilot_negatives"] & {r.word for r in positives.collect()}
    out = flows.sample_contexts(fx.texts(spark, sf), "ononst", 2).collect()
    assert out and all("[MASK]" in r.context and r.place <= 2 <= max(2, r.n_seen) for r in out)
    assert flows.change_points(freq.select("half_year", "word", F.col("c").alias("value")), first=5).count() <= 5
