"""Spans and contexts in portions of text."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from driftline.operators import contexts as cx
from driftline.plans.catalog import QUERIES
from driftline.sources import fixtures as fx


def texts(spark):
    rnd = random.Random(11)
    own = ["".join(rnd.choice(["a", "bb", "Targét", "x-y", " ", " ", "  ", ".", "!?", ",", "\n", "7", "(é"]) for _ in range(rnd.randrange(0, 300))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate([*own, None, "", ".", "one"])), "record_id long, text string")


def test_portions_are_bounded():
    batch = pa.record_batch({"text": pa.array(["é" * 5, None, "b" * 30, "", "c", "d" * 9])})
    parts = [t for _, t in cx._portions(iter([batch, batch.slice(0, 0)]), 12)]
    assert parts == [["é" * 5, ""], ["b" * 30, ""], ["c", "d" * 9]] or [x for p in parts for x in p] == ["é" * 5, "", "b" * 30, "", "c", "d" * 9]
    assert all(sum(len(x.encode()) for x in p) <= 12 or len([x for x in p if x]) == 1 for p in parts)


def test_one_pass_gives_the_same_contexts(spark, monkeypatch):
    monkeypatch.setattr(cx, "CONTEXTS_OF", 500)
    monkeypatch.setattr(cx, "SPANS_OF", 700)
    t = texts(spark)
    columns = ["record_id", "token", "begin", "end", "context"]
    want = cx.contexts(cx.token_spans(t)).select(*columns).collect()
    assert sorted(cx.text_contexts(t).select(*columns).collect()) == sorted(want) and len(want) > 1000
    assert sorted(cx.text_contexts(t, 3).select(*columns).collect()) == sorted(r for r in want if r.end - r.begin >= 3)
    some = cx.token_spans(t, ["targét", "a"]).select("record_id", "token", "begin", "end").collect()
    assert sorted(some) == sorted(r[:4] for r in want if r.token in ("targét", "a"))


def test_no_text_travels_with_its_words(spark, sf):
    plan = QUERIES["eligible_contexts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # documents with their dates, words with the gate
    plan = cx.token_spans(fx.texts(spark, sf), ["hehely"]).select("token")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
