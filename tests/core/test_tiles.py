"""Tiles against the same scores made from a row for each pair, odd vectors included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.vectors import dot
from driftline.operators import scoring, tiles
from driftline.plans.catalog import QUERIES


@pytest.fixture
def tables(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CONTEXTS", 3)
    monkeypatch.setattr(tiles, "VOCABULARY", 7)
    monkeypatch.setattr(tiles, "AT_ONCE", 10)

    def vector(i):
        if i in (8, 20):
            return None
        if i in (12, 13):
            return [1.0, 2.0]
        if i == 16:
            return [0.5, None, 1.0]
        return [float(i * 7 % 5), float(i * 3 % 4) / 3, float(i % 3) * 0.1]  # many are equal

    rows = [(i, f"w{i % 4}" if i % 9 else None, None if i == 5 else i % 4 == 0, i % 6 == 5, vector(i)) for i in range(40)]
    vocabulary = spark.createDataFrame(rows, "token long, token_word string, topic boolean, junk boolean, b array<float>")
    contexts = vocabulary.where("token % 2 = 0").select(F.col("token").alias("ctx"), F.lit("2000H1").alias("half_year"), F.col("token_word").alias("word"), F.col("b").alias("a"))
    pairs = contexts.join(vocabulary, F.col("ctx") != F.col("token")).withColumn("logit", dot(F.col("a"), F.col("b"))).drop("a", "b")
    return contexts, vocabulary, pairs


def same(a, b):
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(a) == rows(b)


def test_scores(tables):
    contexts, vocabulary, pairs = tables
    same(tiles.mlm_score(contexts, vocabulary.where("NOT junk")), scoring.mlm_score(pairs, F.col("junk")))
    none = F.lit(False)
    same(tiles.mlm_score(contexts, vocabulary.withColumn("topic", none)), scoring.mlm_score(pairs.withColumn("topic", none)))


@pytest.mark.parametrize("k", [1, 5, 39, 100])
def test_first_k(tables, k):
    contexts, vocabulary, pairs = tables
    same(tiles.top_k(contexts, vocabulary, k), scoring.top_k(pairs, k))


def test_context_alone(spark, tables):
    contexts, vocabulary, _ = tables
    assert tiles.mlm_score(contexts.where("ctx = 4"), vocabulary.where("token = 4")).isEmpty()
    assert tiles.top_k(contexts.where("ctx = 4"), vocabulary.where("token = 4")).isEmpty()
    assert tiles.top_k(contexts, vocabulary.where("token < 0")).isEmpty() and tiles.mlm_score(contexts.where("ctx < 0"), vocabulary).isEmpty()


@pytest.mark.parametrize("name", ["mlm_score", "mlm_topk"])
def test_no_pair_becomes_a_row(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "NOT (ctx" not in plan


def test_order_of_sums_decides(spark, monkeypatch):
    """Copies of vectors in every place of tiles of different widths: a matrix product sets some apart by a last bit, and ties are by token."""
    monkeypatch.setattr(tiles, "PORTION", (3, 50))
    rng = np.random.default_rng(1)
    some = (rng.normal(size=(40, 64)) * 3).astype("float32").astype(float)
    rows = [(i, i % 3 == 0, some[i * 7 % 40].tolist()) for i in range(901)]
    vocabulary = spark.createDataFrame(rows, "token long, topic boolean, b array<double>").cache()
    contexts = vocabulary.where("token % 20 = 0").select(F.col("token").alias("ctx"), F.lit("2000H1").alias("half_year"), F.col("b").alias("a"))
    pairs = contexts.join(vocabulary, F.col("ctx") != F.col("token")).withColumn("logit", dot(F.col("a"), F.col("b"))).drop("a", "b")
    same(tiles.mlm_score(contexts, vocabulary), scoring.mlm_score(pairs))
    same(tiles.top_k(contexts, vocabulary, 30), scoring.top_k(pairs, 30))


def test_a_block_a_partition(spark):
    rows = spark.range(0, 40 * 16, 1, 16).select(F.col("id").alias("token"), F.array(F.lit(1.0)).alias("b"))
    sizes = tiles.blocks(rows, 640, 16, "y").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sizes == [1] * 40


def test_predictions_are_made_once(spark, sf):
    plan = QUERIES["candidate_scores"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") + plan.count("Join Inner") == 1
