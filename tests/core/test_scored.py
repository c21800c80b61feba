"""Scored occurrences: words are cut out of uncleaned texts, and no list of eligible words is joined."""

from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import contexts as cx
from driftline.operators import frequency as fq
from driftline.plans.catalog import QUERIES


def test_no_list_is_joined(spark, sf):
    plan = QUERIES["scored_occurrences"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_words_need_no_squeezed_spaces(spark):
    odd = ["", None, " a\t\tb\x0b c ", "seehttps://x.y/z?q tail", "http://a https://b", "://no http:// https:/x", "İstanbul  ΣΑΣ\n½x²", "a-'b' -c_d", "x\xa0y z", "ahttp://b c d"]
    rows = spark.createDataFrame([(x,) for x in odd], "body string").select(tx.words(tx.clean(F.col("body"))).alias("a"), tx.words(tx.for_words(F.col("body"))).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[3]["b"] == ["see", "tail"]


def test_short_words_are_left_out_after_lower_case(spark):
    texts = spark.createDataFrame([("2000H1", "abc abcd ABCD Aİx x")], "half_year string, text string")
    assert {(r["word"], r["c"]) for r in fq.counts(texts, 4).collect()} == {("abcd", 2), ("ai̇x", 1)}
    assert fq.counts(texts).count() == 4


def test_since_eligible_is_the_join(spark):
    cells = [("2000H1", "a", 1), ("2000H2", "a", 5), ("2001H1", "a", 2), ("2000H1", "b", 4), (None, "c", 9), ("2000H1", "c", 1), (None, "d", 2), ("2000H2", "d", 7)]
    freq = spark.createDataFrame(cells, "half_year string, word string, c long")
    for floor in (1, 5, 9, 10):
        own = fq.since_eligible(freq, floor).select("half_year", "word", "c", F.when(F.col("half_year") < F.col("eligible_from"), "before_eligible").alias("drop_reason"))
        joined = cx.gated(freq.withColumnRenamed("word", "token"), fq.eligible_from(freq, floor)).select("half_year", "token", "c", "drop_reason")
        assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, joined.collect()), key=repr)
