"""Words are counted by pieces of text: the same counts as by occurrences, whatever the texts and however they are portioned."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import frequency as fq
from driftline.operators import pieces
from driftline.sources import fixtures as fx

ODD = [
    "", None, " ", "abcd ABCD,abcd.Abcd\r\nabcd\x0babcd\x00abcd", "Über ÜBER über ÀÞ àþ A×B a÷b ß ÿÝ Öl-Öl", "don't 'quoted' -a-b- _x_ x_ 1a a1 a1b 12ab34cd a--b", "ΣΑΣ ΌΣΟΣ aΣ Σ ΑΣ-β İstanbul aİ ABCİ İ",
    "½x x² Ⅷ ⅷa µm ªº ﬁn ǅ", "x\xa0y zzzz​word“Quoted”—dash…", "𝐀𝐁𝐂𝐃 𐐀𐐁𐐂𐐃 日本語テキスト क्षत्रिय", "école École KK Å", "mail@Example.com #Tag %41bc </p>Text<br>", "x" * 5000, "the " * 999,
]


def by_occurrence(texts, shortest=1):
    cut = texts.select("half_year", F.explode(tx.words(F.col("text"))).alias("word")).where(F.length("word") >= shortest)
    return cut.groupBy("half_year", "word").agg(F.count("*").alias("c"))


@pytest.mark.parametrize("shortest", [1, 2, 4])
@pytest.mark.parametrize("held, cut_of", [(pieces.HELD, pieces.CUT_OF), (40, 7)])
def test_the_counts_of_all_occurrences(spark, monkeypatch, shortest, held, cut_of):
    monkeypatch.setattr(pieces, "HELD", held)
    monkeypatch.setattr(pieces, "CUT_OF", cut_of)
    rows = [(h, t) for i, t in enumerate(ODD) for h in ["2000H1", "2000H2", None, "unknown"][: 1 + i % 4]]
    texts = spark.createDataFrame(rows, "half_year string, text string").repartition(3)
    found = fq.counts(texts, shortest)
    assert found.dtypes == [("half_year", "string"), ("word", "string"), ("c", "bigint")]
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, by_occurrence(texts, shortest).collect()))
    assert fq.counts(texts.where("text IS NULL")).count() == 0


def test_the_counts_of_the_corpus(spark, sf):
    own = fx.counted_texts(spark, sf)
    assert sorted(map(tuple, fq.counts(own, 4).collect())) == sorted(map(tuple, by_occurrence(fx.texts(spark, sf), 4).collect()))


def test_texts_are_not_searched_for_words(spark, sf):
    plan = fq.counts(fx.counted_texts(spark, sf), 4)._jdf.queryExecution()
    cut = plan.optimizedPlan().toString()
    assert "regexp_extract_all(piece" in cut and "regexp_extract_all(text" not in cut
    assert "ShuffledHashJoin" in plan.sparkPlan().toString()  # orders, which grow, go to no broadcast, and texts are not sorted


@pytest.mark.parametrize("most", [1, 10, 25, 1000])
def test_portions_keep_every_text(most):
    sizes = [[3, 0, 30, 5], [], [4, 4, 4, 4, 4], [0, 0], [11]]
    texts = [[chr(97 + i) * n for i, n in enumerate(b)] + [None] for b in sizes]
    parts = [p.column("text").to_pylist() for p in pieces._portions(iter(pa.record_batch([pa.array(b, pa.string())], ["text"]) for b in texts), most)]
    assert [t for p in parts for t in p] == [t for b in texts for t in b if t is not None]
    assert all(len(p) == 1 or sum(map(len, p)) <= most for p in parts)
