"""The tables that the queries run on, as the engine's own inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.functions.vectors import dot
from driftline.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the date of the order of the same number: record_id, created, channel, body."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return d.join(o, d["doc_id"] == o["o_orderkey"]).select(F.col("doc_id").alias("record_id"), F.col("o_orderdate").alias("created"), F.col("source").alias("channel"), F.col("text").alias("body"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, half_year and cleaned text of the corpus."""
    return corpus(spark, sf_dir).select("record_id", tx.half_year(F.col("created")).alias("half_year"), tx.clean(F.col("body")).alias("text"))


def counted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """half_year and text of the corpus, cleaned as far as its words need it. The join deals the texts out; orders are hashed, so that texts are not sorted and orders not gathered for a broadcast."""
    d, o = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return d.join(o.hint("shuffle_hash"), d["doc_id"] == o["o_orderkey"]).select(tx.half_year(F.col("o_orderdate")).alias("half_year"), tx.for_words(F.col("text")).alias("text"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as JSON lines, some of them broken on purpose: record_id, value."""
    c, i = corpus(spark, sf_dir), F.col("record_id")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', created)").cast("string")
    record = F.struct(
        F.when(i % 13 != 0, F.concat(F.lit("R/"), F.upper("channel"))).alias("subreddit"),
        F.when(i % 17 == 0, "[removed]").when(i % 19 == 0, "").when(i % 23 == 0, " https://a.example/x ").otherwise(F.col("body")).alias("body"),
        F.when((i % 19 == 0) & (i % 2 == 0), F.lit("Some other text, given instead.")).alias("selftext"),
        F.when(i % 29 == 0, "nan").when(i % 31 == 0, "soon").otherwise(seconds).alias("created_utc"),
    )
    return c.select(i, F.when(i % 11 == 0, '{"subreddit": "broken').when(i % 37 == 0, " ").otherwise(F.to_json(record)).alias("value"))


def dense(spark: SparkSession, sf_dir: str, word: str = "p_brand") -> DataFrame:
    """A dense count table: lines by half-year of shipping and brand (or type) of the part."""
    li, p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate"), table(spark, sf_dir, "part").select("p_partkey", word)
    return li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(tx.half_year(F.col("l_shipdate")).alias("half_year"), F.col(word).alias("word")).agg(F.count("*").alias("c"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, half_year, word (the label) and embedding."""
    e, o = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return e.join(o, e["vec_id"] == o["o_orderkey"]).select("vec_id", tx.half_year(F.col("o_orderdate")).alias("half_year"), tx.month(F.col("o_orderdate")).alias("month"), F.concat(F.lit("w"), "label").alias("word"), "embedding")


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every tenth embedding as a context (ctx, half_year, word, a), and all of them as tokens (token, token_word, topic, junk, b). The contexts are the stated query set."""
    own = vectors(spark, sf_dir).where("vec_id % 10 = 0").select(F.col("vec_id").alias("ctx"), "half_year", "word", F.col("embedding").alias("a"))
    return own, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.concat(F.lit("w"), "label").alias("token_word"), (F.col("label") == 0).alias("topic"), (F.col("vec_id") % 17 == 0).alias("junk"), F.col("embedding").alias("b"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() as a table: ctx, half_year, word, token, topic, junk, logit, a row for each pair. Queries score in tiles; this is for comparison."""
    own, vocabulary = scored(spark, sf_dir)
    met = own.join(vocabulary, F.col("ctx") != F.col("token"))
    return met.select("ctx", "half_year", "word", "token", "token_word", "topic", "junk", dot(F.col("a"), F.col("b")).alias("logit"))


def instances(spark: SparkSession, sf_dir: str, word: str = "source") -> DataFrame:
    """word, month and hit of labelled documents."""
    d, x, o = table(spark, sf_dir, "documents").select("doc_id", word), table(spark, sf_dir, "labels"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return d.join(x, "doc_id").join(o, F.col("doc_id") == F.col("o_orderkey")).select(F.col(word).alias("word"), tx.month(F.col("o_orderdate")).alias("month"), (F.col("toxic") == 1).alias("hit"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word (event type), half_year (one for each day, so that there are some), cosine and n_occurrences."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    return e.groupBy(F.col("event_type").alias("word"), tx.label(F.lit(4000) + day).alias("half_year")).agg(F.avg("value").alias("cosine"), F.count("*").alias("n_occurrences"))
