"""Centroids and drift of embeddings. Weights are by occurrence: a mean is over rows, never over means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.vectors import cosine, mean_vector, norm
from driftline.operators.sampling import draw
from driftline.session import small


def dimension(*columns: tuple[DataFrame, str]) -> int:
    """The one length that the vectors of all (table, column) have; 0 where there are none. Different lengths are an error."""
    lengths = set()
    for df, c in columns:
        found = df.where(F.col(c).isNotNull()).agg(F.min(F.size(c)).alias("least"), F.max(F.size(c)).alias("most")).first()
        lengths |= {found.least, found.most} - {None}
    if len(lengths) > 1:
        raise ValueError(f"vectors have {min(lengths)} to {max(lengths)} places")
    return lengths.pop() if lengths else 0


def centroids(vectors: DataFrame, by: list[str], dim: int | None = None) -> DataFrame:
    """The mean vector and number of vectors of each group (no columns: of all). dim: the vectors' length, read from the data where it is not given."""
    dim = dimension((vectors, "embedding")) if dim is None else dim
    return vectors.groupBy(*by).agg(mean_vector("embedding", dim).alias("centroid"), F.count("*").alias("n"))


def month_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("word", "month").agg(F.count("*").alias("n"))


def count_stats(counts: DataFrame) -> DataFrame:
    """min, median, mean and max of a column n."""
    return counts.agg(F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), F.count("*").alias("n_terms"))


def top_terms(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n terms of most occurrences, ties by name."""
    return counts.orderBy(F.col("n").desc(), "word").limit(n)


def cosine_drift(vectors: DataFrame, topic: DataFrame) -> DataFrame:
    """half_year, word, cosine of the cell's mean vector to the topic's centroid (one row, column centroid), n_occurrences; null where a vector has no length."""
    cells = centroids(vectors, ["half_year", "word"], dimension((vectors, "embedding"), (topic, "centroid"))).withColumnRenamed("centroid", "mean")
    return cells.crossJoin(F.broadcast(topic.select("centroid").limit(1))).select("half_year", "word", cosine(F.col("mean"), F.col("centroid")).alias("cosine"), F.col("n").alias("n_occurrences"))


def cosine_metrics(vectors: DataFrame, topic: DataFrame) -> DataFrame:
    """half_year, word: population deviation of the occurrences' cosines, and the length of the mean vector."""
    dim = dimension((vectors, "embedding"), (topic, "centroid"))
    each = vectors.crossJoin(F.broadcast(topic.select("centroid").limit(1))).withColumn("cos", cosine(F.col("embedding"), F.col("centroid")))
    cells = each.groupBy("half_year", "word").agg(F.stddev_pop("cos").alias("std_occurrence_cosine"), mean_vector("embedding", dim).alias("mean"))
    return cells.select("half_year", "word", "std_occurrence_cosine", norm(F.col("mean")).alias("mean_embedding_norm"))


def nearest_profiles(profiles: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
    """For each target word the k words of nearest profile (Euclidean), targets left out. profiles: word, half_year, value. Targets and their profiles meet others by half-year (broadcast where they are small by bytes), and a value that a side lacks counts as 0."""
    targets = small(targets.select("word").distinct())
    t = profiles.join(targets, "word", "left_semi").select(F.col("word").alias("target"), "half_year", F.col("value").alias("t"))
    o = profiles.join(targets, "word", "left_anti")
    # |a - b|^2 = |a|^2 + |b|^2 - 2ab: only common half-years have to meet.
    square = lambda df, key, v: df.groupBy(key).agg(F.sum(F.col(v) * F.col(v)).alias(f"{key}_sq"))
    ab = o.join(small(t), "half_year").groupBy("target", "word").agg(F.sum(F.col("t") * F.col("value")).alias("ab"))
    d = ab.join(square(o, "word", "value"), "word").join(square(t, "target", "t"), "target")
    d = d.withColumn("distance", F.round(F.sqrt(F.greatest(F.col("word_sq") + F.col("target_sq") - 2 * F.col("ab"), F.lit(0.0))), 6))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("distance", "word"))).where(F.col("place") <= k).select("target", "word", "distance", "place")


def greedy_negatives(near: DataFrame, per: int = 1, top: int = 20, seed: int = 0) -> DataFrame:
    """`per` negatives for each target out of its `top` nearest that are still free, drawn by the order of a seeded hash, targets in order. Each choice depends on those before it, so at most targets * places rows (a pilot's list) are taken in order on the driver."""
    rows: dict[str, list[tuple[str, str]]] = {}
    drawn = near.select("target", "word", "place", draw(seed, "target", "word").alias("at"))
    for r in drawn.orderBy("target", "place").toLocalIterator():
        rows.setdefault(r.target, []).append((r.at, r.word))
    used, out = set(), []
    for target, words in rows.items():
        for _, w in sorted([x for x in words if x[1] not in used][:top])[:per]:
            used.add(w)
            out.append((target, w))
    return near.sparkSession.createDataFrame(out, "target string, word string")
