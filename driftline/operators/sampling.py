"""Seeded samples: a row's place is the order of a hash of seed and key, so reruns and any partitioning agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def unit(seed: int, *keys: str) -> Column:
    """A number in (0, 1) of 52 bits."""
    return (F.conv(F.substring(draw(seed, *keys), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def per_group(rows: DataFrame, k: int, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """k rows of each group, uniformly, with n_seen, the size of the group. Ranks are cut before the shuffle, so a large group sends k rows a task."""
    order = Window.partitionBy(*by).orderBy(draw(seed, key), key)
    kept = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return kept.join(rows.groupBy(*by).agg(F.count("*").alias("n_seen")), by)


def weighted(rows: DataFrame, k: int, weight: str, key: str, seed: int = 0) -> DataFrame:
    """k rows, the chance of each in proportion to its weight: the largest u ** (1 / weight). Rows of no weight are never drawn."""
    return rows.where(F.col(weight) > 0).withColumn("priority", F.pow(unit(seed, key), 1 / F.col(weight).cast("double"))).orderBy(F.col("priority").desc(), key).limit(k)


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, uniformly; each task keeps n at most."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def split(rows: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """rows with part: pilot for k of them, heldout for the rest. Keys are different; the k keys of the pilot (a parameter) go to each task."""
    pilot = sample(rows.select(key), k, key, seed).select(key, F.lit("pilot").alias("part"))
    return rows.join(F.broadcast(pilot), key, "left").select(*rows.columns, F.coalesce("part", F.lit("heldout")).alias("part"))
