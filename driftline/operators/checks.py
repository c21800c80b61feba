"""Checks that results of different runs or shards go together; each one can be read as a table, or raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import text as tx


def agreement(shards: DataFrame, **parameters: Column | str) -> DataFrame:
    """parameter, n_different, agree: how many values each parameter has over all shards. A missing value is one too, unless the caller fills it."""
    named = {k: F.col(v) if isinstance(v, str) else v for k, v in parameters.items()}
    n = shards.agg(*[F.count_distinct(F.to_json(F.struct(v.alias("v")))).alias(k) for k, v in named.items()])
    laid = n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("parameter"), F.col(k).alias("n_different")) for k in named])).alias("x")).select("x.*")
    return laid.withColumn("agree", F.col("n_different") <= 1)


def agreed(shards: DataFrame, **parameters: Column | str) -> DataFrame:
    """shards, if they agree on all parameters; else an error that names those that differ."""
    if odd := [r.parameter for r in agreement(shards, **parameters).where("NOT agree").collect()]:
        raise ValueError(f"shards differ in {', '.join(sorted(odd))}")
    return shards


def same_scope(meta: dict, mode: str, digest: str | None) -> None:
    """An error if a run's scope (all or subreddits, and the hash of its names) is not that of the count table that it divides by."""
    held = meta.get("scope", {})
    if (held.get("mode"), held.get("hash")) != (mode, digest):
        raise ValueError(f"the count table's scope is {held.get('mode')} {held.get('hash')}, this run's {mode} {digest}")


def misplaced(cells: DataFrame, month: str = "month", half_year: str = "half_year") -> DataFrame:
    """Cells whose half-year is not that of the month they were made from; a null month says nothing."""
    own = F.concat(F.substring(month, 1, 4), F.when(F.substring(month, 6, 2).cast("int") <= 6, "H1").otherwise("H2"))
    return cells.where(F.col(month).isNotNull() & ~own.eqNullSafe(F.col(half_year)))


def in_place(cells: DataFrame, month: str = "month", half_year: str = "half_year") -> DataFrame:
    """cells, if none is misplaced."""
    if (odd := misplaced(cells, month, half_year).first()) is not None:
        raise ValueError(f"{odd[month]} holds a cell of {odd[half_year]}")
    return cells


def complete_rows(rows: DataFrame, half_years: list[str], words: int) -> DataFrame:
    """Row tables (half_year, word, and values), if there is one for each expected half-year, no other, and each has every word once."""
    found = {r.half_year: (r.n, r.d) for r in rows.groupBy("half_year").agg(F.count("*").alias("n"), F.count_distinct("word").alias("d")).collect()}  # a row for each half-year
    if missing := sorted(set(half_years) - set(found)):
        raise FileNotFoundError(f"no row for {', '.join(missing)}")
    if odd := sorted(set(found) - set(half_years)):
        raise ValueError(f"rows that are not expected: {', '.join(odd)}")
    if wrong := sorted(h for h, x in found.items() if x != (words, words)):
        raise ValueError(f"not {words} words in {', '.join(wrong)}")
    return rows


def vocabulary_fits(vocabulary: int, embeddings: int) -> None:
    """An error if a model has fewer vectors than its tokenizer has tokens."""
    if embeddings < vocabulary:
        raise ValueError(f"{vocabulary} tokens, but {embeddings} vectors")


def label_order(labels: DataFrame) -> DataFrame:
    """Half-year labels that are none, as the streams and series would put them out of order."""
    return labels.where(tx.ordinal(F.col("half_year")).isNull())
