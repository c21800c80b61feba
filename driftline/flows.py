"""The engine's data flows as single calls, from raw lines or tables to results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.stopwords import STOP_WORDS
from driftline.operators import contexts as cx
from driftline.operators import frequency as fq
from driftline.operators import sampling, scoring, series, vectors
from driftline.session import stored
from driftline.sources import corpus
from driftline.streaming import changes


@dataclass(frozen=True)
class Frequency:
    """counts: half_year, word, c of what the filters keep; totals by half-year; dropped: lines by reason; removed: words by reason."""

    counts: DataFrame
    totals: DataFrame
    dropped: DataFrame
    removed: DataFrame


def build_frequency(lines: DataFrame, scope: DataFrame | None = None, years: tuple[int, int] = (2012, 2026), min_freq: int = 30, mode: str = "per-half-year", stop: tuple[str, ...] = STOP_WORDS) -> Frequency:
    """The word counts of raw lines (value) by half-year."""
    judged = corpus.judged(lines, scope, years)
    raw = stored(fq.counts(judged.where("drop_reason IS NULL").select("half_year", "text")), "counts")
    kept = fq.postfilter(fq.prefiltered(raw, stop), min_freq, mode)
    dropped = judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))
    return Frequency(kept, fq.totals(raw, kept), dropped, fq.prefilter_counts(raw, stop))


def build_hits(texts: DataFrame, freq: DataFrame, topic: DataFrame, scorer: scoring.Scorer, min_freq: int = 2, excluded: Column | None = None) -> DataFrame:
    """The hit summary of texts (record_id, half_year, text): every occurrence of a word that was eligible by then is masked, scored, and its rank among the tokens set against the topic's (column token)."""
    eligible = fq.eligible_from(freq, min_freq)
    masked = cx.gated(cx.text_contexts(texts), eligible).where("drop_reason IS NULL")
    asked = stored(masked.select(F.xxhash64("record_id", "begin").alias("ctx"), "half_year", F.col("token").alias("word"), "context"), "contexts")
    own = topic.select("token", F.lit(True).alias("topic")).distinct()
    logits = scorer.logits(asked).join(own, "token", "left").withColumn("topic", F.coalesce("topic", F.lit(False))).join(asked.select("ctx", "half_year", "word"), "ctx")
    return scoring.hit_summary(scoring.hit_cells(scoring.mlm_score(logits, excluded)), freq)


def detect_candidates(texts: DataFrame, keywords: list[str], scorer: scoring.Scorer, k: int = 50, threshold: int = 5, longest: int | None = 150, by_sentence: bool = False, per_half_year: int | None = None, excluded: Column | None = None, top: int | None = None) -> DataFrame:
    """Candidates by half-year, best first: what a scorer puts in the place of masked keywords, where two keywords or more are likely there."""
    units = cx.masked_units(texts, keywords, longest, by_sentence)
    if per_half_year is not None:
        units = cx.capped(units, per_half_year, order=("record_id", "unit_no", "keyword")).drop("place")
    asked = stored(units.select(F.xxhash64("record_id", "unit_no", "keyword").alias("ctx"), "half_year", F.col("masked").alias("context")), "units")
    ranked = scoring.top_k(scorer.logits(asked).join(asked.select("ctx", "half_year"), "ctx"), k).withColumn("token_word", F.col("token"))
    return scoring.ranked_candidates(scoring.candidate_scores(scoring.informative(ranked, F.col("token").isin(*keywords), threshold, excluded)), top)


def pilot_selection(freq: DataFrame, positives: DataFrame, n_pilot: int = 30, min_freq: int = 50, min_periods: int = 8, per: int = 1, near: int = 20, seed: int = 0) -> DataFrame:
    """word, role: positives (column word) that are eligible, split into pilot_positives and heldout_positives, and pilot_negatives of near profiles."""
    eligible = fq.eligible_words(freq, min_freq, min_periods).select("word")
    split = stored(sampling.split(eligible.join(positives.select("word").distinct(), "word", "left_semi"), n_pilot, "word", seed), "split")
    profiles = fq.log_rate(freq).join(eligible, "word", "left_semi").select("half_year", "word", "value")
    free = profiles.join(split.where("part = 'heldout'").select("word"), "word", "left_anti")
    chosen = vectors.greedy_negatives(vectors.nearest_profiles(free, split.where("part = 'pilot'").select("word"), 2 * near), per, near, seed)
    roles = split.select("word", F.when(F.col("part") == "pilot", "pilot_positives").otherwise("heldout_positives").alias("role"))
    return roles.unionByName(chosen.select("word", F.lit("pilot_negatives").alias("role")))


def sample_contexts(texts: DataFrame, word: str, k: int = 1000, seed: int = 0) -> DataFrame:
    """k masked contexts of a word for each half-year, uniformly, with n_seen."""
    masked = cx.contexts(cx.token_spans(texts, [word])).where("drop_reason IS NULL")
    return sampling.per_group(masked.select("half_year", F.concat_ws(":", "record_id", "begin").alias("context_id"), "context"), k, ["half_year"], "context_id", seed)


def change_points(signal: DataFrame, cfg: series.Config = series.Config(), first: int | None = None) -> DataFrame:
    """Ranked results of a signal (half_year, word, value); first: of so many words by name only."""
    own = signal if first is None else fq.first_words(signal, first)
    return series.ranked(stored(series.change_points(own, cfg), "change-points"), cfg)


def stream_change_points(lines: DataFrame, rules: changes.Rules = changes.Rules()) -> DataFrame:
    """A stream of alerts from a stream of JSON lines (value, arrived)."""
    return changes.alerts(changes.observations(lines), rules)
