"""Scores of masked contexts, as relations over (context, token, logit), and what is made of them.

A scorer turns contexts into logits or into scores. RelationalScorer works on a logits table; CountScorer makes one from
bigram counts of a corpus; PandasScorer wraps any Python model, one batch of contexts at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.session import small, stored

RANKS = (5, 10, 15, 20, 50)


class Scorer(Protocol):
    def logits(self, contexts: DataFrame) -> DataFrame: ...


class RelationalScorer:
    """Logits that are there already, by context."""

    def __init__(self, table: DataFrame):
        self.table = table

    def logits(self, contexts: DataFrame) -> DataFrame:
        return self.table.join(contexts.select("ctx").distinct(), "ctx", "left_semi")


def surroundings(texts: DataFrame, targets: list[str]) -> DataFrame:
    """ctx, left, right: the words around each occurrence of a target that has one on both sides, in one narrow pass (texts: record_id, text)."""
    w = F.col("w")
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.size(w) - 2).alias("pos"), w.alias("left"), F.slice(w, 2, F.size(w)).alias("token"), F.slice(w, 3, F.size(w)).alias("right"))
    if all(t.isascii() for t in targets):  # texts without a target are not cut
        texts = texts.where(functools.reduce(lambda a, b: a | b, [F.lower("text").contains(t) for t in targets], F.lit(False)))
    found = _listed(texts).where(F.size(w) > 2).select("record_id", F.explode(F.filter(zipped, lambda x: x["pos"].isNotNull() & x["token"].isin(*targets))).alias("x"))
    return found.select(F.concat_ws(":", "record_id", "x.pos").alias("ctx"), "x.left", "x.right")


def _listed(texts: DataFrame) -> DataFrame:
    """record_id and the words w of each text; as the row of a list of one, so that they are cut out once however often they are used."""
    return texts.select("record_id", F.explode(F.array(tx.words(F.col("text")))).alias("w"))


class CountScorer:
    """Logits from a corpus: ln of smoothed counts of a token after the word before the mask, and before the word after it."""

    def __init__(self, tokens: DataFrame | None = None, smoothing: float = 0.1, pairs: DataFrame | None = None):
        # tokens: record_id, pos, token; or pairs of neighbours with their counts: before, token, n
        if pairs is None:
            after = tokens.select("record_id", (F.col("pos") + 1).alias("pos"), F.col("token").alias("before"))
            pairs = tokens.join(after, ["record_id", "pos"]).groupBy("before", "token").agg(F.count("*").alias("n"))
        self.pairs = pairs
        self.smoothing = smoothing

    @classmethod
    def of_texts(cls, texts: DataFrame, contexts: DataFrame, smoothing: float = 0.1) -> CountScorer:
        """A scorer for these contexts (ctx, left, right): pairs of neighbours that touch none of their words are left out where the texts are read, as they score nothing."""
        w = F.col("w")
        near = _listed(texts).where(F.size(w) > 1).select(F.explode(F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("before"), F.slice(w, 2, F.size(w)).alias("token"))).alias("x")).select("x.*")
        lefts, rights = (small(contexts.select(F.col(c).alias(n)).distinct().withColumn(c, F.lit(True))) for c, n in (("left", "before"), ("right", "token")))
        met = near.join(lefts, "before", "left").join(rights, "token", "left").where(F.col("left") | F.col("right"))
        return cls(smoothing=smoothing, pairs=stored(met.groupBy("before", "token").agg(F.count("*").alias("n")), "pairs"))

    def top_k(self, contexts: DataFrame, k: int) -> DataFrame:
        """ctx, token, p, rank: top_k() of logits(), but the vocabulary is gone through once for different surroundings: no row for a surrounding and a token. Each word's neighbours are packed into one string."""
        zero = F.ln(F.lit(0) + self.smoothing)
        asked = contexts.select("left", "right").distinct()
        ln = F.ln(F.col("n") + self.smoothing).alias("ln")
        sides = (("left", self.pairs.select(F.col("before").alias("left"), "token", ln)), ("right", self.pairs.select(F.col("token").alias("right"), F.col("before").alias("token"), ln)))
        for side, rows in sides:
            wanted = rows.join(small(asked.select(side).distinct()), side, "left_semi")
            asked = asked.join(small(stored(wanted.groupBy(side).applyInArrow(_packer(side), f"{side} string, near_{side} binary"), f"near-{side}")), side, "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    left, right, a, b, zero = (batch.column(c)[i].as_py() for c in ("left", "right", "near_left", "near_right", "zero"))
                    token, p = _likeliest(_unpacked(a), _unpacked(b), zero, k)
                    n = len(token)
                    yield pa.record_batch({"left": pa.array([left] * n, pa.string()), "right": pa.array([right] * n, pa.string()), "token": pa.array(token, pa.string()), "p": pa.array(p, pa.float64()), "rank": pa.array(range(1, n + 1), pa.int32())})

        best = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism).withColumn("zero", zero).mapInArrow(run, "left string, right string, token string, p double, rank int")
        return contexts.select("ctx", "left", "right").join(small(stored(best, "likeliest")), ["left", "right"]).select("ctx", "token", "p", "rank")

    def logits(self, contexts: DataFrame) -> DataFrame:
        """contexts: ctx, left, right (the words around the mask). Only tokens seen on a side are scored, once for equal surroundings."""
        asked = contexts.select("left", "right").distinct()
        a = asked.join(self.pairs.withColumnRenamed("before", "left"), "left").select("left", "right", "token", F.col("n").alias("l"), F.lit(0).alias("r"))
        b = asked.join(self.pairs.select(F.col("token").alias("right"), F.col("before").alias("token"), "n"), "right").select("left", "right", "token", F.lit(0).alias("l"), F.col("n").alias("r"))
        both = a.unionByName(b).groupBy("left", "right", "token").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        scored = both.select("left", "right", "token", (F.ln(F.col("l") + self.smoothing) + F.ln(F.col("r") + self.smoothing)).alias("logit"))
        return contexts.select("ctx", "left", "right").join(scored, ["left", "right"]).select("ctx", "token", "logit")


def _packer(side: str):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        own = rows.select(["token", "ln"])
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own)
        return pa.table({side: pa.array([key[0].as_py()], pa.string()), f"near_{side}": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return pack


def _unpacked(blob: bytes | None) -> tuple[pa.Array, np.ndarray]:
    if blob is None:
        return pa.array([], pa.string()), np.zeros(0)
    t = pa.ipc.open_stream(blob).read_all().combine_chunks()
    token = t.column("token").combine_chunks()
    return token.chunk(0) if isinstance(token, pa.ChunkedArray) else token, t.column("ln").to_numpy()


def _likeliest(a: tuple[pa.Array, np.ndarray], b: tuple[pa.Array, np.ndarray], zero: float, k: int) -> tuple[list[str], np.ndarray]:
    """The k tokens of the largest sums of both sides (zero where a side has none), ties by token, with their share of all."""
    at = pc.index_in(a[0], value_set=b[0])
    met = np.asarray(pc.fill_null(at, -1))
    alone = np.ones(len(b[1]), bool)
    alone[met[met >= 0]] = False
    of_b = np.append(b[1], zero)  # place -1: none
    tokens = pa.concat_arrays([a[0].cast(pa.string()), b[0].cast(pa.string()).filter(pa.array(alone))])
    logit = np.concatenate([a[1] + of_b[met], zero + b[1][alone]])
    if not len(logit):
        return [], logit
    e = np.exp(logit - logit.max())
    least = np.partition(logit, len(logit) - k)[len(logit) - k] if len(logit) > k else -np.inf
    some = np.flatnonzero(logit >= least)
    names = tokens.take(pa.array(some)).to_pylist()
    first = sorted(range(len(some)), key=lambda i: (-logit[some[i]], names[i]))[:k]
    return [names[i] for i in first], e[some[first]] / e.sum()


class PandasScorer:
    """A Python model: load() makes it once a worker, score(model, contexts) gives a frame of ctx, token, logit."""

    def __init__(self, load: Callable[[], object], score: Callable[[object, pd.DataFrame], pd.DataFrame]):
        self.load, self.score = load, score

    def logits(self, contexts: DataFrame) -> DataFrame:
        load, score = self.load, self.score

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for f in frames:
                yield score(model, f)

        return contexts.mapInPandas(run, "ctx long, token string, logit double")


def vocabulary_exclusions(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """Tokens that are never scored: special ones, word pieces and such without a letter or digit."""
    t = F.col(token)
    return vocabulary.where(t.rlike(r"^\[.*\]$") | t.startswith("##") | ~t.rlike(r"[\p{L}\p{N}]"))


def term_ids(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, term) of the terms that are one token of a vocabulary (token, id); terms of several pieces are left out, and that none is left is an error."""
    out = small(terms.select("term").distinct()).join(vocabulary.select(F.col("token").alias("term"), "id"), "term").groupBy("id").agg(F.max("term").alias("term"))
    if out.isEmpty():
        raise ValueError("no term is a single token of the vocabulary")
    return out


def mlm_score(logits: DataFrame, excluded: Column | None = None) -> DataFrame:
    """ctx, best_rank, soft_score: the rank of the best topic token (ties share it) and the topic's probability. Excluded tokens take no part. No context's vocabulary is sorted or gathered: the largest logits come first, from partial sums, then the sums over them."""
    rows = logits if excluded is None else logits.where(~excluded)
    by = [c for c in ("ctx", "half_year", "word") if c in rows.columns]
    tops = rows.groupBy("ctx").agg(F.max("logit").alias("mx"), F.max(F.when(F.col("topic"), F.col("logit"))).alias("best"))
    rows = rows.select(*by, "topic", "logit").join(tops, "ctx")
    e = F.exp(F.col("logit") - F.col("mx"))
    return rows.groupBy(*by).agg((1 + F.sum(F.when(F.col("logit") > F.col("best"), 1).otherwise(0))).cast("long").alias("best_rank"), (F.sum(F.when(F.col("topic"), e).otherwise(0.0)) / F.sum(e)).alias("soft_score"))


def top_k(logits: DataFrame, k: int = 50) -> DataFrame:
    """The k likeliest tokens of each context with rank and probability over the whole vocabulary; ties by token. Ranks are cut before the shuffle, so that k tokens of a context leave a task; the vocabulary only goes into partial sums."""
    best = logits.withColumn("rank", F.row_number().over(Window.partitionBy("ctx").orderBy(F.col("logit").desc(), "token"))).where(F.col("rank") <= k)
    tops = logits.groupBy("ctx").agg(F.max("logit").alias("mx"))
    total = logits.select("ctx", "logit").join(tops, "ctx").groupBy("ctx", "mx").agg(F.sum(F.exp(F.col("logit") - F.col("mx"))).alias("total"))
    return best.join(total, "ctx").withColumn("p", F.exp(F.col("logit") - F.col("mx")) / F.col("total")).select(*logits.columns, "p", "rank")


def informative(ranked: DataFrame, keyword: Column, threshold: int = 5, excluded: Column | None = None) -> DataFrame:
    """Predictions (half_year, ctx, token_word, p) of contexts that have two different keywords or more in their first `threshold` ranks, without keywords and excluded tokens."""
    found = ranked.withColumn("kw", keyword)
    first = F.collect_set(F.when(F.col("kw") & (F.col("rank") <= threshold), F.col("token"))).over(Window.partitionBy("ctx"))  # `threshold` tokens at most; a join would work the predictions out twice
    kept = found.where("ctx IS NOT NULL").withColumn("n", F.size(first)).where("n >= 2").drop("n").where(~F.col("kw"))
    return kept if excluded is None else kept.where(~excluded)


def candidate_scores(kept: DataFrame) -> DataFrame:
    """half_year, word, score: summed probability of predicted words, and how many contexts were informative."""
    return kept.groupBy("half_year", F.col("token_word").alias("word")).agg(F.sum("p").alias("score"), F.count_distinct("ctx").alias("n_informative"))


def ranked_candidates(scores: DataFrame, n: int | None = None) -> DataFrame:
    """Candidates by half-year, best first, ties by word; the first n of them."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("half_year").orderBy(F.col("score").desc(), "word")))
    return out if n is None else out.where(F.col("rank") <= n)


def taboo_hits(ranked: DataFrame, taboo: Column, k: int = 15) -> DataFrame:
    """ctx, hit: whether one of the first k predictions is a taboo word."""
    return ranked.where(F.col("rank") <= k).groupBy("ctx").agg(F.bool_or(taboo).alias("hit"))


def hit_cells(scores: DataFrame) -> DataFrame:
    """Scores (half_year, word, best_rank, soft_score) as cells: counts, the best rank, sums and hits within each of RANKS."""
    hits = [F.count_if(F.col("best_rank") <= k).alias(f"hits_{k}") for k in RANKS]
    return scores.groupBy("half_year", "word").agg(F.count("*").alias("n_scored"), F.min("best_rank").alias("min_rank"), F.sum(F.ln("best_rank")).alias("log_rank_sum"), F.sum("soft_score").alias("soft_sum"), *hits)


def hit_summary(cells: DataFrame, freq: DataFrame) -> DataFrame:
    """Cells with means and the frequency (0 where the count table has none)."""
    out = cells.join(freq.select("half_year", "word", F.col("c").alias("frequency")), ["half_year", "word"], "left")
    means = [(F.col("log_rank_sum") / F.col("n_scored")).alias("mean_log_rank"), (F.col("soft_sum") / F.col("n_scored")).alias("mean_soft")]
    return out.select("half_year", "word", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"), "n_scored", "min_rank", *means, *[f"hits_{k}" for k in RANKS])


def hit_rates(summary: DataFrame) -> DataFrame:
    """hits within each rank over the frequency, null where that is 0."""
    return summary.select("half_year", "word", *[F.try_divide(F.col(f"hits_{k}").cast("double"), F.nullif("frequency", F.lit(0)).cast("double")).alias(f"rate_{k}") for k in RANKS])


def hit_matrix(summary: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """A value over full axes in its three states: null where a word was not eligible, 0 where it was and nothing was scored, else the value."""
    out = mask.join(summary.select("half_year", "word", value), ["half_year", "word"], "left")
    return out.select("half_year", "word", F.when(F.col("eligible"), F.coalesce(value, F.lit(0))).alias(value))


def sanity_checks(summary: DataFrame) -> DataFrame:
    """Cells whose hits are not nested, or whose number scored is not the frequency, and the total gap."""
    nested = F.lit(True)
    for a, b in zip(RANKS, RANKS[1:]):
        nested &= F.col(f"hits_{a}") <= F.col(f"hits_{b}")
    gap = F.abs(F.col("n_scored") - F.col("frequency"))
    return summary.agg(F.count("*").alias("n_cells"), F.count_if(~(nested & (F.col(f"hits_{RANKS[-1]}") <= F.col("n_scored")))).alias("not_nested"), F.count_if(gap > 0).alias("n_mismatched"), F.sum(gap).alias("total_gap"))


def peak_rates(rates: DataFrame) -> DataFrame:
    """k, word, peak: the largest rate of each word within each rank."""
    long = rates.select("word", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"rate_{k}").alias("rate")) for k in RANKS])).alias("x"))
    return long.groupBy(F.col("x.k").alias("k"), "word").agg(F.max("x.rate").alias("peak"))


def choose_k_sweep(peaks: DataFrame, labels: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.05, 0.1, 0.3)) -> DataFrame:
    """k, threshold: words flagged, recall of positives, flag rate of negatives, pass-through of all. labels: word, positive (null: unlabelled)."""
    grid = F.broadcast(peaks.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double"))
    x = peaks.join(labels, "word", "left").crossJoin(grid).withColumn("flag", F.coalesce(F.col("peak") >= F.col("threshold"), F.lit(False)))
    share = lambda c: F.try_divide(F.count_if(F.col("flag") & c).cast("double"), F.count_if(c).cast("double"))
    return x.groupBy("k", "threshold").agg(F.count_if("flag").alias("n_flagged"), share(F.coalesce(F.col("positive"), F.lit(False))).alias("recall"), share(F.coalesce(~F.col("positive"), F.lit(False))).alias("negative_rate"), share(F.lit(True)).alias("pass_through"))


def choose_k_best(sweep: DataFrame, recall: float = 0.8) -> DataFrame:
    """Of the settings that reach the recall the one of smallest k, lowest pass-through, highest threshold; if none does, the one of best recall."""
    ok = F.coalesce(F.col("recall") >= recall, F.lit(False))
    zero = F.lit(0.0)
    return sweep.orderBy(ok.desc(), F.when(~ok, -F.coalesce("recall", zero)).otherwise(zero), "k", "pass_through", F.col("threshold").desc()).limit(1)


def logrank_signal(cells: DataFrame) -> DataFrame:
    """The mean log rank of a word in a half-year, sums over sums."""
    return cells.groupBy("half_year", "word").agg((F.sum("log_rank_sum") / F.sum("n_scored")).alias("value"), F.sum("n_scored").alias("n_scored"))
