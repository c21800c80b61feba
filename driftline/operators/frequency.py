"""Word frequency by half-year: counting, filters before and after, eligibility, floors and their recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.functions.stopwords import STOP_WORDS
from driftline.operators.pieces import piece_counts

#: Word pieces below which a floor is given as a count, and as a rate in a million.
ABSOLUTE_FLOORS, RATE_FLOORS = (1, 2, 5, 10, 30, 50), (0.5, 1.0, 5.0, 10.0)


def tokens(texts: DataFrame) -> DataFrame:
    """One row for each word: the columns of texts (but text), pos and token."""
    own = [c for c in texts.columns if c != "text"]
    return texts.select(*own, F.posexplode(tx.words(F.col("text"))).alias("pos", "token"))


def counts(texts: DataFrame, shortest: int = 1) -> DataFrame:
    """half_year, word, c of all words of `shortest` characters or more, before any other filter. Words are cut out of different pieces of text, not out of each occurrence; a word's half-years are in one partition."""
    own = F.when(F.col("plain"), F.array("piece")).otherwise(F.regexp_extract_all("piece", F.lit(tx.WORD), F.lit(0)))
    cut = piece_counts(texts, shortest).select("half_year", "plain", F.explode(own).alias("word"), "n")
    cut = cut.select("half_year", F.when(F.col("plain"), F.col("word")).otherwise(F.lower("word")).alias("word"), "n")
    return (cut if shortest <= 1 else cut.where(F.length("word") >= shortest)).repartition("word").groupBy("half_year", "word").agg(F.sum("n").alias("c"))


def prefiltered(freq: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Counts of the words that the filter before counting keeps. A word is looked at once for each half-year, not for each occurrence."""
    return freq.where(tx.term_reason(F.col("word"), stop).isNull())


def prefilter_counts(freq: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """How many different words each reason takes out, and how many stay (reason kept)."""
    return freq.select("word").distinct().groupBy(F.coalesce(tx.term_reason(F.col("word"), stop), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_terms"))


def removed_samples(freq: DataFrame, k: int = 5, seed: int = 0, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """k words of each reason, by the order of a seeded hash."""
    gone = freq.select("word").distinct().withColumn("reason", tx.term_reason(F.col("word"), stop)).where("reason IS NOT NULL")
    order = Window.partitionBy("reason").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "word").cast("binary")), "word")
    return gone.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def totals(raw_counts: DataFrame, kept: DataFrame) -> DataFrame:
    """All tokens of each half-year, and those that the filters keep."""
    t = raw_counts.groupBy("half_year").agg(F.sum("c").alias("total_tokens"))
    k = kept.groupBy("half_year").agg(F.sum("c").alias("total_tokens_filtered"))
    return t.join(k, "half_year", "left").select("half_year", "total_tokens", F.coalesce("total_tokens_filtered", F.lit(0)).alias("total_tokens_filtered"))


def postfilter(freq: DataFrame, floor: int = 30, mode: str = "per-half-year") -> DataFrame:
    """none: all cells. global: words that reach the floor in some half-year, with all their cells. per-half-year: cells that reach it."""
    if mode == "none":
        return freq
    if mode == "global":
        return freq.withColumn("top", F.max("c").over(Window.partitionBy("word"))).where(F.col("top") >= floor).drop("top")
    if mode == "per-half-year":
        return freq.where(F.col("c") >= floor)
    raise ValueError(f"no such mode: {mode}")


def postfilter_stats(freq: DataFrame, floor: int = 30) -> DataFrame:
    """Words and cells that the filter by half-year keeps and takes; cells_nulled counts the zeros of kept words too."""
    by = freq.groupBy("word").agg(F.count_if(F.col("c") >= floor).alias("n"))
    axis = freq.agg(F.count_distinct("half_year").alias("n_half_years"))
    s = by.agg(F.count_if(F.col("n") > 0).alias("words_kept"), F.count_if(F.col("n") == 0).alias("words_dropped"), F.sum("n").alias("cells_kept"))
    return s.crossJoin(axis).select("words_kept", "words_dropped", "cells_kept", (F.col("words_kept") * F.col("n_half_years") - F.col("cells_kept")).alias("cells_nulled"))


def complete_periods(totals_: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Half-years with whether their total reaches the share of the larger neighbour's."""
    w = Window.orderBy("half_year")  # one row a half-year
    near = F.greatest(F.lag("total").over(w), F.lead("total").over(w))
    return totals_.withColumn("near", near).select("half_year", "total", (F.col("near").isNull() | (F.col("total") >= threshold * F.col("near"))).alias("complete"))


def eligible_words(freq: DataFrame, floor: int = 30, periods: int = 2) -> DataFrame:
    """Words that reach the floor in so many half-years."""
    return freq.groupBy("word").agg(F.count_if(F.col("c") >= floor).alias("n_periods")).where(F.col("n_periods") >= periods)


def eligible_from(freq: DataFrame, floor: int) -> DataFrame:
    """The first half-year in which a word reaches the floor; with a floor of 1 or less every word is eligible from the first half-year of all."""
    if floor <= 1:
        return freq.select("word").distinct().crossJoin(freq.agg(F.min("half_year").alias("eligible_from")))
    return freq.where(F.col("c") >= floor).groupBy("word").agg(F.min("half_year").alias("eligible_from"))


def since_eligible(freq: DataFrame, floor: int) -> DataFrame:
    """freq with eligible_from, without the words that never reach the floor: a join with eligible_from(), but a word's half-years meet in one partition and no list of words is made."""
    if floor <= 1:
        return freq.join(eligible_from(freq, floor), "word")
    own, reached = Window.partitionBy("word"), F.col("c") >= floor
    kept = freq.withColumn("top", F.max("c").over(own)).withColumn("eligible_from", F.min(F.when(reached, F.col("half_year"))).over(own))
    return kept.where(F.col("top") >= floor).drop("top")


def axes(freq: DataFrame) -> DataFrame:
    """Every half-year with every word. Half-years are few and go to each task; words are not gathered."""
    return freq.select("word").distinct().crossJoin(F.broadcast(freq.select("half_year").distinct()))


def aligned(freq: DataFrame, value: str = "c", default: float | int | None = 0) -> DataFrame:
    """The table over full axes, with a default for absent cells."""
    out = axes(freq).join(freq.select("half_year", "word", value), ["half_year", "word"], "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def eligibility_mask(freq: DataFrame, floor: int) -> DataFrame:
    """half_year, word, eligible: whether the floor was reached in this half-year or an earlier one. What comes later plays no part."""
    so_far = Window.partitionBy("word").orderBy("half_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return aligned(freq).select("half_year", "word", (F.max(F.when(F.col("c") >= floor, 1).otherwise(0)).over(so_far) == 1).alias("eligible"))


def quantiles(freq: DataFrame, at: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Quantiles of the counts of each half-year (q50 ...), its number of words and its largest count."""
    q = [F.percentile("c", F.lit(float(p))).alias(f"q{round(100 * p)}") for p in at]
    return freq.groupBy("half_year").agg(F.count("*").alias("n_words_present"), F.max("c").alias("max_count"), *q)


def survivors(freq: DataFrame, floors: tuple[float, ...], by_rate: bool = False) -> DataFrame:
    """For each half-year and floor the words that reach it. A floor is a count (with the rate in a million that it means) or a rate (with the count that it means, rounded up)."""
    spark = freq.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(f),) for f in floors], "floor double"))
    total = freq.groupBy("half_year").agg(F.sum("c").alias("total"))
    need = F.ceil(F.col("floor") * F.col("total") / 1e6) if by_rate else F.col("floor")
    limits = total.crossJoin(grid).withColumn("need", need.cast("double"))
    met = freq.join(F.broadcast(limits), "half_year").groupBy("half_year", "floor", "need", "total").agg(F.count_if(F.col("c") >= F.col("need")).alias("n_words"))
    implied = F.col("need") if by_rate else F.col("floor") / F.col("total") * 1e6
    return met.select("half_year", "floor", "n_words", implied.alias("implied"))


def pivot_floor(survivors_: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Survivors with a column for each floor."""
    out = survivors_.groupBy("half_year").pivot("floor", [float(f) for f in floors]).agg(F.first("n_words"))
    return out.select("half_year", *[F.col(f"`{float(f)}`").alias(f"floor_{f:g}") for f in floors])


def list_breakdown(raw_counts: DataFrame, kept: DataFrame, terms: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """For each term of a list: present (after the filter), its reason if it is filtered, or coverage_gap; with its largest count."""
    seen = kept.groupBy(F.col("word").alias("term")).agg(F.max("c").alias("top"))
    state = F.when(F.col("top").isNotNull(), "present").otherwise(F.coalesce(tx.term_reason(F.col("term"), stop), F.lit("coverage_gap")))
    return terms.join(seen, "term", "left").select("term", state.alias("state"), "top")


def floor_recall(breakdown: DataFrame, floors: tuple[float, ...] = ABSOLUTE_FLOORS) -> DataFrame:
    """For each floor, how many terms of a list are left, and the share of those present that is lost."""
    grid = F.broadcast(breakdown.sparkSession.createDataFrame([(float(f),) for f in floors], "floor double"))
    n = breakdown.crossJoin(grid).groupBy("floor").agg(F.count("*").alias("n_terms"), F.count("top").alias("n_present"), F.count_if(F.col("top") >= F.col("floor")).alias("n_left"))
    return n.withColumn("lost", F.try_divide((F.col("n_present") - F.col("n_left")).cast("double"), F.col("n_present").cast("double")))


def variants(term: Column) -> Column:
    """Spellings near a term: with s, with es, without them, with a straight apostrophe, without hyphen or apostrophe; the term itself is none."""
    n, straight = F.length(term), F.replace(term, F.lit("’"), F.lit("'"))
    tried = F.array(
        F.concat(term, F.lit("s")), F.concat(term, F.lit("es")),
        F.when(term.endswith("s") & (n > 4), F.substring(term, F.lit(1), n - 1)), F.when(term.endswith("es") & (n > 5), F.substring(term, F.lit(1), n - 2)),
        straight, F.replace(straight, F.lit("-"), F.lit("")), F.replace(straight, F.lit("'"), F.lit("")),
    )
    return F.filter(F.array_distinct(tried), lambda v: v.isNotNull() & (v != term))


def variant_rescue(freq: DataFrame, terms: DataFrame, floors: tuple[float, ...] = ABSOLUTE_FLOORS) -> DataFrame:
    """floor, term, variants, rescued: terms that are words, but reach the floor in no half-year, with their variants that are words (joined by `;`), and whether term and variants together reach it in some half-year."""
    own = terms.join(freq.select(F.col("word").alias("term")).distinct(), "term", "left_semi").distinct()
    tried = own.select("term", F.explode(variants(F.col("term"))).alias("word"))
    near = tried.join(freq.select("word").distinct(), "word", "left_semi").groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("word")), ";").alias("variants"))  # seven a term at most
    cells = tried.withColumn("own", F.lit(0)).unionByName(own.select("term", F.col("term").alias("word"), F.lit(1).alias("own"))).join(freq, "word")
    by = cells.groupBy("term", "half_year").agg(F.sum("c").alias("together"), F.sum(F.col("c") * F.col("own")).alias("alone"))
    top = by.groupBy("term").agg(F.max("alone").alias("alone"), F.max("together").alias("together"))
    grid = F.broadcast(freq.sparkSession.createDataFrame([(float(f),) for f in floors], "floor double"))
    lost = top.crossJoin(grid).where(F.col("alone") < F.col("floor")).join(near, "term", "left")
    return lost.select("floor", "term", F.coalesce("variants", F.lit("")).alias("variants"), (F.col("together") >= F.col("floor")).alias("rescued"))


def positive_vocabulary(freq: DataFrame, half_year: str) -> DataFrame:
    """The words that occur in a half-year."""
    return freq.where((F.col("half_year") == half_year) & (F.col("c") > 0)).select("word").distinct()


def first_words(freq: DataFrame, n: int) -> DataFrame:
    """Cells of the first n words by name; each task keeps n words at most before they meet."""
    own = freq.select("word").distinct().orderBy("word").limit(n)
    return freq.join(F.broadcast(own), "word", "left_semi")  # n is a parameter


def unpivoted(wide: DataFrame, by: str = "half_year", name: str = "word", value: str = "value") -> DataFrame:
    """A wide table (a row for each label, a column for each name) as a long one."""
    return wide.unpivot(by, [c for c in wide.columns if c != by], name, value)


def log_rate(freq: DataFrame) -> DataFrame:
    """ln((c + 0.5) / total * 1e6) over the cells of a table."""
    total = freq.groupBy("half_year").agg(F.sum("c").alias("total"))
    return freq.join(F.broadcast(total), "half_year").select("half_year", "word", "c", F.ln((F.col("c") + 0.5) / F.col("total") * 1e6).alias("value"))


def nulled(signal: DataFrame, value: str, support: str, least: int) -> DataFrame:
    """The signal with null where its support is too small."""
    return signal.withColumn(value, F.when(F.col(support) >= least, F.col(value)))


def without_half_years(freq: DataFrame, labels: list[str]) -> DataFrame:
    """freq without some half-years; a label that it doesn't have is an error."""
    have = {r.half_year for r in freq.select("half_year").distinct().collect()}  # a few dozen labels
    if missing := sorted(set(labels) - have):
        raise ValueError(f"no such half-years: {missing}")
    return freq.where(~F.col("half_year").isin(*labels)) if labels else freq


def missing_half_years(freq: DataFrame) -> DataFrame:
    """Half-years between the first and the last that have no row."""
    have = freq.select("half_year").distinct()
    span = have.agg(F.min(tx.ordinal(F.col("half_year"))).alias("a"), F.max(tx.ordinal(F.col("half_year"))).alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias("n")).select(tx.label(F.col("n")).alias("half_year")).join(have, "half_year", "left_anti")


def month_coverage(months: DataFrame) -> DataFrame:
    """half_year, n_present, missing: which of a half-year's six months (YYYY-MM) are not there."""
    own = F.concat(F.substring("month", 1, 4), F.when(F.substring("month", 6, 2).cast("int") <= 6, "H1").otherwise("H2"))
    first = F.when(F.substring("half_year", 6, 1) == "1", 1).otherwise(7)
    due = F.transform(F.sequence(first, first + 5), lambda m: F.concat(F.substring("half_year", 1, 4), F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
    by = months.select("month").distinct().groupBy(own.alias("half_year")).agg(F.collect_set("month").alias("have"))
    return by.select("half_year", F.size("have").cast("long").alias("n_present"), F.array_join(F.array_except(due, F.col("have")), ";").alias("missing"))


def scope_hash(scope: DataFrame) -> DataFrame:
    """The SHA-256 of a scope's sorted names, one a line, and their number; a scope is a list of names of moderate length."""
    names = scope.select("channel").distinct()
    return names.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("channel")), "\n"), 256).alias("hash"), F.count("*").alias("n_listed"))
