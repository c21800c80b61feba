"""Hit rates over time: roll-ups, linear trends and how far two methods agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.session import small


def monthly(instances: DataFrame, alias: Column | None = None) -> DataFrame:
    """word, month, hits, total. alias: another name for a word, null to keep its own."""
    word = F.lower("word") if alias is None else F.coalesce(alias, F.lower("word"))
    return instances.groupBy(word.alias("word"), "month").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))


def half_yearly(months: DataFrame) -> DataFrame:
    """word, period (2014-H1), hits, total of monthly counts."""
    return months.groupBy("word", tx.half_year_of_month(F.col("month")).alias("period")).agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))


def trends(periods: DataFrame, least: int = 5, n_periods: int = 3) -> DataFrame:
    """By word over periods with enough instances: slope of the rate by place in order, last less first rate, mean and deviation."""
    w = Window.partitionBy("word").orderBy("period")
    rows = periods.where((F.col("total") >= least) & (F.col("period") != "unknown")).withColumn("rate", F.col("hits") / F.col("total")).withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    out = rows.groupBy("word").agg(F.count("*").alias("n_periods"), F.sum("total").alias("total_instances"), F.avg("rate").alias("mean_rate"), F.stddev_pop("rate").alias("std_rate"), F.regr_slope("rate", "x").alias("slope"), (F.max_by("rate", "x") - F.min_by("rate", "x")).alias("drift"))
    return out.where(F.col("n_periods") >= n_periods)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words in both (columns word, slope), the correlation of their slopes and the share of equal directions."""
    both = a.select("word", F.col("slope").alias("a")).join(b.select("word", F.col("slope").alias("b")), "word")
    return both.agg(F.count("*").alias("n_words"), F.corr("a", "b").alias("correlation"), F.avg(((F.col("a") > 0) == (F.col("b") > 0)).cast("double")).alias("same_direction"))


def group_rates(periods: DataFrame, groups: DataFrame) -> DataFrame:
    """group, period: mean and population deviation of the words' rates."""
    return periods.join(small(groups), "word").groupBy("group", "period").agg(F.avg(F.col("hits") / F.col("total")).alias("mean_rate"), F.stddev_pop(F.col("hits") / F.col("total")).alias("std_rate"), F.count("*").alias("n_words"))
