"""Writers. Spark's own commit protocol makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(counts: DataFrame, totals: DataFrame, path: str, meta: DataFrame | None = None, widest: int = 2**31 - 1, stop: tuple[str, ...] = (), scope: DataFrame | None = None) -> None:
    """The count table by half-year, its axis labels and totals, a one-line description of the run, and the stop words and scope (column channel) that it was made with."""
    top = counts.agg(F.max("c")).first()[0] or 0
    if top > widest:
        raise OverflowError(f"a count of {top} does not fit")
    counts.write.mode("overwrite").partitionBy("half_year").parquet(f"{path}/freq")
    counts.select("half_year").distinct().orderBy("half_year").coalesce(1).write.mode("overwrite").csv(f"{path}/freq_half_years", header=True)
    counts.select("word").distinct().orderBy("word").write.mode("overwrite").csv(f"{path}/freq_words", header=True)
    totals.orderBy("half_year").coalesce(1).write.mode("overwrite").csv(f"{path}/freq_totals", header=True)
    if meta is not None:
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/freq_meta")
    if stop:
        counts.sparkSession.createDataFrame([(w,) for w in sorted(stop)], "word string").coalesce(1).write.mode("overwrite").text(f"{path}/freq_stop_words")
    if scope is not None:
        scope.select("channel").distinct().orderBy("channel").coalesce(1).write.mode("overwrite").text(f"{path}/freq_scope")


def csv(table: DataFrame, path: str) -> None:
    """A table as CSV with a header; arrays are joined by `;`."""
    flat = [F.concat_ws(";", c).alias(c) if t.startswith("array") else F.col(c) for c, t in table.dtypes]
    table.select(*flat).write.mode("overwrite").csv(path, header=True)


def top_words(ranked: DataFrame, path: str) -> None:
    """One JSON object for each half-year, with its words by rank."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    ranked.groupBy("half_year").agg(words.alias("words")).select(F.create_map("half_year", "words").alias("value")).select(F.to_json("value").alias("value")).write.mode("overwrite").text(path)


def centroid(per_term: DataFrame, whole: DataFrame, path: str, months: DataFrame | None = None, stats: DataFrame | None = None) -> None:
    """Centroids of all terms (word, centroid, n), with their counts by month where months (word, month, n) are given, and the global one, as JSON; stats (embedding_stats) beside it."""
    every = per_term.select("word", "centroid", "n")
    if months is not None:
        by = months.groupBy("word").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "n")))).alias("monthly_counts"))
        every = every.join(by, "word", "left")
    every = every.unionByName(whole.select(F.lit(None).cast("string").alias("word"), "centroid", "n"), allowMissingColumns=True)
    every.write.mode("overwrite").json(path)
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_stats")


def alert_lines(alerts: DataFrame, path: str, checkpoint: str | None = None):
    """Alerts as JSON lines: a stream's query that is to be started by the caller's trigger (with checkpoint, restartable), or of a table at once."""
    told = alerts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if not alerts.isStreaming:
        return told.write.mode("append").text(path)
    return told.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def dense(long: DataFrame, path: str) -> None:
    """A long table (half_year, word, value) as an .npy matrix with its labels, for small results; goes through the driver."""
    import numpy as np

    frame = long.toPandas().pivot(index="half_year", columns="word", values="value").sort_index().sort_index(axis=1)
    np.save(f"{path}.npy", frame.to_numpy())
    frame.index.to_series().to_csv(f"{path}_half_years.csv", index=False)
    frame.columns.to_series().to_csv(f"{path}_words.csv", index=False)
