"""Change points on a stream of observations (word, half_year, cosine, n_occurrences, arrived).

Each word keeps its half-years in a state map; a repeated half-year replaces the old value and late ones take their
place by label, without watermark or expiry. Where an observation changes a word's valid series the series is analysed
again and an alert goes out when the word's flag appears (emerged), its detection changes (revised) or it goes
(cleared). Rows of a micro-batch are taken in the order of `arrived`. A malformed label stops the query.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.operators import series

ALERT = "word string, half_year string, event string, n_valid long, onset_half_year string, shift double, p_value double, changepoints string, level_before double, level_after double"
LABEL = re.compile(r"\d{4}H[12]")
OBSERVATION = "word string, half_year string, cosine double, n_occurrences long"
BATCHED = f"{OBSERVATION}, observations array<struct<word:string,cosine:double,n_occurrences:long>>"


@dataclass(frozen=True)
class Rules:
    """What makes a cell valid and a word testable, and the analysis."""

    min_occurrences: int = 30
    min_valid_periods: int = 6
    analysis: series.Config = field(default_factory=lambda: series.Config(floor=0.001))

    def __post_init__(self):
        if self.min_valid_periods < 2 * self.analysis.min_size:
            raise ValueError("min_valid_periods must be twice min_size or more")


def observations(lines: DataFrame, number: str = "line_no") -> DataFrame:
    """Observations of JSON lines (value): one word a line, or a half-year with a list of them. A malformed line is an error that tells the line, and its number where lines have a column of that name."""
    own = [c for c in lines.columns if c != "value"]
    j = lines.where(F.trim("value") != "").withColumn("j", F.from_json("value", f"{BATCHED}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = F.col("j").isNull() | F.col("j._broken").isNotNull() | (F.col("j.observations").isNull() & F.col("j.word").isNull())
    told = F.concat(F.lit("malformed line "), F.col(number).cast("string"), F.lit(": "), "value") if number in own else F.concat(F.lit("malformed line: "), "value")
    one = F.array(F.struct("j.word", "j.cosine", "j.n_occurrences"))
    each = F.when(broken, F.raise_error(told).cast("array<struct<word:string,cosine:double,n_occurrences:bigint>>")).otherwise(F.coalesce("j.observations", one))
    return j.withColumn("o", F.explode(each)).select("o.word", "j.half_year", "o.cosine", "o.n_occurrences", *own)


class Word:
    """One word's points and detection. flag: (changepoints, rounded shift) while it is flagged."""

    def __init__(self, name: str, points: dict[str, tuple[float | None, int]], flag: tuple[str, float] | None, scored: bool):
        self.name, self.points, self.flag, self.scored = name, points, flag, scored

    def valid(self, rules: Rules) -> list[tuple[str, float]]:
        return sorted((h, c) for h, (c, n) in self.points.items() if n >= rules.min_occurrences and c is not None and math.isfinite(c))

    def take(self, half_year: str, cosine: float | None, n: int, rules: Rules) -> dict | None:
        """The alert that an observation causes, if any."""
        if not LABEL.fullmatch(half_year):
            raise ValueError(f"no half-year: {half_year!r}")
        before = self.valid(rules)
        self.points[half_year] = (cosine, n)
        usable = self.valid(rules)
        if usable == before and self.scored:
            return None
        self.scored = True
        result = None
        if len(usable) >= rules.min_valid_periods:
            result = series.analysed(self.name, [h for h, _ in usable], np.array([c for _, c in usable]), rules.analysis, rules.analysis.floor or 0.0)
        flag = None
        if result and result["p_value"] < rules.analysis.alpha and result["shift"] > max(rules.analysis.min_shift, 0.0):
            flag = (result["changepoints"], round(result["shift"], 6))
        old, self.flag = self.flag, flag
        event = "emerged" if flag and old is None else "revised" if flag and flag != old else "cleared" if old is not None and flag is None else None
        if event is None:
            return None
        shown = result or {"n_valid": 0, "onset_half_year": "", "shift": 0.0, "p_value": None, "changepoints": "", "level_before": None, "level_after": None}
        return {"word": self.name, "half_year": half_year, "event": event} | {k: shown[k] for k in ("n_valid", "onset_half_year", "shift", "p_value", "changepoints", "level_before", "level_after")}


class Changes(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "half_year string", "cosine double, n long")
        self.flag = handle.getValueState("flag", "changepoints string, shift double, flagged boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: (v[0], v[1]) for k, v in self.points.iterator()}
        last = self.flag.get() if self.flag.exists() else None
        word = Word(key[0], held, (last[0], last[1]) if last is not None and last[2] else None, last is not None)
        # What a micro-batch has of a word has to be put in order; its columns are held, not its frames.
        held_rows = [x for f in rows for x in zip(f["arrived"], f["half_year"], f["cosine"], f["n_occurrences"])]
        alerts = []
        for _, h, c, n in sorted(held_rows, key=lambda x: x[:2]):
            c = None if c is None or pd.isna(c) else float(c)
            if (alert := word.take(str(h).strip(), c, int(n), self.rules)) is not None:
                alerts.append(alert)
            self.points.updateValue((str(h).strip(),), (c, int(n)))
        self.flag.update((word.flag[0], word.flag[1], True) if word.flag else ("", 0.0, False))
        if alerts:
            yield pd.DataFrame(alerts, columns=[c.split()[0] for c in ALERT.split(", ")])

    def close(self) -> None:
        pass


def alerts(stream: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A stream of alerts (ALERT) from a stream of observations with a number `arrived`. Needs the RocksDB state store (session.SETTINGS)."""
    return stream.groupBy("word").transformWithStateInPandas(statefulProcessor=Changes(rules), outputStructType=ALERT, outputMode="Append", timeMode="None")


def state_points(spark: SparkSession, checkpoint: str) -> DataFrame:
    """word, half_year, cosine, n_occurrences as the stream's state holds them."""
    s = spark.read.format("statestore").option("stateVarName", "points").load(checkpoint)
    return s.select("key.word", F.col("user_map_key.half_year").alias("half_year"), "user_map_value.cosine", F.col("user_map_value.n").alias("n_occurrences"))


def latest(observed: DataFrame) -> DataFrame:
    """The last observation of each word and half-year."""
    return observed.groupBy("word", "half_year").agg(F.max(F.struct("arrived", "cosine", "n_occurrences")).alias("x")).select("word", "half_year", "x.cosine", "x.n_occurrences")


def snapshot(points: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All words that can be tested, with q-values across them, ranks, and the live rule's flag. points: the current ones (latest, or state_points)."""
    ok = (F.col("n_occurrences") >= rules.min_occurrences) & F.col("cosine").isNotNull() & ~F.isnan("cosine")
    n = F.count_if(ok).over(Window.partitionBy("word"))
    signal = points.withColumn("n_ok", n).where(ok & (F.col("n_ok") >= rules.min_valid_periods)).select("half_year", "word", F.col("cosine").alias("value"))
    sums = points.groupBy("word").agg(F.sum("n_occurrences").alias("total_occurrences"), F.min(F.when(ok, F.col("half_year"))).alias("first_valid_half_year"), F.max(F.when(ok, F.col("half_year"))).alias("last_valid_half_year"))
    out = series.ranked(series.change_points(signal, rules.analysis), rules.analysis, sums)
    return out.withColumn("live_alert", (F.col("p_value") < rules.analysis.alpha) & (F.col("shift") > max(rules.analysis.min_shift, 0.0)))
