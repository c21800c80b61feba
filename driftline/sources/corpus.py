"""Readers: raw records, word lists, matrices and partial results."""

from __future__ import annotations

import json
import warnings
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.functions.text import Fields
from driftline.operators.checks import complete_rows
from driftline.session import small


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path names a folder of its store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def lines(spark: SparkSession, *paths: str, tolerant: bool = False) -> DataFrame:
    """Lines (value, file) of text, JSON-lines and .zst files; each path once. A folder is searched for *.zst and *.jsonl, through all its folders.

    tolerant: a file that breaks off keeps the lines read so far (file_status tells which).
    """
    own = list(dict.fromkeys(paths))
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(tolerant).lower())
    parts = [reader.option("pathGlobFilter", "*.{zst,jsonl}" if is_folder(spark, p) else "*").text(p) for p in own]
    named = [p.select("value", F.col("_metadata.file_path").alias("file")) for p in parts]
    out = named[0]
    for p in named[1:]:
        out = out.unionByName(p)
    return out


def monthly_lines(spark: SparkSession, folder: str, tolerant: bool = False) -> DataFrame:
    """Lines (value, file) of the monthly dumps (RC_*.zst, RS_*.zst) that lie in a folder itself."""
    return spark.read.option("pathGlobFilter", "R[CS]_*.zst").option("ignoreCorruptFiles", str(tolerant).lower()).text(folder).select("value", F.col("_metadata.file_path").alias("file"))


def shards(spark: SparkSession, folder: str, pattern: str = "*.part.json") -> DataFrame:
    """The paths of a folder's partial results, in order; that there is none is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path") if is_folder(spark, folder) else None
    if found is None or found.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found.orderBy("path")


def pick_months(files: DataFrame, months: list[str] | None = None, first: int | None = None, at: int | None = None) -> DataFrame:
    """files (file, month) of chosen months: those of a list (one that is not there is warned of), or the first so many; at: of these the one at a place (none past the end). Files without a month stand for themselves."""
    named = files.withColumn("month", F.when(F.coalesce("month", F.lit("")) == "", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)).otherwise(F.col("month")))
    have = sorted(r.month for r in named.select("month").distinct().collect())  # a row for each month
    if months:
        if missing := [m for m in months if m not in have]:
            warnings.warn(f"no input for {', '.join(missing)}", stacklevel=2)
        have = [m for m in months if m in have]
    elif first is not None:
        have = have[:first]
    if at is not None:
        have = have[at : at + 1]
    return named.where(F.col("month").isin(have))


def months_of(files: DataFrame) -> DataFrame:
    """(file, month): monthly dumps are named R?_YYYY-MM with an optional part."""
    return files.select("file").distinct().withColumn("month", F.regexp_extract("file", r"R[CS]_(\d{4}-\d{2})[^/]*$", 1))


def _ends(source, zst: bool) -> tuple[bool, int]:
    """Whether a file can be read to its end, and its lines up to there; in pieces of 1 MB."""
    n = 0
    try:
        data = pa.CompressedInputStream(source, "zstd") if zst else source
        while chunk := data.read(1 << 20):
            n += chunk.count(b"\n")
    except (OSError, pa.ArrowException):
        return False, n
    return True, n


def file_status(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, ok, n_lines): every file read by itself to its end, in a task of its own; a broken one is flagged. Files of a mounted file system are streamed by their path, whatever their size; those of another store come as one value (below 2 GB each)."""

    def streamed(batches):
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                with pa.OSFile(unquote(urlsplit(path).path)) as f:
                    found.append((path, *_ends(f, path.endswith(".zst"))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["file", "ok", "n_lines"])

    def whole(batches):
        for b in batches:
            found = [(path, *_ends(pa.BufferReader(raw), path.endswith(".zst"))) for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["file", "ok", "n_lines"])

    kind = "file string, ok boolean, n_lines long"
    mounted = F.col("path").startswith("file:")
    files = spark.read.format("binaryFile").load(list(paths))
    n = max(1, spark.sparkContext.defaultParallelism)
    return files.where(mounted).select("path").repartition(n, "path").mapInArrow(streamed, kind).unionByName(files.where(~mounted).select("path", "content").mapInArrow(whole, kind))


def month_status(status: DataFrame) -> DataFrame:
    """(month, month_ok, n_files, n_failed): a month is good if each of its files is."""
    return status.groupBy("month").agg(F.bool_and("ok").alias("month_ok"), F.count("*").alias("n_files"), F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("n_failed"))


def drop_reason(value: Column, allowed: Column, years: tuple[int, int] = (2012, 2026), fields: Fields = Fields()) -> Column:
    """Why a raw line is dropped, the first reason that holds; null where it stays. allowed: whether its channel is in scope."""
    get = lambda f: F.get_json_object(value, f"$.{f}")
    body = body_of(value, fields)
    day = tx.epoch_day(get(fields.time))
    return (
        F.when(F.try_parse_json(value).isNull(), "parse_error")
        .when(~F.coalesce(allowed, F.lit(False)), "channel")
        .when(body.isNull() | F.trim(body).isin("", *tx.GONE), "empty")
        .when(day.isNull(), "bad_timestamp")
        .when(~F.year(day).between(*years), "year")
        .when(tx.clean(body) == "", "empty_after_clean")
    )


def body_of(value: Column, fields: Fields = Fields()) -> Column:
    """The body, or where it is empty the other text field."""
    get = lambda f: F.nullif(F.get_json_object(value, f"$.{f}"), F.lit(""))
    return F.coalesce(get(fields.body), get(fields.other))


def judged(raw: DataFrame, scope: DataFrame | None = None, years: tuple[int, int] = (2012, 2026), fields: Fields = Fields()) -> DataFrame:
    """raw lines (value, and what else there is) without blank ones, with half_year, text and drop_reason. scope: a column channel of normalised names (a word list, broadcast where it is small by bytes)."""
    name = tx.channel(F.get_json_object("value", f"$.{fields.channel}"))
    raw = raw.where(F.trim("value") != "").withColumn("__channel", name)
    if scope is None:
        raw = raw.withColumn("__in", F.lit(True))
    else:
        raw = raw.join(small(scope.select(F.col("channel").alias("__channel"), F.lit(True).alias("__in")).distinct()), "__channel", "left")
    value = F.col("value")
    day = tx.epoch_day(F.get_json_object(value, f"$.{fields.time}"))
    out = raw.withColumns({"drop_reason": drop_reason(value, F.col("__in"), years, fields), "half_year": tx.half_year(day), "text": tx.clean(body_of(value, fields))})
    return out.drop("__channel", "__in", "value")


def records(raw: DataFrame, scope: DataFrame | None = None, years: tuple[int, int] = (2012, 2026), fields: Fields = Fields()) -> DataFrame:
    """The clean stream: half_year and text of lines that stay."""
    return judged(raw, scope, years, fields).where("drop_reason IS NULL").drop("drop_reason")


def scope_list(lines_: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct channels of a list (value): blank lines and # lines are skipped; strict: so are dashes and names with spaces."""
    out = lines_.where("trim(value) <> '' AND trim(value) NOT LIKE '#%'")
    if strict:
        out = out.where(r"trim(value) NOT IN ('-', '—') AND NOT trim(value) RLIKE '\\s'")
    return out.select(tx.channel(F.col("value")).alias("channel")).where("channel <> ''").distinct()


def terms(lines_: DataFrame) -> DataFrame:
    """Distinct lower-case terms of a list (value)."""
    return lines_.select(F.lower(F.trim("value")).alias("term")).where("term <> ''").distinct()


def answer_keywords(lines_: DataFrame) -> DataFrame:
    """Distinct keywords of lines `keyword: other; other`; blank lines, # lines and lines without a colon are skipped."""
    return lines_.where("trim(value) NOT LIKE '#%' AND contains(value, ':')").select(F.lower(F.trim(F.split("value", ":")[0])).alias("keyword")).where("keyword <> ''").distinct()


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A named column of a CSV file, or the first one where no header has the name; a byte-order mark is ignored."""
    named = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    own = next((c for c in named.columns if c.lstrip("﻿") == column), None)
    if own is not None:
        return named.select(F.col(f"`{own}`").alias(column))
    first = spark.read.csv(path)
    return first.select(F.regexp_replace(F.col(first.columns[0]), "^﻿", "").alias(column))


def matrix(spark: SparkSession, values, rows: list[str], columns: list[str]) -> DataFrame:
    """A dense array with labels as a long table (half_year, word, value); NaN becomes null. Checks shape and labels. Rows go to Spark as whole vectors and are laid out there."""
    import numpy as np

    values = np.asarray(values)
    if values.shape != (len(rows), len(columns)):
        raise ValueError(f"the matrix is {values.shape}, the labels say {(len(rows), len(columns))}")
    if len(set(rows)) < len(rows) or len(set(columns)) < len(columns):
        raise ValueError("labels repeat")
    kind = "double" if values.dtype.kind == "f" else "long"
    width = values.shape[1] if values.ndim == 2 else 0
    flat = pa.array(values.astype("f8" if kind == "double" else "i8").ravel())
    laid = spark.createDataFrame(pa.table({"half_year": pa.array(rows, pa.string()), "v": pa.FixedSizeListArray.from_arrays(flat, width).cast(pa.list_(flat.type)) if width else pa.array([[]] * len(rows), pa.list_(flat.type))}))
    words = spark.createDataFrame(pa.table({"pos": pa.array(range(width), pa.int32()), "word": pa.array(columns, pa.string())}))
    out = laid.select("half_year", F.posexplode("v").alias("pos", "value")).join(words, "pos").select("half_year", "word", "value")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value"))) if kind == "double" else out


def npy_matrix(spark: SparkSession, path: str, rows: str, columns: str) -> DataFrame:
    """A stored .npy matrix with its label files (CSV columns half_year and word) as a long table; shape and labels are checked. The file is opened by Spark, in whatever store it lies, and below 2 GB."""
    import io

    import numpy as np

    raw = spark.read.format("binaryFile").load(path).select("content").first().content
    labels = [[r[0] for r in csv_column(spark, p, c).collect()] for p, c in ((rows, "half_year"), (columns, "word"))]
    return matrix(spark, np.load(io.BytesIO(raw), allow_pickle=False), *labels)


def npz_rows(spark: SparkSession, folder: str, half_years: list[str], words: list[str], pattern: str = "*.npz") -> DataFrame:
    """Row files (.npz with half_year, scores, occurrence_counts), one for each half-year, as a long table (half_year, word, cosine, n_occurrences). A missing half-year, one that is not expected and a wrong number of scores are errors."""

    def run(batches):
        import io

        import numpy as np

        for b in batches:
            for raw in b.column(0).to_pylist():
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    label, scores, counts = str(z["half_year"].item()), z["scores"], z["occurrence_counts"]
                if scores.shape != (len(words),) or counts.shape != (len(words),):
                    raise ValueError(f"{label} has {scores.shape} scores and {counts.shape} counts for {len(words)} words")
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(words)), pa.array(words), pa.array(scores.astype(float), from_pandas=True), pa.array(counts.astype(np.int64))], ["half_year", "word", "cosine", "n_occurrences"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("content")
    return complete_rows(files.mapInArrow(run, "half_year string, word string, cosine double, n_occurrences long"), half_years, len(words))


def task_coverage(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Tasks (task) that are missing, unexpected or there more than once."""
    n = found.groupBy("task").agg(F.count("*").alias("n"))
    both = n.join(expected.select("task", F.lit(True).alias("due")).distinct(), "task", "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return both.select("task", F.coalesce("n", F.lit(0)).alias("n_found"), state.alias("state"))


def finals_and_orphans(finals: DataFrame, checkpoints: DataFrame, on: str = "task") -> DataFrame:
    """Final results, and checkpoints of tasks that have none."""
    return finals.unionByName(checkpoints.join(finals.select(on).distinct(), on, "left_anti"))


def pilot_words(config: str) -> list[tuple[str, str]]:
    """(group, word) of a JSON text with groups, or of a pilot's: pilot_words, or else its three lists; entries are words or objects with one."""
    held = json.loads(config)
    word = lambda x: x["word"] if isinstance(x, dict) else x
    if "groups" in held:
        return [(g, word(w)) for g, ws in held["groups"].items() for w in ws]
    if held.get("pilot_words"):
        return [("pilot_words", word(w)) for w in held["pilot_words"]]
    return [(g, word(w)) for g in ("pilot_positives", "pilot_negatives", "hard_negatives") for w in held.get(g, [])]


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Extracted instances as JSON lines."""
    return spark.read.schema("word string, sentence string, timestamp string, category string").json(path)
