"""The corpus pipeline: five stages, each on what the one before it kept.

All stages take texts of any length whole, null and empty ones too: quality rules reject those, and on a table that
still has them near-dedup keeps one of them, decontamination and secret scans let them pass, and the mix takes none. Null
ids and sources stand for themselves (a null source is one of its own; of near copies one with an id stays before one
without). Rows that are equal in all columns are near copies of each other, as are ties in an id of equal texts; other
rows are told apart by their columns, whatever these are called (`__k1` and `__k2` are used inside), and keep their values. An empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import decontam, mixing, quality, secrets, simhash
from driftline.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (exact sets of five-word shingles of similarity 0.8 or more; SimHash brings up the candidates) the document of the least id stays."""
    return simhash.one_of_each(docs, shingle=5, similar=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return secrets.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of times and words; a longer one is likelier to be taken once more. Those of which it takes no word go."""
    return mixing.mixed(docs, size_power=0.5).where("taken > 0")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scans", secret_scans), ("mixing", mix)]

#: Line rules, fingerprints and the forest have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
