"""A session with the settings that the engine is made for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "driftline", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; keywords with `__` for `.` add to them."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    return b.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df over the cluster's cores where it comes from fewer partitions (one small file, or one that cannot be split) and a costly expression follows; as it is elsewhere."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


#: Bytes up to which small() broadcasts.
SMALL_BYTES = 64 << 20


def is_small(df: DataFrame, most: int = SMALL_BYTES) -> bool:
    """Whether the rows of df, counted as JSON (an upper bound of what they take packed), are few bytes."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)) + 32 * F.count("*")).first()[0] <= most


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """df, to be broadcast if it is small by bytes; as it is beyond that."""
    return F.broadcast(df) if is_small(df, most) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine a new one where that is unset. On a cluster it has to be set, as executors do not see each other's disks."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it is computed once and its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
