"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import shared_dir

#: Upper-case ASCII to lower case, nothing else.
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java and RE2 form of "a word is anything but ASCII white space".
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_columns(docs: DataFrame, own: list[str], **more: Column) -> DataFrame:
    """The columns of own as c0, c1, ... with what else an operator reads: no name of the input can clash with one inside."""
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], *[v.alias(k) for k, v in more.items()])


def own_fields(docs: DataFrame, own: list[str]) -> list[T.StructField]:
    """The schema of the columns of own, under their own names."""
    return [T.StructField(c, docs.schema[c].dataType) for c in own]


def own_arrays(batch: pa.RecordBatch | pa.Table, n: int) -> list[pa.Array]:
    """The columns c0, c1, ... of a batch."""
    return [batch.column(batch.schema.get_field_index(f"c{i}")) for i in range(n)]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it is computed once and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, *cols: str) -> DataFrame:
    """Adds k1 and k2, a 128-bit key of the row's content; equal rows have equal keys and equal results."""
    return df.withColumns({"k1": F.xxhash64(*cols), "k2": F.xxhash64(F.lit(0x5BD1E995), *cols, F.lit(1))})


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the strings of a column hold about `most` bytes at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(binary_lengths(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string or binary column without copying; a null spans no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return off, data


def binary_lengths(column: pa.Array) -> np.ndarray:
    off, _ = offsets_of(column)
    return np.diff(off)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of consecutive rows with equal keys, from batches sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(c[a].item() if hasattr(c[a], "item") else c[a] for c in cols)
            if now is not None and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers by byte planes, compressed: small numbers take a few bits each."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays))


class Planes:
    """Reads what squeezed made, in turn."""

    def __init__(self, raw: bytes):
        self.raw, self.at = zstandard.ZstdDecompressor().decompress(raw), 0

    def take(self, kind, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        out = np.frombuffer(self.raw, np.uint8, size * n, self.at).reshape(size, n).T
        self.at += size * n
        return np.ascontiguousarray(out).view(kind).reshape(n)


def to_ipc(t: pa.Table) -> bytes:
    """A table as one compressed string."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def flat_column(t: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    c = t.column(name).combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        return c.chunk(0) if c.num_chunks else pa.array([], c.type)
    return c
