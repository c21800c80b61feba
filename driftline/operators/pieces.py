"""Texts cut into pieces at ASCII characters that no word holds, and counted piece by piece: a word is then looked for in each different piece, not at each occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are held, and of one half-year that are cut at once, one text at least.
HELD, CUT_OF = 128 << 20, 16 << 20
#: ASCII letters in lower case, digits, _, ' and - and all bytes of other characters stay; what is left is white space.
_CUT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() or b in b"_'-" else 32 for b in range(256))
_SPACE, _LATIN = 0x20, 0xC3


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows that have a text in portions of about `most` bytes of text, one text at least; small batches are put together, large ones cut."""
    held, size = [], 0
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("text")))
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + (not held), int(np.searchsorted(ends, done + most - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - done) if to > at else 0
            if to < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def _lowered(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts, each with a space behind it, ASCII and Latin-1 letters in lower case, and a space for each ASCII character that no word holds."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), " ")
    data = np.frombuffer(bytearray(whole[0].as_buffer().to_pybytes().translate(_CUT) + b" "), np.uint8)
    second = np.flatnonzero(data == _LATIN) + 1  # of U+00C0 to U+00FF
    large = data[second]
    data[second[(large >= 0x80) & (large <= 0x9E) & (large != 0x97)]] += 0x20
    return data


def _plain(piece: pa.Array) -> np.ndarray:
    """Whether a piece is made of a-z and small Latin-1 letters only, so that it is a word in lower case."""
    at, raw = np.frombuffer(piece.buffers()[1], np.int32)[: len(piece) + 1], np.frombuffer(piece.buffers()[2], np.uint8)[: piece.buffers()[2].size]
    good = (raw >= 97) & (raw <= 122)
    first = np.flatnonzero(raw[:-1] == _LATIN)
    second = raw[first + 1]
    first = first[(second >= 0x9F) & (second <= 0xBF) & (second != 0xB7)]
    good[first] = good[first + 1] = True
    odd = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(~good, out=odd[1:])
    return odd[at[1:]] == odd[at[:-1]]


def pieces_of(texts: pa.Array, shortest: int = 1) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The different pieces of `shortest` bytes or more, whether they are a word each as they stand, and how often they occur. No character has more characters in lower case than it has bytes, so no word of `shortest` characters is lost."""
    data = _lowered(texts)
    ends = np.flatnonzero(data == _SPACE) + 1
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    cut = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])  # each piece ends with a space
    found = pc.value_counts(cut.filter(pa.array(np.diff(offsets) > max(shortest, 1))))
    piece = pc.binary_slice(found.field("values"), 0, -1)
    if not len(piece):
        return pa.array([], pa.string()), pa.array([], pa.bool_()), pa.array([], pa.int64())
    return piece.view(pa.string()), pa.array(_plain(piece)), found.field("counts")


def piece_counts(texts: DataFrame, shortest: int = 1) -> DataFrame:
    """half_year, piece, plain, n of texts (half_year, text): pieces of `shortest` bytes or more, in lower case where they are plain, and how often some texts of a task hold them; a piece may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, HELD):
            for label in part.column("half_year").unique():
                own = pc.equal(part.column("half_year"), label) if label.is_valid else pc.is_null(part.column("half_year"))
                for some in _portions(part.filter(own).to_batches(), CUT_OF):
                    piece, plain, n = pieces_of(some.column("text").combine_chunks(), shortest)
                    made = pa.record_batch([pa.repeat(label, len(n)), piece, plain, n], ["half_year", "piece", "plain", "n"])
                    for at in range(0, len(n), 1 << 16):
                        yield made.slice(at, 1 << 16)

    return texts.select("half_year", "text").mapInArrow(run, "half_year string, piece string, plain boolean, n long")
