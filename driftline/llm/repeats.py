"""Removal of long byte strings that occur more than once in the corpus (suffix-array dedup).

Every byte is removed that is covered by a string of `length` bytes which starts anywhere else too, in another document
or the same one. Repeated passages are told besides: runs of bytes that repeated strings of `deal` bytes (240, shorter
than most passages of 50 words) cover and that hold over 50 words. A run-length index (runindex.py) finds repeated
strings by streamed matching statistics, but no index of a whole corpus fits one task, so the corpus is cut into parts
that cannot miss a match: each string is dealt by the least hash of the `GRAM`-byte strings inside it. Consecutive
strings with the same least hash form one segment; equal strings have the same least hash, so they meet in the same
part, and as each string starts in exactly one segment none meets itself.

1. One pass packs the texts into parcels of some MB, written once, and asks the parts about the parcels' segments: least
   hash and content hash, once for equal ones of a parcel, many in a row of the shuffle.
2. A part answers for each: is the content elsewhere too (then it is a repeat as a whole, however many copies there
   are), does it have to be sent (the first copy of a content whose least hash has others), or nothing at all (the
   least hash is alone: most of a corpus). A parcel with over `crowd` contents of one least hash only says so.
3. Sent segments go through the run-length index, part by part. A least hash with more than `hot` contents or from a
   crowded parcel (a passage in very many different surroundings) would fill one task; the strings of its segments are
   dealt once more, each by its own content hash, and counted; they travel in parcels. Both ways are exact.
4. Repeated strings go back to their parcels as spans. Steps 1 to 3 run for strings of `deal` bytes over whole texts and
   then for strings of `length` bytes over what those cover: a longer repeated string is covered by shorter ones.

Rows of the shuffles grow with the segments asked about, never with pairs. Matches are exact up to 128-bit hash
collisions. Defined cases: null and empty texts, and texts shorter than `length`, keep all bytes (a null text reads as
empty, also in `kept`); rows that are equal in id and text count as separate documents and get the same result; null
ids are allowed; an empty table gives no rows; a text of any length is read whole, in steps of 2 MB, and fits one
parcel of its own (below 2 GB); ties do not occur, as no copy is preferred; columns that have a result's name are
replaced, no other name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import runindex
from driftline.llm.common import Planes, flat_column, from_ipc, grouped, ids_of, offsets_of, slices, squeezed, stored, to_ipc

#: Bytes of the strings whose least hash deals a longer string.
GRAM = 32
#: Bytes of the strings that are looked for first, and words that a passage has more than.
DEAL, WORDS = 240, 50
#: Starts in a segment at most; longer ones (periodic texts) are cut.
MOST_STARTS = 4096
#: Bytes that one run-length index takes; parts are gathered up to this.
INDEX_BYTES = 1 << 20
#: Bytes of text in a parcel.
PARCEL = 4 << 20
#: Parts that a shuffle partition answers for, one at a time.
SHARDS_A_PART = 4
_rng = np.random.default_rng(20240501)
BYTE_HASH = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
#: What a part answers about a content: it occurs elsewhere too; send it; its least hash is hot.
WHOLE, SEND, HEAT = 1, 2, 4
#: What a parcel says of a content: several copies; its own strings may be equal; too many contents to name.
SEVERAL, WITHIN, CROWDED = 1, 2, 4


#: Low bits of a least hash that hold the place of the leftmost string that has it.
PLACE = 22
#: Starts that are hashed in one go at most.
AT_ONCE = 1 << 21


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For every start of a string of `length` bytes in data the least hash of the GRAM-byte strings inside it, with that string's place in the low PLACE bits."""
    h, power, size = BYTE_HASH[data], BASE, 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * np.uint64(power) + h[size:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            size *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    h = (h & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def segments(off: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start within the row, number of starts, least hash, whether its own strings may be equal) of all segments of the rows of a column."""
    rows = np.flatnonzero(np.diff(off) >= length)
    out: list[tuple] = []
    at = 0
    while at < len(rows):
        # Rows lie next to each other: several are hashed in one go, and starts that run past a row's end are left out.
        to = at + 1
        while to < len(rows) and off[rows[to] + 1] - off[rows[at]] <= 1 << 19:
            to += 1
        part = rows[at:to]
        at = to
        starts = off[part + 1] - off[part] - length + 1
        for skip in range(0, int(starts[0]) if len(part) == 1 else 1, AT_ONCE):
            base = off[part[0]] + skip
            end = min(off[part[-1] + 1], base + AT_ONCE + length - 1)
            n = np.minimum(starts - skip, AT_ONCE)
            out.append(_cut(data[base:end], part, off[part] - base + skip, n, length, skip))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cut(data: np.ndarray, part: np.ndarray, first: np.ndarray, n: np.ndarray, length: int, skip: int) -> tuple:
    least = least_hashes(data, length)
    place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    least = least[place]
    value, where = (least >> np.uint64(PLACE)).astype(np.int64), least & np.uint64((1 << PLACE) - 1)
    change = np.empty(len(value), bool)
    change[0] = True
    change[1:] = value[1:] != value[:-1]
    change[np.cumsum(n)[:-1]] = True
    cut = np.flatnonzero(change)
    count = np.diff(np.append(cut, len(value)))
    if count.max() > MOST_STARTS:
        pieces = -(-count // MOST_STARTS)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = np.repeat(cut, pieces) + step * MOST_STARTS
        count = np.diff(np.append(cut, len(value)))
    owner = np.repeat(np.arange(len(part)), n)[cut]
    # Equal strings have their least hash at the same distance, so two in one segment need it at two places.
    return part[owner], place[cut] - first[owner] + skip, count, value[cut], where[cut] != where[cut + count - 1]


def _hash128(parts: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)



def _items(least: np.ndarray, s: np.ndarray, within: np.ndarray, crowd: int) -> tuple[np.ndarray, ...]:
    """The different contents of a parcel by least hash: least, s, flags, and the number of each segment's content. A least hash of over `crowd` contents has one entry without a content."""
    order = np.lexsort((s[:, 1], s[:, 0], least))
    l, c = least[order], s[order]
    fresh_least = np.append([True], l[1:] != l[:-1])
    fresh = fresh_least | np.append([True], (c[1:] != c[:-1]).any(axis=1))
    group = np.cumsum(fresh_least) - 1
    crowded = np.bincount(group, weights=fresh)[group] > crowd
    fresh = np.where(crowded, fresh_least, fresh)
    at = np.flatnonzero(fresh)
    item = np.empty(len(order), np.int64)
    item[order] = np.cumsum(fresh) - 1
    flags = np.where(crowded[at], CROWDED, np.where(np.diff(np.append(at, len(l))) > 1, SEVERAL, 0))
    flags = flags | np.where(np.bincount(item, weights=within) > 0, WITHIN, 0)
    return l[at], np.where(crowded[at][:, None], 0, c[at]), flags.astype(np.uint8), item


PARCELS = "parcel long, shard int, texts binary, segs binary, ask binary"


def parcel_rows(name: int, rows: pa.Table, off: np.ndarray, data: np.ndarray, length: int, crowd: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A parcel (PARCELS; shard -1: the rows, with the segments of their texts) and what it asks each shard."""
    row, start, n, least, within = segments(off, data, length)
    asks, segs = [], np.int64(len(row)).tobytes()
    if len(row):
        view, begin = memoryview(data), off[row] + start
        own, s, flags, item = _items(least, _hash128(view[x:y] for x, y in zip(begin.tolist(), (begin + n + length - 1).tolist())), within, crowd)
        segs += squeezed([np.diff(row, prepend=0).astype(np.uint32), start.astype(np.uint32), n.astype(np.uint32), item.astype(np.uint32)])
        shard = (own.astype(np.uint64) * np.uint64(shards)) >> np.uint64(64 - PLACE)
        cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            a, z = cut[i], cut[i + 1]
            asks.append((i, np.int64(z - a).tobytes() + squeezed([np.diff(own[a:z], prepend=0), s[a:z, 0], s[a:z, 1], flags[a:z]])))
    names = [f.split()[0] for f in PARCELS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([to_ipc(rows)], pa.binary()), pa.array([segs], pa.binary()), pa.array([None], pa.binary())], names)
    for i in range(0, len(asks), 256):
        some = asks[i : i + 256]
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([x for x, _ in some], pa.int32()), none, none, pa.array([x for _, x in some], pa.binary())], names)


def parcelled(read: DataFrame, length: int, crowd: int, shards: int, parcel_bytes: int) -> DataFrame:
    """The parcels of texts (PARCELS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 24
        for b in slices(batches, "text", parcel_bytes):
            yield from parcel_rows(name, pa.Table.from_batches([b]), *offsets_of(ids_of(b, "text")), length, crowd, shards)
            name += 1

    return read.mapInArrow(run, PARCELS)


def answers(asks: list[bytes], hot: int) -> list[bytes]:
    """A part's answers to the parcels' asks: a code for each content, and the least hashes of those to be indexed."""
    sizes, opened = [], []
    for x in asks:
        n = int(np.frombuffer(x, np.int64, 1)[0])
        read = Planes(x[8:])
        sizes.append(n)
        opened.append((np.cumsum(read.take(np.int64, n)), read.take(np.int64, n), read.take(np.int64, n), read.take(np.uint8, n)))
    least, s1, s2, flags = (np.concatenate(x) for x in zip(*opened))
    order = np.lexsort((s2, s1, least))  # stable: of equal contents the parcel that comes first leads
    least, s1, s2, flags = least[order], s1[order], s2[order], flags[order]
    fresh_least = np.append([True], least[1:] != least[:-1])
    fresh = fresh_least | np.append([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
    group, content = np.cumsum(fresh_least) - 1, np.cumsum(fresh) - 1
    crowded = flags & CROWDED > 0
    different = np.bincount(group, weights=fresh)[group]
    heat = (np.bincount(group, weights=crowded)[group] > 0) | (different > hot)
    whole = ~crowded & (np.bincount(content, weights=1 + (flags & SEVERAL))[content] > 1)
    send = crowded | fresh & (heat | (different > 1) | ((flags & WITHIN > 0) & ~whole))
    code = np.empty(len(order), np.uint8)
    code[order] = WHOLE * whole + SEND * send + HEAT * (heat & send)
    back = np.empty(len(order), np.int64)
    back[order] = least
    out = []
    for c, l in zip(np.split(code, np.cumsum(sizes)[:-1]), np.split(back, np.cumsum(sizes)[:-1])):
        l = l[c & (SEND | HEAT) == SEND]
        out.append(np.array([len(c), len(l)], np.int64).tobytes() + squeezed([c, l]))
    return out


def packed_spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Spans of a parcel: row, from, to."""
    return np.stack([row, lo, hi]).astype(np.int32).tobytes()


def spans_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, from and to of the maximal runs that all spans cover, in order."""
    if not blobs:
        return tuple(np.zeros((3, 0), np.int64))
    row, lo, hi = np.concatenate([np.frombuffer(x, np.int32).reshape(3, -1) for x in blobs], axis=1).astype(np.int64)
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    reach = np.maximum.accumulate((row << 32) + hi)  # a later row's is above all of an earlier one's
    new = np.append([True], (row << 32)[1:] + lo[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], lo[new], reach[last] - (row[new] << 32)


CONTENT = "parcel long, kind int, row int, start int, least long, blob binary"
COLD, SPAN, ASK, KEY = range(4)


def _content(kind: int, parcel: int, row, start, least, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    wide = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n).copy())
    return pa.RecordBatch.from_arrays([wide(parcel, np.int64), wide(kind, np.int32), wide(row, np.int32), wide(start, np.int32), wide(least, np.int64), pa.array(blobs, pa.binary())], [f.split()[0] for f in CONTENT.split(", ")])


def _strings(parcel: int, row: np.ndarray, at: np.ndarray, h: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """A parcel's single strings, equal ones once, by the shard that counts them (ASK; row is the shard), and where they stand (KEY)."""
    unique, inverse, count = np.unique(h.view("V16").ravel(), return_inverse=True, return_counts=True)
    h = unique.view(np.int64).reshape(-1, 2)
    shard = ((h[:, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    yield _content(KEY, parcel, -1, 0, 0, [np.stack([row, at, place[inverse]]).astype(np.int64).tobytes()])
    some = np.flatnonzero(np.diff(cut))
    yield _content(ASK, parcel, some, 0, 0, [h[order[cut[i] : cut[i + 1]]].tobytes() + (count[order[cut[i] : cut[i + 1]]] > 1).tobytes() for i in some])


def sent(both: DataFrame, length: int, shards: int) -> DataFrame:
    """What the answers ask for (CONTENT): segments to be indexed, spans of segments that are repeats as a whole, and strings of hot ones. both: texts and answers of parcels, sorted by parcel and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (parcel, *_), t in grouped(batches, ["parcel"]):
            n, *_ = np.frombuffer(segs := t.column("segs")[0].as_py(), np.int64, 1).tolist()
            if not n:
                continue
            read = Planes(segs[8:])
            row, start, starts, item = (read.take(np.uint32, n).astype(np.int64) for _ in range(4))
            row = np.cumsum(row)
            codes, leasts = [], []
            for x in t.column("answer").to_pylist()[1:]:
                m, k = np.frombuffer(x, np.int64, 2).tolist()
                read = Planes(x[16:])
                codes.append(read.take(np.uint8, m))
                leasts.append(read.take(np.int64, k))
            codes = np.concatenate(codes)
            code = codes[item]
            off, data = offsets_of(flat_column(from_ipc(t.column("texts")[0].as_py()), "text"))
            view = memoryview(data)
            begin, end = off[row] + start, off[row] + start + starts + length - 1
            if len(k := np.flatnonzero(code & WHOLE)):
                yield _content(SPAN, parcel, 0, 0, 0, [packed_spans(row[k], start[k], start[k] + starts[k] + length - 1)])
            # One copy of each content that is to be indexed.
            named = np.flatnonzero(codes & (SEND | HEAT) == SEND)
            first = np.full(len(codes), -1, np.int64)
            first[item[::-1]] = np.arange(n)[::-1]
            leasts, k = np.concatenate(leasts), first[named]
            for i in range(0, len(k), 4096):
                j = k[i : i + 4096]
                yield _content(COLD, parcel, row[j], start[j], leasts[i : i + 4096], [bytes(view[x:y]) for x, y in zip(begin[j].tolist(), end[j].tolist())])
            if len(k := np.flatnonzero(code & HEAT)):
                k = k[(code[k] & WHOLE == 0) | (first[item[k]] == k)]  # copies of a named content bring no more
                at = np.arange(starts[k].sum()) - np.repeat(np.cumsum(starts[k]) - starts[k], starts[k])
                k = np.repeat(k, starts[k])
                at += start[k]
                yield from _strings(parcel, row[k], at, _hash128(view[i : i + length] for i in (off[row[k]] + at).tolist()), shards)

    return both.mapInArrow(run, CONTENT)


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last indices of stretches of consecutive places of one owner."""
    new = np.append([True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


def counted(content: DataFrame, length: int, shards: int) -> DataFrame:
    """(parcel, spans) of repeated strings among the single ones."""
    asks = content.where(F.col("kind") == ASK).select("parcel", F.col("row").alias("shard"), "blob").repartition(shards, "shard").sortWithinPartitions("shard", "parcel")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["shard"]):
            blobs = t.column("blob").to_pylist()
            n = [len(x) // 17 for x in blobs]
            h = np.concatenate([np.frombuffer(x, np.int64, 2 * m).reshape(-1, 2) for x, m in zip(blobs, n)])
            twice = np.concatenate([np.frombuffer(x, bool, m, 16 * m) for x, m in zip(blobs, n)])
            order = np.lexsort((h[:, 1], h[:, 0]))
            same = (h[order][1:] == h[order][:-1]).all(axis=1)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cut = np.cumsum([0, *n])
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("parcel", "shard")), pa.array([twice[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["parcel", "shard", "blob"])

    keys = content.where(F.col("kind") == KEY).select("parcel", F.col("row").alias("shard"), "blob")
    both = keys.unionByName(asks.mapInArrow(answer, "parcel long, shard int, blob binary")).repartition("parcel").sortWithinPartitions("parcel", "shard")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (parcel, *_), t in grouped(batches, ["parcel"]):
            key, *blobs = t.column("blob").to_pylist()
            row, at, place = np.frombuffer(key, np.int64).reshape(3, -1)
            hit = np.flatnonzero(np.frombuffer(b"".join(blobs), bool)[place])
            if not len(hit):
                continue
            hit = hit[np.lexsort((at[hit], row[hit]))]
            row, at = row[hit], at[hit]
            a, z = _runs(row, at)
            yield pa.RecordBatch.from_arrays([pa.array([parcel]), pa.array([packed_spans(row[a], at[a], at[z] + length)], pa.binary())], ["parcel", "spans"])

    return both.mapInArrow(back, "parcel long, spans binary")


def indexed(content: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(parcel, spans) of repeated strings in sent segments, by run-length indexes over whole least hashes."""
    dealt = content.where(F.col("kind") == COLD).drop("kind").repartition("least").sortWithinPartitions("least", "parcel", "row", "start")

    def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        parcel, row, start = (t.column(c).to_numpy().astype(np.int64) for c in ("parcel", "row", "start"))
        index, first = runindex.build(t.column("blob").to_pylist())
        at = np.flatnonzero(index.matching_statistics() >= length)
        if len(at):
            owner = np.searchsorted(first, at, side="right") - 1
            a, z = _runs(owner, at)
            o = owner[a]
            parcel, row, lo, hi = parcel[o], row[o], start[o] + at[a] - first[o], start[o] + at[z] - first[o] + length
            order = np.argsort(parcel, kind="stable")
            own, cut = np.unique(parcel[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([packed_spans(row[k], lo[k], hi[k]) for k in np.split(order, cut[1:])], pa.binary())], ["parcel", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, rows in grouped(batches, ["least"]):
            own = rows.column("blob").nbytes
            if held and size + own > index_bytes:
                yield from flush(held)
                held, size = [], 0
            held.append(rows)
            size += own
        if held:
            yield from flush(held)

    return dealt.mapInArrow(run, "parcel long, spans binary")


def repeated(parcels: DataFrame, length: int, hot: int, index_bytes: int, parts: int) -> DataFrame:
    """(parcel, spans): what repeated strings of `length` bytes cover in parcels, which were made for that length."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["shard"]):
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("parcel", "shard")), pa.array(answers(t.column("ask").to_pylist(), hot), pa.binary())], ["parcel", "shard", "answer"])

    asked = parcels.where("shard >= 0").select("parcel", "shard", "ask").repartition(parts, "shard").sortWithinPartitions("shard", "parcel")
    told = asked.mapInArrow(reply, "parcel long, shard int, answer binary")
    none = F.lit(None).cast("binary")
    both = parcels.where("shard < 0").select("parcel", "shard", "texts", "segs", none.alias("answer")).unionByName(told.select("parcel", "shard", none.alias("texts"), none.alias("segs"), "answer"))
    content = stored(sent(both.repartition(parts, "parcel").sortWithinPartitions("parcel", "shard"), length, SHARDS_A_PART * parts), "contents")
    whole = content.where(F.col("kind") == SPAN).select("parcel", F.col("blob").alias("spans"))
    return whole.unionByName(indexed(content, length, index_bytes)).unionByName(counted(content, length, SHARDS_A_PART * parts))


def with_spans(parcels: DataFrame, parts: int, **found: DataFrame) -> DataFrame:
    """The parcels' texts, each followed by its spans, in columns by the names of found."""
    none = F.lit(None).cast("binary")
    names = ["texts", *found]
    each = {"texts": parcels.where("shard < 0").select("parcel", "texts")} | {n: df.select("parcel", F.col("spans").alias(n)) for n, df in found.items()}
    both = None
    for n, df in each.items():
        df = df.select("parcel", *[F.col(n) if n == m else none.alias(m) for m in names])
        both = df if both is None else both.unionByName(df)
    return both.repartition(parts, "parcel").sortWithinPartitions(F.col("parcel"), F.col("texts").isNull())


def _wide(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs in which a string of `length` bytes fits."""
    k = hi - lo >= length
    return row[k], lo[k], hi[k]


def regions(held: DataFrame, length: int, crowd: int, shards: int) -> DataFrame:
    """Parcels (PARCELS) of the runs that shorter strings cover, in order of row and place; a parcel keeps its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (parcel, *_), t in grouped(batches, ["parcel"]):
            row, lo, hi = _wide(*spans_of([x for x in t.column("short").to_pylist() if x is not None]), length)
            if not len(row):
                continue
            off, data = offsets_of(flat_column(from_ipc(t.column("texts")[0].as_py()), "text"))
            view = memoryview(data)
            texts = pa.array([bytes(view[x:y]) for x, y in zip((off[row] + lo).tolist(), (off[row] + hi).tolist())], pa.binary())
            yield from parcel_rows(parcel, pa.table({"text": texts}), *offsets_of(texts), length, crowd, shards)

    return held.mapInArrow(run, PARCELS)


def words_in(raw: bytes, lo: int, hi: int) -> int:
    """Words of a text that lie whole between two places."""
    n = len(raw[lo:hi].split())
    cut = lambda at: 0 < at < len(raw) and not raw[at - 1 : at].isspace() and not raw[at : at + 1].isspace()
    return max(0, n - (n > 0 and cut(lo)) - (n > 0 and cut(hi)))


def removed(docs: DataFrame, text: str = "text", length: int = 400, carry: list[str] | None = None, with_text: bool = True, hot: int = 256, deal: int | None = None, over: int = WORDS, crowd: int = 64, index_bytes: int = INDEX_BYTES, parcel_bytes: int = PARCEL) -> DataFrame:
    """docs (the columns of carry; all) with n_bytes, n_removed, n_spans, kept_sha256, n_passages and passage_words (repeated passages of over `over` words, and their words), and with_text the rest of the bytes (kept) and the spans removed."""
    deal = min(deal or DEAL, length)
    if deal < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes are found")
    kinds = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "n_passages": T.LongType(), "passage_words": T.LongType()}
    kinds |= {"kept": T.BinaryType(), "spans": T.ArrayType(T.ArrayType(T.LongType()))} if with_text else {}
    own = [c for c in (docs.columns if carry is None else carry) if c not in kinds]
    read = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, crowd = SHARDS_A_PART * parts, min(crowd, hot)
    parcels = stored(parcelled(read, deal, crowd, shards, parcel_bytes), "parcels")
    short = stored(repeated(parcels, deal, hot, index_bytes, parts), "spans")
    if deal < length:
        inner = stored(regions(with_spans(parcels, parts, short=short), length, crowd, shards), "regions")
        last = with_spans(parcels, parts, short=short, long=repeated(inner, length, hot, index_bytes, parts))
    else:
        last = with_spans(parcels, parts, short=short).withColumn("long", F.lit(None).cast("binary"))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in own] + [T.StructField(n, k) for n, k in kinds.items()])
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["parcel"]):
            rows = from_ipc(t.column("texts")[0].as_py())
            off, data = offsets_of(flat_column(rows, "text"))
            row, lo, hi = spans_of([x for x in t.column("short").to_pylist() if x is not None])
            far = (row, lo, hi)
            if deal < length:
                own_row, own_lo, _ = _wide(row, lo, hi, length)
                r, x, y = spans_of([x for x in t.column("long").to_pylist() if x is not None])
                far = (own_row[r], own_lo[r] + x, own_lo[r] + y)
            cuts = [np.searchsorted(x, np.arange(rows.num_rows + 1)) for x in (row, far[0])]
            out = []
            for i in range(rows.num_rows):
                raw = bytes(memoryview(data)[off[i] : off[i + 1]])
                a, z = cuts[0][i], cuts[0][i + 1]
                passages = [n for x, y in zip(lo[a:z].tolist(), hi[a:z].tolist()) if (n := words_in(raw, x, y)) > over]
                a, z = cuts[1][i], cuts[1][i + 1]
                x, y = far[1][a:z].tolist(), far[2][a:z].tolist()
                rest = b"".join(raw[p:q] for p, q in zip([0, *y], [*x, len(raw)])) if x else raw
                out.append((len(raw), len(raw) - len(rest), len(x), hashlib.sha256(rest).hexdigest(), len(passages), sum(passages), rest, [list(p) for p in zip(x, y)]))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), arrow)][: len(kinds)]
            yield pa.RecordBatch.from_arrays([*(flat_column(rows, f"c{i}") for i in range(len(own))), *cols], [*own, *kinds])

    return last.mapInArrow(finish, schema)
