"""Scores of texts under an n-gram model of the corpus.

Training documents are counted, and all documents scored, in batches of a few million tokens. A batch's different
n-grams are sorted into a small trie (words by 64-bit hash, then what follows them), cut by the first word's hash into
as many shards as there are shuffle partitions, and sent there as packed blobs: n-grams travel once per batch, not once
per occurrence, and no row of the shuffle stands for a single n-gram. A shard adds the batches' counts up, builds an
Elias-Fano trie with quantised probabilities (trie.py) and answers each batch's n-grams, by successor search, in the
order in which they were asked. The answers, one byte each and four for a word's count, go back to the batch's texts.
What is gathered grows with the corpus; nothing of it goes through the driver but two sums.

P(w | c) = share(c, w) + rest(c) P(w | shorter c): absolute discounting, down to (count + 1) / (N + V + 1), the base
score's probability. The context before a text is `order` - 1 marks; every text ends in one end, counted as a token.

Defined cases: a null or empty text is one end; null ids belong to the training part; repeated rows are counted and
scored each; an empty table gives no rows; with no training document all counts are 0 and P is 1 / (V + 1) = 1.
Batches are made again for the second pass: `docs` must give the same rows in the same partitions when it is read
again, as a scan of files does; otherwise pass stable=False, which writes it to the shared folder first. A batch whose
answers are missing raises an error. Texts are read whole, whatever their length; a level of a batch or shard takes up
to 2^24 n-grams and raises an error beyond that (a single text of some hundred MB). Counts have 64 bits. Ties do not
occur. Columns that have a result's name are replaced, no other name can clash. A (batch, shard) pair that has no n-gram
sends no row, so rows never outnumber the batches' n-grams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import Planes, as_bytes, flat_column, from_ipc, grouped, ids_of, numbered_columns, own_fields, slices, squeezed, stored, to_ipc
from driftline.llm.trie import NAME, VALUES, Trie

#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
#: Shards that a shuffle partition holds; one shard's trie is in memory at a time.
SHARDS_A_PART = 4
START, END = b"\x00 start", b"\x00 end"  # no word has a space
_MASK = np.uint64((1 << NAME) - 1)
FIELDS = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and for each key its number (np.unique with half the memory)."""
    order = np.argsort(key)
    key = key[order]
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    inverse = np.empty(len(key), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], inverse


def check_width(nodes: int) -> None:
    """A node's number and the name below it share 64 bits; more nodes than that would be taken for each other."""
    if nodes >= 1 << (64 - NAME):
        raise OverflowError(f"{nodes} n-grams of one length in a batch or shard; ask for more shards (or smaller batches)")


class Batch:
    """The n-grams of some texts. keys[k]: the different (k + 2)-grams, as number of the (k + 1)-gram << NAME | name of the last word. With places: at[k], for every token, the number of the (k + 1)-gram that ends there, and context[k], of the (k + 1)-gram before it."""

    def __init__(self, texts: list[bytes | None], train: np.ndarray, order: int, places: bool = True):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        get = number.__getitem__
        start, end = get(START), get(END)
        pad, parts, self.n_tokens = [start] * (order - 1), [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = (t or b"").lower().split()
            self.n_tokens[i] = len(w) + 1
            parts.append(np.array([*pad, *map(get, w), end], np.int32))
        ids = np.concatenate(parts)
        del parts
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        del number, get  # the largest thing here
        by = np.argsort(hashes)
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.words = hashes[by]
        ids = place[ids]
        self.starts = np.concatenate([[0], np.cumsum(self.n_tokens)])[:-1]
        # Tokens to predict: all but the marks before each text.
        predicted = np.arange(self.n_tokens.sum(), dtype=np.int32) + np.repeat((np.arange(len(texts), dtype=np.int32) + 1) * (order - 1), self.n_tokens)
        learnt = predicted[np.repeat(train, self.n_tokens)]
        name = self.words & _MASK
        self.order, self.keys, self.counts = order, [], [np.bincount(ids[learnt], minlength=len(by))]
        self.at, self.context = [ids[predicted]] if places else [], []
        nodes = ids  # the number of the n-gram of the level at hand that starts at each place
        for k in range(1, order):
            check_width(int(nodes.max(initial=0)))
            key = nodes[:-1].astype(np.uint64)
            key <<= np.uint64(NAME)
            key |= name[ids[k:]]
            unique, inverse = numbered(key)
            if places:
                self.context.append(nodes[predicted - k])
                self.at.append(inverse[predicted - k])
            self.keys.append(unique)
            self.counts.append(np.bincount(inverse[learnt - k], minlength=len(unique)))
            nodes = inverse

    def cuts(self, shards: int) -> list[np.ndarray]:
        """For every level where each shard's part begins (and the last ends)."""
        top = ((self.words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        cut = np.searchsorted(top, np.arange(shards + 1, dtype=np.uint64))
        out = [cut]
        for keys in self.keys:
            cut = np.searchsorted(keys, cut.astype(np.uint64) << np.uint64(NAME))
            out.append(cut)
        return out

    def asks(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """(shard, blob) with the words, and for each further level how many nodes follow each parent, their names and counts."""
        cuts = self.cuts(shards)
        for s in range(shards):
            a, b = cuts[0][s], cuts[0][s + 1]
            if a == b:
                continue
            small, names = [np.diff(self.words[a:b], prepend=np.uint64(0)), self.counts[0][a:b].astype(np.uint64)], []
            for k, keys in enumerate(self.keys):
                c, d = cuts[k + 1][s], cuts[k + 1][s + 1]
                parent = (keys[c:d] >> np.uint64(NAME)).astype(np.int64) - a
                small += [np.bincount(parent, minlength=b - a).astype(np.uint32), self.counts[k + 1][c:d].astype(np.uint64)]
                names.append((keys[c:d] & _MASK).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes())
                a, b = c, d
            packed = squeezed(small)
            yield s, b"".join([np.array([len(packed), *(c[s + 1] - c[s] for c in cuts)], np.int64).tobytes(), packed, *names])


def opened(blob: bytes, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """words, counts by level, parents and names by further level."""
    packed, *sizes = np.frombuffer(blob, np.int64, order + 1).tolist()
    at = 8 * (order + 1) + packed
    read = Planes(blob[8 * (order + 1) : at])
    words, counts, parents, names = np.cumsum(read.take(np.uint64, sizes[0]), dtype=np.uint64), [read.take(np.uint64, sizes[0])], [], []
    for k in range(1, order):
        parents.append(np.repeat(np.arange(sizes[k - 1], dtype=np.int32), read.take(np.uint32, sizes[k - 1])))
        counts.append(read.take(np.uint64, sizes[k]))
        name = np.zeros((sizes[k], 8), np.uint8)
        name[:, :5] = np.frombuffer(blob, np.uint8, 5 * sizes[k], at).reshape(5, sizes[k]).T
        names.append(name.view(np.uint64)[:, 0])
        at += 5 * sizes[k]
    return words, counts, parents, names


def learn(blobs: list[bytes], order: int, discount: float) -> Trie:
    """The trie of a shard: what was seen in training, of all batches."""
    opens = [opened(b, order) for b in blobs]
    words, inverse = numbered(np.concatenate([o[0] for o in opens]))
    counts = np.bincount(inverse, weights=np.concatenate([o[1][0] for o in opens]), minlength=len(words))
    below = []
    where = np.split(inverse, np.cumsum([len(o[0]) for o in opens])[:-1])
    for k in range(order - 1):
        lengths = [len(o[3][k]) for o in opens]
        keys = np.concatenate([(w[o[2][k]].astype(np.uint64) << np.uint64(NAME)) | o[3][k] for w, o in zip(where, opens)])
        check_width(len(words) if not k else len(below[-1][0]))
        unique, inverse = numbered(keys)
        del keys
        below.append((unique, np.bincount(inverse, weights=np.concatenate([o[1][k + 1] for o in opens]), minlength=len(unique))))
        where = np.split(inverse, np.cumsum(lengths)[:-1])
        for o in opens:
            o[2][k] = o[3][k] = o[1][k + 1] = None
    return Trie.build(words, counts, below, discount).mapped()


def answer(trie: Trie, blob: bytes, order: int) -> bytes:
    """For the n-grams of a blob, in its order: counts of words, then for each level codes of rest (of its parents' level) and of share."""
    words, _, parents, names = opened(blob, order)
    node = trie.find_words(words)
    out = [np.where(node >= 0, trie.counts[node], 0).astype(np.uint64)]
    for k in range(order - 1):
        out.append(np.where(node >= 0, trie.rest[k][node] if len(trie.rest[k]) else 255, 255).astype(np.uint8))
        node = trie.find_after(k + 1, node[parents[k]], names[k])
        out.append(np.where(node >= 0, trie.share[k][node] if len(trie.share[k]) else 0, 0).astype(np.uint8))
    return squeezed(out)


def score(batch: Batch, answers: dict[int, bytes], shards: int, total: int, kinds: int) -> tuple[np.ndarray, ...]:
    """n_known, base_score and score of every text."""
    order = batch.order
    cuts = batch.cuts(shards)
    n = [len(batch.words), *(len(k) for k in batch.keys)]
    count = np.zeros(n[0], np.int64)
    rest, share = [np.zeros(n[k], np.uint8) for k in range(order - 1)], [np.zeros(n[k + 1], np.uint8) for k in range(order - 1)]
    for s in range(shards):
        a, b = cuts[0][s], cuts[0][s + 1]
        if a == b:
            continue
        read = Planes(answers[s])
        count[a:b] = read.take(np.uint64, b - a)
        for k in range(order - 1):
            a, b, c, d = cuts[k][s], cuts[k][s + 1], cuts[k + 1][s], cuts[k + 1][s + 1]
            rest[k][a:b] = read.take(np.uint8, b - a)
            share[k][c:d] = read.take(np.uint8, d - c)
    c = count[batch.at[0]]
    p = (c + 1.0) / (total + kinds + 1.0)
    base = np.log10(p)
    for k in range(order - 1):
        p = VALUES[share[k]][batch.at[k + 1]] + VALUES[rest[k]][batch.context[k]] * p
    return tuple(np.add.reduceat(x, batch.starts) for x in ((c > 0).astype(np.int64), base, np.log10(np.minimum(p, 1.0))))


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, int, int]]:
    """Tables of about `most` bytes of text, and the name of each."""
    held, size, seq = [], 0, 0
    part = TaskContext.get().partitionId()

    def named() -> tuple[pa.Table, int, int]:
        t = pa.Table.from_batches(held)
        h = xxhash.xxh3_128(f"{part}:{seq}:{t.num_rows}".encode())
        for x in as_bytes(t.column("__text").combine_chunks() if t.num_rows else pa.array([], pa.string())):
            h.update(x or b"")
            h.update(b"\0")
        a, b = np.frombuffer(h.digest(), np.int64)
        return t, int(a), int(b)

    for b in slices(batches, "__text", min(most, 4 << 20)):
        held.append(b)
        size += b.get_total_buffer_size() if b.num_rows == 0 else int(ids_of(b, "__text").nbytes)
        if size >= most:
            yield named()
            held, size, seq = [], 0, seq + 1
    if held:
        yield named()


def scored(docs: DataFrame, train: Column, text: str = "text", carry: list[str] | None = None, order: int = 3, discount: float = 0.75, shards: int | None = None, batch_bytes: int = BATCH_BYTES, stable: bool = False) -> DataFrame:
    """docs (the columns of carry; all) with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    names = ["held_out", *(n for n, _ in FIELDS)]
    own = [c for c in (docs.columns if carry is None else carry) if c not in names]
    if not stable:
        docs = stored(docs, "lm-docs")
    read = numbered_columns(docs, own, __text=F.col(f"`{text}`"), __train=F.coalesce(train, F.lit(True)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or SHARDS_A_PART * parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b in _batches(batches, batch_bytes):
            asks = list(Batch(as_bytes(flat_column(t, "__text")), flat_column(t, "__train").to_numpy(zero_copy_only=False), order, places=False).asks(shards))
            for i in range(0, len(asks), 8):
                some = asks[i : i + 8]
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(some)), pa.array([b] * len(some)), pa.array([s for s, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["b1", "b2", "shard", "blob"])

    asked = read.select("__text", "__train").mapInArrow(ask, "b1 long, b2 long, shard int, blob binary").repartition(parts, "shard").sortWithinPartitions("shard")

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["shard"]):
            blobs = t.column("blob").to_pylist()
            trie = learn(blobs, order, discount)
            total, kinds = int(trie.counts.sum(dtype=np.int64)), int((trie.counts > 0).sum())
            for i, blob in enumerate(blobs):
                yield pa.RecordBatch.from_arrays([*(t.column(c).slice(i, 1).combine_chunks() for c in ("b1", "b2", "shard")), pa.array([answer(trie, blob, order)], pa.binary()), pa.array([0 if i else total], pa.int64()), pa.array([0 if i else kinds], pa.int64())], ["b1", "b2", "shard", "blob", "total", "kinds"])

    replies = stored(asked.mapInArrow(reply, "b1 long, b2 long, shard int, blob binary, total long, kinds long"), "lm-replies")
    total, kinds = (x or 0 for x in replies.agg(F.sum("total"), F.sum("kinds")).first())

    def parcel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b in _batches(batches, batch_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([-1], pa.int32()), pa.array([to_ipc(t)], pa.binary())], ["b1", "b2", "shard", "blob"])

    both = read.mapInArrow(parcel, "b1 long, b2 long, shard int, blob binary").unionByName(replies.select("b1", "b2", "shard", "blob"))
    both = both.repartition(parts, "b1", "b2").sortWithinPartitions("b1", "b2", "shard")
    schema = T.StructType(own_fields(docs, own) + [T.StructField("held_out", T.BooleanType())] + [T.StructField(n, k) for n, k in FIELDS])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, ["b1", "b2"]):
            shard = t.column("shard").to_pylist()
            blobs = dict(zip(shard, t.column("blob").to_pylist()))
            if -1 not in blobs:
                raise RuntimeError("a batch of texts was not made again as before; call scored with stable=False")
            rows = from_ipc(blobs.pop(-1))
            batch = Batch(as_bytes(flat_column(rows, "__text")), flat_column(rows, "__train").to_numpy(zero_copy_only=False), order)
            known, base, own_score = score(batch, blobs, shards, total, kinds)
            n = rows.num_rows
            cols = [*(flat_column(rows, f"c{i}") for i in range(len(own))), pa.array(~flat_column(rows, "__train").to_numpy(zero_copy_only=False)), pa.array(batch.n_tokens), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(own_score)]
            yield pa.RecordBatch.from_arrays(cols, [*own, *names])

    return both.mapInArrow(finish, schema)
