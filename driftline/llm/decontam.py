"""Benchmark decontamination over a positional inverted index.

The index is dealt out by documents: every task keeps, for the documents it reads, one posting list of positions for
each term that the test items use. A query (a window of test words) takes the list of its rarest term, moves it by the
term's offset to the places where the window would start, and intersects it with the other terms' lists, moved by their
own offsets, from rare to frequent; each intersection is a search in the other list. What remains are exact phrase
matches. `near` answers proximity queries from the same lists: windows whose terms all stand within some words of a
place of the rarest one. Postings never leave the task that made them, only hits do, so a lost executor costs a task.

The test items' windows go to every task in blocks of at most `block_words` words, whose size is checked; each block is
gathered and broadcast, and where there are several, each is a pass of its own and the passes' hits are merged by
document. A benchmark of any size is answered in full, and one block or many give the same columns and rows.

Defined cases: null and empty texts have no words; an item without words has no window and is never found; an item of
fewer words than a window is one window; repeated items count once by their id (null ids are left out of the list of
ids, but their windows hit); equal windows of different items hit for each item; equal document rows get equal results;
texts of any length are read whole; ties do not occur; an empty table gives no rows, an empty benchmark no hits; columns
that have a result's name are replaced, no other name can clash.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import UPPER, as_bytes, ids_of, numbered_columns, own_arrays, own_fields, row_key, slices

#: Bytes that are no part of a word become spaces, A-Z becomes a-z.
TABLE = bytes(c + 32 if c in UPPER else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))
#: Words of test items that are broadcast at once: at about 60 bytes for each word with its place in a window, 120 MB at most.
BLOCK_WORDS = 2_000_000
#: Places of rarest terms that are looked into at once, so that a window of frequent words alone takes no more memory.
PLACES = 1 << 17
FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class Queries:
    """The windows of a block of items: terms by number, and for every length the windows as rows of term numbers with the items they stem from."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [number.setdefault(x, len(number)) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.number = number
        by: dict[int, list] = {}
        for w in found:
            by.setdefault(len(w), []).append(w)
        self.rows = {n: np.array(ws, np.int32).reshape(len(ws), n) for n, ws in by.items()}
        self.items = {n: [sorted(x for x in found[w] if x is not None) for w in ws] for n, ws in by.items()}


class Segment:
    """The index of some documents: postings of the query terms."""

    def __init__(self, texts: list[bytes | None], number: dict[bytes, int]):
        get, terms, at = number.get, [], 0
        self.starts, self.n_words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = words_of(t)
            self.starts[i], self.n_words[i] = at, len(w)
            terms.append(np.fromiter((get(x, -1) for x in w), np.int32, len(w)))
            terms.append(np.full(1, -1, np.int32))  # matches never cross documents
            at += len(w) + 1
        self.terms = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        at = np.flatnonzero(self.terms >= 0)
        order = np.argsort(self.terms[at], kind="stable")
        self.positions = at[order]
        self.counts = np.bincount(self.terms[at], minlength=len(number)) if len(number) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        #: All posting lists in one sorted row: term * length + position.
        self.keys = self.terms[self.positions].astype(np.int64) * (len(self.terms) + 1) + self.positions

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]]

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the posting list of its term."""
        key = terms.astype(np.int64) * (len(self.terms) + 1) + positions
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def order(self, windows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The windows that have postings for all terms, and for each of them its terms' places from rare to frequent. counts: of all terms, where those of these documents don't decide."""
        df = self.counts[windows]
        alive = np.flatnonzero(df.min(axis=1) > 0)
        return alive, np.argsort((df if counts is None else counts[windows])[alive], axis=1, kind="stable").astype(np.int16)

    def places(self, rare: np.ndarray, at_once: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number in rare, position) of all postings of the terms of rare, about at_once at a time; a long list comes in portions."""
        sizes = self.counts[rare]
        ends = np.cumsum(sizes)
        for at in range(0, int(ends[-1]) if len(ends) else 0, at_once):
            n = np.arange(at, min(at + at_once, int(ends[-1])))
            i = np.searchsorted(ends, n, side="right")
            yield i, self.positions[self.first[rare[i]] + n - (ends[i] - sizes[i])]

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window number, start) of every occurrence of the windows, all of one length."""
        n = windows.shape[1]
        alive, order = self.order(windows)
        for i, place in self.places(windows[alive, order[:, 0]]):
            start = place - order[i, 0]
            ok = (start >= 0) & (start + n <= len(self.terms))
            for k in range(1, n):
                i, start = i[ok], start[ok]
                if not len(start):
                    break
                ok = self.holds(windows[alive[i], order[i, k]], start + order[i, k])
            if len(start):
                i, start = i[ok], start[ok]
            if len(start):
                yield alive[i], start

    def near(self, windows: np.ndarray, within: int, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window number, place) of the places of windows' rarest terms around which every other term stands at most `within` words away, in the same document."""
        last = max(len(self.keys) - 1, 0)
        alive, order = self.order(windows, counts)
        for i, place in self.places(windows[alive, order[:, 0]]):
            for k in range(1, windows.shape[1]):
                if not len(place):
                    break
                base = windows[alive[i], order[i, k]].astype(np.int64) * (len(self.terms) + 1)
                at, doc = np.searchsorted(self.keys, base + place), self.doc_of(place)
                ok = np.zeros(len(place), bool)
                for j in (np.maximum(at - 1, 0), np.minimum(at, last)):
                    other = self.keys[j] - base  # out of 0 to length, if it is another term's
                    ok |= (np.abs(other - place) <= within) & (other >= 0) & (other < len(self.terms)) & (self.doc_of(other) == doc)
                i, place = i[ok], place[ok]
            if len(place):
                yield alive[i], place

    def documents(self, positions: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, int]]:
        """The different (document, window number) of some matches."""
        most = int(which.max()) + 1
        for x in np.unique(self.doc_of(positions) * most + which).tolist():
            yield divmod(x, most)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def search(texts: list[bytes | None], q: Queries, near: int | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], list[set], list[set]]:
    """Word counts, hit positions within each document, the items found there, and those found by proximity."""
    seg = Segment(texts, q.number)
    cover = np.zeros(len(seg.terms) + 1, np.int32)
    items: list[set] = [set() for _ in texts]
    close: list[set] = [set() for _ in texts]
    for n, windows in q.rows.items():
        for which, start in seg.phrases(windows):
            np.add.at(cover, start, 1)
            np.add.at(cover, start + n, -1)
            for d, w in seg.documents(start, which):
                items[d].update(q.items[n][w])
        if near is not None:
            for which, place in seg.near(windows, near, counts):
                for d, w in seg.documents(place, which):
                    close[d].update(q.items[n][w])
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    cuts = np.searchsorted(hit, seg.starts)
    return seg.n_words, [h - s for h, s in zip(np.split(hit, cuts[1:]), seg.starts)] if len(texts) else [], items, close


def summary(n_words: int, n_hit: int, items) -> tuple:
    return int(n_words), int(n_hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(n_hit)


def item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> list[DataFrame]:
    """The items in blocks whose words are at most about block_words; one where they all fit."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // 2 // block_words) + 1  # a word and its gap take two bytes at least
    return [b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [b]


def term_counts(read: DataFrame, held, n_terms: int) -> np.ndarray:
    """How often each term of a block of items stands in all documents: at most n_terms rows from a task and to the driver, whatever the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = pickle.loads(held.value).number.get, np.zeros(n_terms, np.int64)
        for b in slices(batches, "text"):
            ids = np.fromiter((get(w, -1) for t in as_bytes(ids_of(b, "text")) for w in words_of(t)), np.int32)
            total += np.bincount(ids[ids >= 0], minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in read.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", carry: list[str] | None = None, block_words: int = BLOCK_WORDS, near: int | None = None) -> DataFrame:
    """docs (the columns of carry; all) with n_words, n_hit, n_items, items_sha256, contaminated and items (sorted ids). near: also n_near, the items of which a window's words all stand at most so many words from a place of the one that is rarest in all of docs (the first, where several are)."""
    fields = FIELDS + ([("n_near", T.LongType())] if near is not None else [])
    names = [n for n, _ in fields] + ["items"]
    own = [c for c in (docs.columns if carry is None else carry) if c not in names]
    read = numbered_columns(docs, own, text=F.col(f"`{text}`"))
    spark = docs.sparkSession
    held = []
    for block in item_blocks(benchmark, item, item_text, block_words):
        rows = [(r["item"], r["text"].encode() if r["text"] is not None else None) for r in block.toLocalIterator()]
        q = Queries(rows, window)
        block_held = spark.sparkContext.broadcast(pickle.dumps(q, 5))
        # Which term is the rarest is asked of all documents, so that proximity does not depend on how they are dealt.
        held.append((block_held, spark.sparkContext.broadcast(term_counts(read, block_held, len(q.number)) if near is not None else None)))
    if len(held) > 1:
        return _merged(read, own, held, near)
    whole, rare = held[0]
    schema = T.StructType(own_fields(docs, own) + [T.StructField(n, t) for n, t in fields] + [T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = pickle.loads(whole.value)
        for b in slices(batches, "text", 8 << 20):
            n_words, hits, items, close = search(as_bytes(ids_of(b, "text")), q, near, rare.value)
            rows = list(zip(*(summary(n, len(h), i) for n, h, i in zip(n_words, hits, items))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            cols = [pa.array(r, k) for r, k in zip(rows, kinds)] + ([pa.array([len(c) for c in close], pa.int64())] if near is not None else [])
            yield pa.RecordBatch.from_arrays([*own_arrays(b, len(own)), *cols, pa.array([sorted(i) for i in items], pa.list_(pa.string()))], [*own, *names])

    return read.mapInArrow(run, schema)


def _merged(read: DataFrame, own: list[str], held: list, near: int | None) -> DataFrame:
    """As above for several blocks: a pass for each, the first over all documents, and hits brought together by the rows' content."""
    keyed = row_key(read, *read.columns)
    kind = "k1 long, k2 long, n_words long, hits array<long>, found array<string>, close array<string>"

    def one(held_block, every: bool):
        block, rare = held_block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = pickle.loads(block.value)
            for b in slices(batches, "text", 8 << 20):
                n_words, hits, items, close = search(as_bytes(ids_of(b, "text")), q, near, rare.value)
                k = [i for i in range(b.num_rows) if every or len(hits[i]) or close[i]]
                at = pa.array(k, pa.int64())
                cols = [pa.array([int(n_words[i]) for i in k], pa.int64()), pa.array([hits[i].tolist() for i in k], pa.list_(pa.int64())), *(pa.array([sorted(x[i]) for i in k], pa.list_(pa.string())) for x in (items, close))]
                yield pa.RecordBatch.from_arrays([ids_of(b, "k1").take(at), ids_of(b, "k2").take(at), *cols], ["k1", "k2", "n_words", "hits", "found", "close"])

        return keyed.select("k1", "k2", "text").mapInArrow(run, kind)

    found = one(held[0], True)
    for block in held[1:]:
        found = found.unionByName(one(block, False))
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  a document's own hits
    found = found.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), *map(together, ("hits", "found", "close")))
    out = keyed.drop("text").join(found, ["k1", "k2"])
    size = lambda c: F.size(c).cast("long")
    result = [F.col("n_words"), size("hits").alias("n_hit"), size("found").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *result, *([size("close").alias("n_near")] if near is not None else []), F.col("found").alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that hold a window of an item, with the columns they came with."""
    names = [n for n, _ in FIELDS] + ["items"]
    clash = {n: f"__own_{n}" for n in names if n in docs.columns}
    safe = docs.withColumnsRenamed(clash)
    out = contamination(safe, benchmark, window).where("NOT contaminated").select(*[F.col(f"`{c}`") for c in safe.columns])
    return out.withColumnsRenamed({v: k for k, v in clash.items()})
