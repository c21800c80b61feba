"""SimHash fingerprints and near duplicates by tiled exact comparison.

A document's fingerprint has a bit for each of 64 places, set if it is set in over half of the XXH64 hashes of the
document's shingles. Fingerprints that differ in `radius` bits at most agree in one of radius + 1 blocks at least, so
distinct fingerprints are compared within buckets of equal blocks only. Inside a bucket they are laid out by population
count and compared tile against tile with exclusive-or and bit counts; tile pairs whose population counts lie further
apart than the radius are skipped. A large bucket is dealt out as pairs of tiles over many tasks. From a tile pair
come only the links of a spanning forest, so a group of n copies gives about n links.

A radius of a few bits finds copies with small edits only. For a similarity of shingle sets (0.8 in the pipeline) near_duplicates
takes `wide`, a radius on a second fingerprint of 256 bits: at similarity 0.8 two of them differ in about 39 bits, give
or take 6. Blocks of bits can't find such pairs, so these are compared, by the same tiles, within buckets of texts that
share one of their `SKETCH` least shingle hashes; a pair of similarity 0.8 misses all buckets once in 400,000. Every text
stays in all of its buckets; large ones are dealt as tile pairs, so a passage that very many texts share brings no task
all of them.

With `similar` (the pipeline) fingerprints only bring up candidates: texts whose 256 bits, made of each different shingle
once, differ in REACH at most. Of 1,500 pairs of similarity 0.8 at each of six sizes none was further apart than 62.
Then the texts of each group of candidates meet, and a link counts if their exact sets of shingle hashes have that
similarity. Groups and buckets over `DEALT` are dealt as pairs of tiles of texts whose set sizes allow it.

Defined cases: a null or empty text has no shingle and fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence is the one shingle; repeated rows share a fingerprint and so a component; null ids take
no part in a component's least id (a component of null ids only has a null component_id); texts are read whole,
whatever their length, and hashed in steps; of ties in an id none is preferred, as the least id is the same; an empty
table gives no rows; other columns of the table are not read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, grouped, ids_of, numbered_columns, slices, stored
from driftline.llm.components import components
from driftline.session import small

#: Fingerprints in a tile of the comparison, and in a tile that is dealt to a task.
TILE, DEALT = 512, 2048
#: Words of a wide fingerprint, and least shingle hashes of a text.
WIDE, SKETCH = 4, 8
#: Bits in which the wide fingerprints of candidates differ at most, where exact sets are compared after that.
REACH = 64
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 hashes of a text's shingles, repeats included."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    return np.fromiter((digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle)))), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """A row of words with each bit set that is set in over half of the rows of hashes."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 13):
        ones += np.unpackbits(np.ascontiguousarray(hashes[at : at + (1 << 13)]).view(np.uint8).reshape(-1, len(ones) // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """WIDE independent hashes for each one."""
    x = hashes[:, None] * MIXERS[None, :]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's bytes."""
    return int(majority(shingle_hashes(text, shingle, seed)[:, None])[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = 3, wide: bool = False, sets: bool = False) -> DataFrame:
    """docs (the columns of carry; all) with fp, the fingerprint as a signed long; wide: also wide, of WIDE words, and sketch, the least hashes. sets: all of the set of shingles instead, fp a hash of it, and its size and the text as body."""
    names = ["fp", "wide", "sketch", "size", "body"] if sets else ["fp", "wide", "sketch"] if wide else ["fp"]
    own = [c for c in (docs.columns if carry is None else carry) if c not in {"fp", "wide", "sketch", *names}]
    read = docs.select(*own, F.col(text).alias("__text"))
    kinds = {"fp": "long", "wide": "binary", "sketch": "array<long>", "size": "long", "body": "string"}
    schema = docs.select(*own, *[F.lit(None).cast(kinds[n]).alias(n) for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            hashes = [shingle_hashes(x, shingle) for x in as_bytes(ids_of(b, "__text"))]
            if sets:
                hashes = [np.unique(h) for h in hashes]
                cols = [pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in hashes], np.uint64).view(np.int64))]
            else:
                cols = [pa.array(np.array([majority(h[:, None])[0] for h in hashes], np.uint64).view(np.int64))]
            if wide or sets:
                cols.append(pa.array([majority(mixed(h)).tobytes() for h in hashes], pa.binary()))
                cols.append(pa.array([np.unique(h)[:SKETCH].view(np.int64) for h in hashes], pa.list_(pa.int64())))
            if sets:
                cols += [pa.array([len(h) for h in hashes], pa.int64()), ids_of(b, "__text")]
            yield pa.RecordBatch.from_arrays([*(ids_of(b, c) for c in own), *cols], [*own, *names])

    return read.mapInArrow(run, schema)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that cover the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within the radius among the rows of a (b: between a and b), without every pair: one from each row of a tile to the least of its own component in a tile pair. Links are row numbers of a and of b (or a)."""
    out = []
    weight = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    at_a = np.argsort(weight(a), kind="stable")
    at_b = at_a if b is None else np.argsort(weight(b), kind="stable")
    same = b is None
    a, b = a[at_a], a[at_a] if same else b[at_b]
    pa_, pb = weight(a), weight(b)
    for i in range(0, len(a), TILE):
        x, lo, hi = a[i : i + TILE], pa_[i], pa_[min(i + TILE, len(a)) - 1]
        for j in range(i if same else 0, len(b), TILE):
            if pb[j] > hi + radius:
                break
            if pb[min(j + TILE, len(b)) - 1] < lo - radius:
                continue
            y = b[j : j + TILE]
            apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
            for w in range(1, a.shape[1]):
                apart += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
            near = apart <= radius
            if same and i == j:
                np.fill_diagonal(near, False)
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(rows):
                continue
            sub = near[np.ix_(rows, cols)]
            u, v = at_a[i + rows], at_b[j + cols]
            # The least row that each side can reach, until it settles; then one link a row or column to where it got that from.
            label = np.arange(len(rows))
            big = len(rows)
            first = True
            while True:
                col_from = np.where(sub, label[:, None], big).argmin(axis=0)
                col = label[col_from]
                row_from = np.where(sub, col[None, :], big).argmin(axis=1)
                new = np.minimum(label, col[row_from])
                if first:
                    first = False
                    out.append((u[col_from], v))
                    out.append((u, v[row_from]))
                k = np.flatnonzero(new < label)
                if not len(k):
                    break
                out.append((u[k], v[row_from[k]]))
                out.append((u[col_from], v))
                label = new
    return out


KEYS = ["block", "value", "t1", "t2"]


def compared(dealt: DataFrame, radius: int, content: str = "fp") -> DataFrame:
    """(u, v): links within the groups of KEYS. dealt: KEYS, side (0 or 1, of a pair of tiles), fp and content, what is compared (fp itself or a wide fingerprint)."""
    cols = list(dict.fromkeys([*KEYS, "side", "fp", content]))
    ordered = dealt.select(*cols).repartition(*KEYS).sortWithinPartitions(*KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, KEYS):
            fp, side = rows.column("fp").to_numpy(), rows.column("side").to_numpy()
            x = fp.view(np.uint64)[:, None] if content == "fp" else np.frombuffer(b"".join(rows.column(content).to_pylist()), np.uint64).reshape(len(fp), -1)
            if key[2] == key[3]:
                left = right = np.arange(len(fp))
                found = forest(x, None, radius)
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                found = forest(x[left], x[right], radius)
            if found:
                u, v = fp[left[np.concatenate([p for p, _ in found])]], fp[right[np.concatenate([p for _, p in found])]]
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return ordered.mapInArrow(run, "u long, v long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints (column fp) within the radius of each other."""
    each = fps.select("fp").distinct()
    pieces = F.array(*[F.struct(F.lit(i).cast("int").alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1).cast("long")).alias("value")) for i, (s, w) in enumerate(blocks(radius))])
    laid = stored(each.select("fp", F.explode(pieces).alias("b")).select("fp", "b.block", "b.value"), "blocks")
    full = laid.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / DEALT).cast("int"))
    near = laid.join(full, ["block", "value"]).withColumn("pc", F.bit_count("fp"))
    one = near.where("tiles = 1").select("block", "value", F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(0).alias("side"), "fp")
    # A large bucket: tiles are (population count, part); a tile meets the tiles within the radius of its population count.
    many = near.where("tiles > 1").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.col("pc") - radius, F.col("pc") + radius))).where("other BETWEEN 0 AND 64").withColumn("second", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mine, theirs = F.col("pc") * 65536 + F.col("part"), F.col("other") * 65536 + F.col("second")
    many = many.select("block", "value", F.least(mine, theirs).alias("t1"), F.greatest(mine, theirs).alias("t2"), F.when(mine <= theirs, 0).otherwise(1).alias("side"), "fp")
    return compared(one.unionByName(many), radius)


def tiled(rows: DataFrame, similar: float | None = None) -> DataFrame:
    """rows (value, fp, size and more) by KEYS and side: what has to meet within each value. Values of over DEALT rows are dealt as pairs of tiles; similar: only of tiles whose sizes allow that similarity."""
    rest = [c for c in rows.columns if c != "value"]
    ranks = F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(1.000001 / similar))).cast("int") if similar else F.lit(0)
    ranked = rows.withColumn("rank", ranks)
    parts = ranked.groupBy("value", "rank").agg(F.count("*").alias("n"))
    total = parts.groupBy("value").agg(F.sum("n").alias("all")).where("all > 1")
    parts = parts.join(total, "value").select("value", "rank", "all", F.ceil(F.col("n") / DEALT).cast("int").alias("tiles"))
    near = ranked.join(parts, ["value", "rank"]).withColumn("block", F.lit(-1))
    one = near.where(F.col("all") <= DEALT).select("block", "value", F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).alias("side"), *rest)
    large = parts.where(F.col("all") > DEALT)
    theirs = large.select(F.col("value").alias("v2"), F.col("rank").alias("other"), F.col("tiles").alias("others"))
    mates = large.select("value", "rank").join(theirs, (F.col("value") == F.col("v2")) & F.col("other").between(F.col("rank") - 1, F.col("rank") + 1)).select("value", "rank", "other", "others")
    many = near.where(F.col("all") > DEALT).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).join(mates, ["value", "rank"]).withColumn("second", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    number = lambda rank, part: F.shiftleft(F.col(rank).cast("long"), 32) + F.col(part)
    many = many.withColumns({"m1": number("rank", "part"), "m2": number("other", "second")})
    many = many.select("block", "value", F.least("m1", "m2").alias("t1"), F.greatest("m1", "m2").alias("t2"), F.when(F.col("m1") <= F.col("m2"), 0).otherwise(1).alias("side"), *rest)
    return one.unionByName(many)


def wide_links(fps: DataFrame, radius: int, similar: float | None = None) -> DataFrame:
    """(u, v): links between fingerprints (fp, wide, sketch; with similar also size) whose wide ones are within the radius and that share a least shingle hash."""
    size = F.col("size") if similar else F.lit(1).alias("size")
    laid = stored(fps.select("fp", "wide", size, F.explode("sketch").alias("value")), "sketches")
    return compared(tiled(laid, similar), radius, "wide")


def alike(texts: list[bytes | None], wide: np.ndarray, side: np.ndarray | None, shingle: int, similar: float, reach: int) -> list[tuple[int, int]]:
    """Links that connect the texts whose sets of shingle hashes have the similarity, among those within reach (side: only between its 0 and 1)."""
    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
    sizes = np.array([len(x) for x in sets], np.int64)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    held, label, out = np.zeros(len(names), bool), np.arange(len(sets)), []
    for i in range(len(sets)) if side is None else np.flatnonzero(side == 0):
        near = np.bitwise_count(wide ^ wide[i]).sum(axis=1, dtype=np.int64) <= reach
        near &= (np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i])) & (label != label[i]) & (sizes > 0)
        if side is not None:
            near &= side == 1
        else:
            near[:i] = False
        js = np.flatnonzero(near)
        if not len(js):
            continue
        held[own[i]] = True
        both = np.add.reduceat(held[np.concatenate([own[j] for j in js])], np.concatenate([[0], np.cumsum(sizes[js])[:-1]]), dtype=np.int64)
        held[own[i]] = False
        for j in js[both >= similar * (sizes[js] + sizes[i] - both) - 1e-9].tolist():
            if label[j] != label[i]:
                out.append((int(i), j))
                label[label == label[j]] = label[i]
    return out


def verified(near: DataFrame, shingle: int, similar: float, reach: int) -> DataFrame:
    """(u, v): links by exact sets of shingles within each value of near (value, fp, size, wide, text)."""
    ordered = tiled(near, similar).drop("size").repartition(*KEYS).sortWithinPartitions(*KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, KEYS):
            fp = rows.column("fp").to_numpy()
            wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(len(fp), -1)
            side = None if key[2] == key[3] else rows.column("side").to_numpy()
            found = alike([x.encode() for x in rows.column("text").to_pylist()], wide, side, shingle, similar, reach)
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

    return ordered.mapInArrow(run, "u long, v long")


def linked(marked: DataFrame, least: Column, shingle: int, radius: int, wide: int | None, similar: float | None) -> DataFrame:
    """(fp, copies, root, first): every fingerprint with its rows, its component and the component's least value of an expression over marked."""
    more = [F.min(F.struct("wide", "sketch")).alias("w")] if wide is not None and similar is None else []
    if similar is not None:
        more = [F.min(F.struct("wide", "sketch", "size")).alias("w")]
    fps = stored(marked.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("copies"), *more), "distinct")
    if similar is not None:
        reach = max(wide or 0, REACH)
        groups = stored(components(wide_links(fps.select("fp", "w.*"), reach, similar)), "groups")
        texts = marked.join(small(groups.select(F.col("node").alias("fp"), F.col("root").alias("value"))), "fp").groupBy("fp", "value").agg(F.first("size").alias("size"), F.first("wide").alias("wide"), F.first("body").alias("text"))
        edges = verified(stored(texts, "texts"), shingle, similar, reach)
    else:
        edges = links(fps, radius)
        if wide is not None:
            edges = edges.unionByName(wide_links(fps.select("fp", "w.wide", "w.sketch"), wide))
    roots = components(edges)
    tied = stored(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "tied")
    ids = tied.groupBy("root").agg(F.min("least").alias("first"))
    return tied.join(ids, "root").select("fp", "copies", "root", "first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, wide: int | None = None, similar: float | None = None) -> DataFrame:
    """A row for each row of docs: key, fp, component_id (least key reachable) and copies (rows of the same fingerprint). wide: a radius on wide fingerprints, links by which count too.

    similar: instead of by fingerprints, texts are linked by that similarity of their exact sets of shingles; fp is then a hash of the set, and wide (or REACH, if that is more) the radius of candidates.
    """
    read = numbered_columns(docs, [key], text=F.col(f"`{text}`"))
    marked = stored(fingerprints(read, "text", ["c0"], shingle, wide is not None, similar is not None), "fingerprints")
    named = linked(marked, F.col("c0"), shingle, radius, wide, similar).select("fp", "copies", F.col("first").alias("component_id"))
    return marked.select("c0", "fp").join(named, "fp").select(F.col("c0").alias(key), "fp", "component_id", "copies")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 3, wide: int | None = 46, similar: float | None = None) -> DataFrame:
    """docs without near duplicates: of each component the row of the least key stays (keys before nulls), of rows of one key the one whose content hashes least, and of equal rows one.

    Rows are told apart by all their columns, not by the key: different texts under one key, or without a key, are no
    duplicates by that. Columns of any name (but `__k1` and `__k2`) and texts of any length are kept as they are; texts
    without a shingle are one component; an empty table gives no rows.
    """
    keyed = docs.withColumns({"__k1": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), "__k2": F.xxhash64(F.lit(0x5BD1E995), *[F.col(f"`{c}`") for c in docs.columns], F.lit(1))})
    read = keyed.select(F.col("__k1").alias("c0"), F.col("__k2").alias("c1"), F.col(f"`{key}`").alias("c2"), F.col(f"`{text}`").alias("text"))
    marked = stored(fingerprints(read, "text", ["c0", "c1", "c2"], shingle, wide is not None, similar is not None), "fingerprints")
    rows = linked(marked, F.struct(F.col("c2").isNull().alias("none"), F.col("c2").alias("key"), F.col("c0").alias("k1"), F.col("c1").alias("k2")), shingle, radius, wide, similar)
    stay = stored(rows.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2")).distinct(), "stay")
    twice = stored(marked.groupBy(F.col("c0").alias("__k1"), F.col("c1").alias("__k2")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    # Only rows that have an equal one are brought together; where the lists are small, no other text moves.
    left, keys = keyed.join(small(stay), ["__k1", "__k2"], "left_semi"), ["__k1", "__k2"]
    alone = left.join(small(twice), keys, "left_anti")
    return alone.unionByName(left.join(small(twice), keys, "left_semi").dropDuplicates(keys)).select(*[F.col(f"`{c}`") for c in docs.columns])
