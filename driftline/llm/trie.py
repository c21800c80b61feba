"""An n-gram trie in Elias-Fano levels.

A level is one monotone sequence: parent number times 2^40 plus the 40-bit name of the word that follows, so a node's
successors lie together and are named relative to their context. Low bits are packed, high bits are coded in unary;
the ranges of the children are monotone pointers, coded the same way. Probabilities are 8-bit codes on a log scale.
A query walks down: at each level a successor search inside the context's range tells whether the word is there.
All levels stand in one buffer of bytes that can be saved, mapped into memory and read in place.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

#: Bits of a word's name below its context.
NAME = 40
#: Smallest log10 that a code holds; code 0 is "none", 255 is probability 1.
FLOOR = -12.0


def quantise(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities."""
    with np.errstate(divide="ignore"):
        code = np.rint(255 + np.log10(p) * 254 / -FLOOR)
    return np.where(p > 0, np.clip(np.nan_to_num(code, neginf=1), 1, 255), 0).astype(np.uint8)


VALUES = np.concatenate([[0.0], 10.0 ** ((np.arange(1, 256) - 255) * -FLOOR / 254)])


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        bits = np.unpackbits(high, bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        #: first[h]: how many numbers have high bits below h
        self.first = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray, most: int) -> EliasFano:
        """values, of which none is above most."""
        n = len(values)
        low_bits = max(0, (int(most) // max(n, 1)).bit_length() - 1)
        buckets = (int(most) >> low_bits) + 1
        high = np.zeros(-(-(n + buckets) // 8) * 8, np.uint8)
        high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high[n + buckets :] = 1  # no bucket past the last one
        return cls(n, low_bits, pack(values & np.uint64((1 << low_bits) - 1), low_bits), np.packbits(high, bitorder="little"))

    def lows(self, at: np.ndarray) -> np.ndarray:
        return unpack(self.low, self.low_bits, at)

    def values(self) -> np.ndarray:
        reps = np.diff(np.append(self.first, self.n))[: len(self.first)]
        return (np.repeat(np.arange(len(self.first), dtype=np.uint64), reps) << np.uint64(self.low_bits)) | self.lows(np.arange(self.n))

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that is not below x (inside begin to end, where given), and whether it is x."""
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = h < len(self.first) - 1
        h = np.minimum(h, len(self.first) - 2)
        lo, hi = self.first[h], self.first[h + 1]
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        stop = np.maximum(lo, hi)
        lo, hi = lo.copy(), stop.copy()
        key = x & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.lows(mid) < key[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        found = inside & (lo < stop)
        at = np.flatnonzero(found)
        found[at] = self.lows(lo[at]) == key[at]
        return lo, found

    def parts(self) -> list[bytes]:
        return [struct.pack("<qq", self.n, self.low_bits), self.low.tobytes(), self.high.tobytes()]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """values of width bits each, in a row of 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        bit = np.arange(len(values), dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero((shift.astype(np.int64) + width) > 64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << width) - 1)


class Trie:
    """levels[0] holds words by their 64-bit hashes, levels[k] the words after k words. counts: of the words (exact); share[k]: codes of the discounted probabilities (k >= 1), rest[k]: codes of the weight that a context leaves to shorter ones (all but the last level)."""

    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], counts: np.ndarray, share: list[np.ndarray], rest: list[np.ndarray]):
        self.levels, self.pointers, self.counts, self.share, self.rest = levels, pointers, counts, share, rest
        self.ranges = [p.values().astype(np.int64) for p in pointers]

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, below: list[tuple[np.ndarray, np.ndarray]], discount: float = 0.75) -> Trie:
        """words: sorted hashes. below: for each further level sorted keys (parent number << NAME | name) and their counts."""
        levels, pointers, share, rest = [EliasFano.of(words, int(words[-1]) if len(words) else 0)], [], [], []
        n = len(words)
        for keys, c in below:
            parent = (keys >> np.uint64(NAME)).astype(np.int64)
            total = np.bincount(parent, weights=c, minlength=n)
            kinds = np.bincount(parent[c > 0], minlength=n)
            with np.errstate(divide="ignore", invalid="ignore"):
                rest.append(np.where(total > 0, quantise(np.where(total > 0, discount * kinds / total, 1.0)), np.uint8(255)))
                share.append(quantise(np.where(c > 0, (c - discount) / total[parent], 0.0)))
            ends = np.cumsum(np.bincount(parent, minlength=n))
            pointers.append(EliasFano.of(np.concatenate([[0], ends]).astype(np.uint64), len(keys)))
            levels.append(EliasFano.of(keys, int(keys[-1]) if len(keys) else 0))
            n = len(keys)
        return cls(levels, pointers, counts.astype(np.uint64), share, rest)

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 where there is none."""
        if not self.levels[0].n:
            return np.full(len(hashes), -1, np.int64)
        at, ok = self.levels[0].successor(hashes)
        return np.where(ok, at, -1)

    def find_after(self, level: int, parent: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Numbers of the nodes of a level by parent (-1: none) and name, by a search inside the context's range."""
        out = np.full(len(parent), -1, np.int64)
        at = np.flatnonzero(parent >= 0)
        if len(at) and self.levels[level].n:
            p, r = parent[at], self.ranges[level - 1]
            where, ok = self.levels[level].successor((p.astype(np.uint64) << np.uint64(NAME)) | names[at], r[p], r[p + 1])
            out[at] = np.where(ok, where, -1)
        return out

    def to_bytes(self) -> bytes:
        arrays = [x for e in (*self.levels, *self.pointers) for x in e.parts()] + [self.counts.tobytes(), *(x.tobytes() for x in self.share), *(x.tobytes() for x in self.rest)]
        head = struct.pack("<qq", len(self.levels), len(arrays)) + struct.pack(f"<{len(arrays)}q", *map(len, arrays))
        return head + b"".join(a + b"\0" * (-len(a) % 8) for a in arrays)

    @classmethod
    def read(cls, buffer) -> Trie:
        """The trie that stands in a buffer, such as a mapped file; its arrays are views of it."""
        view = memoryview(buffer)
        n, m = struct.unpack_from("<qq", view)
        sizes = struct.unpack_from(f"<{m}q", view, 16)
        at, found = 16 + 8 * m, []
        for s in sizes:
            found.append(view[at : at + s])
            at += s + -s % 8
        coded = []
        for i in range(2 * n - 1):
            head, low, high = found[3 * i : 3 * i + 3]
            coded.append(EliasFano(*struct.unpack("<qq", head), np.frombuffer(low, np.uint64), np.frombuffer(high, np.uint8)))
        left = found[3 * (2 * n - 1) :]
        codes = [np.frombuffer(x, np.uint8) for x in left[1:]]
        return cls(coded[:n], coded[n:], np.frombuffer(left[0], np.uint64), codes[: n - 1], codes[n - 1 :])

    def mapped(self) -> Trie:
        """The same trie in an anonymous mapping, where the system can page it."""
        raw = self.to_bytes()
        held = mmap.mmap(-1, len(raw))
        held.write(raw)
        return Trie.read(held)
