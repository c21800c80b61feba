"""A run-length index over a repetitive collection of strings.

The suffixes of the collection are sorted once and its Burrows-Wheeler transform is cut into runs. What is kept is the
run-compressed transform alone: where each run starts, its symbol, the row to which the LF step takes its first row
(symbols before it and equal ones in earlier runs, added up over runs), and a sample for each end of a run: the length
that its first row shares with the row above, and its last row with the row below. No suffix array and no text stays.

Matching statistics are streamed: every string enters at the row of its end mark and is walked to its start by LF steps,
all strings side by side. Inside a run the step keeps neighbours together, so the longest match elsewhere of a position
whose row is no end of a run is that of the position to its left, less one; at ends of runs the samples give it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class RunIndex:
    n: int  # symbols, marks included
    symbols: np.ndarray  # of the runs; 0 for a mark, which is a run of its own
    starts: np.ndarray  # first rows of the runs, in order
    base: np.ndarray  # where the LF step takes these rows
    head_match: np.ndarray  # length that a run's first row shares with the row above
    tail_match: np.ndarray  # length that a run's last row shares with the row below
    ends: np.ndarray  # rows of the strings' end marks
    lengths: np.ndarray  # of the strings

    @property
    def n_runs(self) -> int:
        return len(self.starts)

    def step(self, rows: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The LF step: rows of the suffixes that are one symbol longer."""
        return self.base[runs] + (rows - self.starts[runs])

    def matching_statistics(self) -> np.ndarray:
        """For every position of the collection (a string, its mark, the next string) the length of its longest match that starts anywhere else."""
        first = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        lasts = np.append(self.starts[1:], self.n) - 1
        by = np.argsort(-self.lengths, kind="stable")  # long strings first: those still on their way are a prefix
        left = np.searchsorted(-self.lengths[by], -np.arange(self.lengths.max(initial=0)), side="left")
        run_of = np.repeat(np.arange(self.n_runs, dtype=np.int32), np.diff(np.append(self.starts, self.n)))  # rank over runs, by row while streaming
        rows, at = self.ends[by], (first + self.lengths)[by]
        runs = run_of[rows]
        reach = np.full(self.n, -1, np.int64)
        for k in left.tolist():
            rows = self.step(rows[:k], runs[:k])
            runs = run_of[rows]
            at = at[:k] - 1
            head, tail = rows == self.starts[runs], rows == lasts[runs]
            best = np.maximum(np.where(head, self.head_match[runs], -1), np.where(tail, self.tail_match[runs], -1))
            some = np.flatnonzero(best >= 0)
            reach[at[some]] = at[some] + best[some]
        # A string's first symbol follows a mark, so it is an end of a run; no match passes a mark.
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)


def suffix_ranks(codes: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], int]:
    """The suffix array, the ranks by prefixes of growing length, and by how much that grows. codes: of the symbols, 0 for a mark; each mark is a symbol of its own, in order of place, so no two suffixes are equal and none matches past a mark."""
    n, pack = len(codes), 1
    key = codes.astype(np.int64)
    while 2 * pack * bits <= 63:
        key = np.append(key << (pack * bits), np.zeros(pack, np.int64))[:n] | np.append(key[pack:], np.zeros(pack, np.int64))[:n]
        pack *= 2
    marks = np.flatnonzero(codes == 0)
    open_ = np.ones(n, bool)
    for j in range(min(pack, n)):  # j symbols before a mark: what comes after the mark goes
        at = marks[marks >= j] - j
        at = at[open_[at]]
        key[at] = key[at] >> ((pack - j) * bits) << ((pack - j) * bits) if j else 0
        open_[at] = False
    order = np.argsort(key, kind="stable")  # prefixes that end in a mark are put in order by it, which is by place
    new = np.empty(n, bool)
    new[:1] = True
    key = key[order]
    new[1:] = (key[1:] != key[:-1]) | ~open_[order[1:]]
    # A rank is the number of suffixes before its class, so that classes split in place.
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begin
    alone = new & np.append(new[1:], True)
    todo = order[~alone]
    ways, width = (3, 21) if n < (1 << 21) - 1 else (2, 31)
    k, levels = pack, [(pack, rank.astype(np.int32))]
    while len(todo):
        pair = rank[todo]
        for i in range(1, ways):
            at = todo + i * k
            pair = (pair << width) | np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        by = np.argsort(pair)
        todo, pair = todo[by], pair[by]
        fresh = np.empty(len(todo), bool)
        fresh[0] = True
        fresh[1:] = pair[1:] != pair[:-1]
        old = rank[todo]
        first = np.empty(len(todo), bool)
        first[0] = True
        first[1:] = old[1:] != old[:-1]
        place = np.arange(len(todo))
        rank[todo] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        todo = todo[~(fresh & np.append(fresh[1:], True))]
        k *= ways
        levels.append((k, rank.astype(np.int32)))
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, levels, ways


def shared(a: np.ndarray, b: np.ndarray, codes: np.ndarray, levels: list[tuple[int, np.ndarray]], ways: int) -> np.ndarray:
    """Lengths that the suffixes at a and at b have in common."""
    n, pack = len(codes), levels[0][0]
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        for _ in range(ways - 1):
            same = np.flatnonzero((a < n) & (b < n) & (a != b) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]))
            if not len(same):
                break
            out[same] += k
            a[same] += k
            b[same] += k
    live = np.arange(len(a))
    for _ in range(pack - 1):
        live = live[(a[live] < n) & (b[live] < n)]
        live = live[(codes[a[live]] == codes[b[live]]) & (codes[a[live]] > 0)]
        out[live] += 1
        a[live] += 1
        b[live] += 1
    return out


def build(strings: list[bytes]) -> tuple[RunIndex, np.ndarray]:
    """The index of the strings, each followed by a mark, and where each starts in the collection."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    marks = first + lengths
    used = np.bincount(text, minlength=256) > 0
    code = np.cumsum(used)
    codes = code[text]
    codes[marks] = 0
    sa, levels, ways = suffix_ranks(codes, int(code[-1]).bit_length())
    before = codes[sa - 1]  # that of the first suffix is the last mark
    change = (before[1:] != before[:-1]) | (before[1:] == 0)
    starts = np.flatnonzero(np.concatenate([[True], change]))
    lasts = np.append(starts[1:], len(sa)) - 1
    symbols, size = before[starts], np.diff(np.append(starts, len(sa)))
    by = np.argsort(symbols, kind="stable")
    base = np.empty(len(starts), np.int64)
    base[by] = np.cumsum(size[by]) - size[by]
    head_match, tail_match = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    # The row above a run's first row is the last one of the run before.
    head_match[1:] = shared(sa[lasts[:-1]], sa[starts[1:]], codes, levels, ways)
    tail_match[:-1] = head_match[1:]
    ends = levels[-1][1][marks].astype(np.int64)
    return RunIndex(len(sa), symbols, starts, base, head_match, tail_match, ends, lengths), first
