"""Line-first quality rules.

Every line of a text is held against punctuation, navigation, boilerplate, symbol and capitals rules; lines that
fail are taken out, and a document that loses too much of its text that way is rejected.

Defined cases: a null text has no words and is rejected by the base rule (fewer words than `min_words`); empty and
blank texts likewise. A text of any length is judged whole, in memory in proportion to it; an empty table gives no
rows; there are no ties, as each text is judged by itself. Repeated rows are judged alike, each on its own. Other columns pass
through untouched, and columns of the input that have the name of a result column are replaced; no other can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import ids_of, numbered_columns, own_arrays, own_fields, slices

SYMBOLS = "#*$%&|<>"
#: A line of text ends in one of these, perhaps inside closing marks.
ENDS = re.compile(r"[.!?:;…。！？؟।][\"'\)\]”’»›]*\s*$")
NAVIGATION = re.compile(r"\s[|»›•·>]\s.*\s[|»›•·>]\s|^\s*(?:home|menu|next|previous|back|login|log in|sign in|sign up|subscribe|share|read more|skip to content|contact us|about us|search)\s*[>|»]*\s*$", re.I)
BOILERPLATE = re.compile(r"lorem ipsum|enable javascript|javascript (?:is|must be)|cookie(?:s)? policy|privacy policy|terms of (?:use|service)|all rights reserved|©|licensed under|copyright \(c\)|accept (?:all )?cookies", re.I)
LINE_FIELDS = ("n_lines", "n_lines_failed", "kept_chars")


@dataclass(frozen=True)
class LineRules:
    """Production values. min_kept: the share of a text's word characters that must be left."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_kept: float = 0.5
    max_symbols_per_word: float = 0.3
    max_upper: float = 0.7
    max_copies: int = 2


def base(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    if not text:
        return 0, 0, 0, 0, 0, []
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        windows = lambda: zip(words, words[1:], words[2:])  # noqa: E731  made anew rather than held: a text may be long
        counts = Counter(windows())
        if len(counts) < n - 2:
            hit = bytearray(n)
            for i, w in enumerate(windows()):
                if counts[w] > 1:
                    hit[i : i + 3] = b"\1\1\1"
            repeated = hit.count(1)
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, words


def line_passes(line: str, rules: LineRules) -> bool:
    """Whether a line with words reads as running text."""
    words = line.split()
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols_per_word * len(words):
        return False
    upper = sum(map(str.isupper, line))
    if upper >= 8 and upper > rules.max_upper * sum(map(str.isalpha, line)):
        return False
    if not ENDS.search(line):
        return False
    return not NAVIGATION.search(line) and not BOILERPLATE.search(line)


def judge(text: str | None, rules: LineRules = LineRules()) -> dict:
    """All result columns of one text."""
    n, chars, symbols, dups, repeated, _ = base(text)
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    kept_chars = lines = bad = 0
    seen: Counter = Counter()
    for line in (text or "").split("\n"):
        if not line or line.isspace():
            continue
        lines += 1
        seen[line] += 1
        if seen[line] <= rules.max_copies and line_passes(line, rules):
            kept_chars += len(line) - sum(map(str.isspace, line))
        else:
            bad += 1
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeated, "base_failed": failed, "kept": not failed and kept_chars >= rules.min_kept * chars, "n_lines": lines, "n_lines_failed": bad, "kept_chars": kept_chars}


def clean(text: str, rules: LineRules = LineRules()) -> str:
    """The text without the lines that fail; blank lines stay."""
    seen: Counter = Counter()
    out = []
    for line in text.split("\n"):
        seen[line] += 1
        if not line or line.isspace() or (seen[line] <= rules.max_copies and line_passes(line, rules)):
            out.append(line)
    return "\n".join(out)


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_lines", "long"), ("n_lines_failed", "long"), ("kept_chars", "long")]


def judged(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), keep_columns: list[str] | None = None) -> DataFrame:
    """docs with the result columns. keep_columns: the columns to carry along (all); the text is read once, in one narrow pass."""
    names = [n for n, _ in FIELDS]
    carried = [c for c in (docs.columns if keep_columns is None else keep_columns) if c not in names]
    read = numbered_columns(docs, carried, text=F.col(f"`{text}`"))
    schema = T.StructType(own_fields(docs, carried) + [T.StructField(n, T.LongType() if k == "long" else T.BooleanType()) for n, k in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [judge(t, rules) for t in ids_of(b, "text").to_pylist()]
            cols = own_arrays(b, len(carried))
            cols += [pa.array([r[n] for r in rows], pa.int64() if k == "long" else pa.bool_()) for n, k in FIELDS]
            yield pa.RecordBatch.from_arrays(cols, [*carried, *names])

    return read.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    clash = {n: f"__own_{n}" for n, _ in FIELDS if n in docs.columns}
    safe = docs.withColumnsRenamed(clash)
    out = judged(safe, clash.get(text, text), rules).where("kept").select(*[F.col(f"`{c}`") for c in safe.columns])
    return out.withColumnsRenamed({v: k for k, v in clash.items()})
