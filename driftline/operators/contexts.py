"""Occurrences and their contexts: spans, dictionary matches, masked contexts and token windows."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import text as tx
from driftline.session import small

MASK = "[MASK]"
_WORD = re.compile(r"[^\W\d_](?:[\w'\-]*[^\W\d_])?")
_PIECE = re.compile(r"[^ \t\n\r\f\x0B]+")
SPANS = "array<struct<token:string,begin:int,end:int>>"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]


#: Bytes of text of which spans, and of which contexts, are held at once (contexts take up to a hundred times as many).
SPANS_OF, CONTEXTS_OF = 1 << 20, 1 << 16


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in portions of about `most` bytes of text, one text at least, with the texts (null: empty)."""
    for batch in batches:
        column = batch.column("text")
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at), [t or "" for t in column.slice(at, to - at).to_pylist()]
            at = to


def token_spans(texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The columns of texts with token, begin, end: a row for each word (only: for these words) and its place in the text. Python holds the spans of one portion of text; they become rows in the JVM."""
    wanted = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in _portions(batches, SPANS_OF):
            words, places, cuts = [], array("i"), [0]
            for t in own:
                for m in _WORD.finditer(t):
                    w = m[0].lower()
                    if wanted is None or w in wanted:
                        words.append(w)
                        places.extend(m.span())
                cuts.append(len(words))
            at = np.frombuffer(places, np.int32).reshape(-1, 2) if words else np.zeros((0, 2), np.int32)
            spans = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(at[:, 0]), pa.array(at[:, 1])], ["token", "begin", "end"])
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)], [*batch.schema.names, "__spans"])

    found = texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("__spans", T.ArrayType(T.StructType.fromDDL("token string, begin int, end int")))]))
    return found.select(*texts.columns, F.explode("__spans").alias("s")).select(*texts.columns, "s.token", "s.begin", "s.end")


def contexts_of(text: str, shortest: int = 1, least: int = 7, side: int = 32) -> Iterator[tuple[str, int, int, str]]:
    """(token, begin, end, context) of a text's words of `shortest` characters or more; context as in contexts(). The text is cut once at white space: a sentence ends with a piece that ends in .!?, and a word lies inside one piece."""
    cut = [(m.start(), m.end()) for m in _PIECE.finditer(text)]
    pieces = [text[a:z] for a, z in cut]
    last = len(pieces) - 1
    ends = [i for i, p in enumerate(pieces) if p[-1] in ".!?"]
    i = e = 0  # the piece, and the first end at or behind it
    for m in _WORD.finditer(text):
        begin, end = m.span()
        if end - begin < shortest:
            continue
        while cut[i][1] < end:
            i += 1
        while e < len(ends) and ends[e] < i:
            e += 1
        before, after = text[cut[i][0] : begin], text[end : cut[i][1]]
        first, to = ends[e - 1] + 1 if e else 0, ends[e] if e < len(ends) else last
        if to - first + 1 < least:
            first, to = 0, last
        left = pieces[max(first, i - side + bool(before)) : i]
        right = pieces[i + 1 : min(to, i + side - bool(after)) + 1]
        yield m[0].lower(), begin, end, " ".join([*left, *([before] if before else []), MASK, *([after] if after else []), *right])


def text_contexts(texts: DataFrame, shortest: int = 1) -> DataFrame:
    """The columns of texts (but text) with token, begin, end and context of each word of `shortest` characters or more: token_spans and contexts in one pass, so that no text travels with each of its words."""
    own = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in _portions(batches, CONTEXTS_OF):
            found = [list(contexts_of(t, shortest)) for t in some]
            of = pa.array(np.repeat(np.arange(len(some)), [len(x) for x in found]))
            token, begin, end, context = zip(*[r for x in found for r in x]) if len(of) else ((), (), (), ())
            made = [pa.array(token, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(context, pa.string())]
            yield pa.record_batch([*[batch.column(f.name).take(of) for f in own], *made], [*[f.name for f in own], "token", "begin", "end", "context"])

    return texts.mapInArrow(run, T.StructType([*own, *T.StructType.fromDDL("token string, begin int, end int, context string").fields]))


def dict_matches(texts: DataFrame, terms: list[str]) -> DataFrame:
    """All matches of a term list (several words a term allowed), overlapping ones included: the character before and the one after is no letter or digit."""
    import ahocorasick

    own = sorted({t.lower() for t in terms if t})

    @F.pandas_udf(SPANS)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = ahocorasick.Automaton()
        for t in own:
            a.add_word(t, t)
        if own:
            a.make_automaton()

        def one(text: str | None) -> list[dict]:
            low, out = (text or "").lower(), []
            for last, term in a.iter(low) if own else ():
                begin = last - len(term) + 1
                if not (begin and low[begin - 1].isalnum()) and not (last + 1 < len(low) and low[last + 1].isalnum()):
                    out.append({"token": term, "begin": begin, "end": last + 1})
            return sorted(out, key=lambda x: (x["begin"], x["end"]))

        for s in parts:
            yield s.map(one)

    return texts.select("*", F.explode(find("text")).alias("s")).select(*texts.columns, "s.token", "s.begin", "s.end")


#: Characters beside an occurrence that nearly always hold its context.
NEAR = 600


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, tx.SPACE, " "))


def _n_words(text: Column) -> Column:
    """Words of a squeezed text."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def contexts(occurrences: DataFrame, least: int = 7, side: int = 32) -> DataFrame:
    """Occurrences (text, begin, end) with context: the sentence around one (the whole text, where it has under `least` words) with that occurrence masked and at most `side` words on each side; words and mask stand apart by one space. drop_reason is mask_lost where the place is not in the text.

    A sentence ends after a run of .!? that white space or the end of the text follows. All of it stays inside the JVM,
    in steps, so that each part is worked out once. Only NEAR characters on each side are looked at where they hold more
    words than a context takes; else the whole side.
    """
    text, begin, end = (F.col(c) for c in ("text", "begin", "end"))
    inside = (begin >= 0) & (begin < end) & (end <= F.length(text))
    enough = lambda part: _n_words(_squeezed(part)) > max(side, least) + 1  # noqa: E731  the word at the cut may be a part
    out = occurrences.withColumns({"__last": F.substring(text, F.greatest(begin - NEAR, F.lit(0)) + 1, F.least(begin, F.lit(NEAR))), "__first": F.substring(text, end + 1, F.lit(NEAR)), "__own": F.substring(text, begin + 1, end - begin)})
    out = out.withColumns({"__l": F.when(enough(F.col("__last")), F.col("__last")).otherwise(F.substring(text, F.lit(1), begin)), "__r": F.when(enough(F.col("__first")), F.col("__first")).otherwise(F.substring(text, end + 1, F.length(text)))})
    space = r"[ \t\n\r\f\x0B]"
    out = out.withColumns({"__nl": F.regexp_replace("__l", rf"(?s)^.*[.!?](?={space})", ""), "__nr": F.regexp_extract("__r", rf"(?s)^(.*?[.!?]+)(?={space}|\z)", 1)})
    out = out.withColumn("__nr", F.when(F.col("__nr") == "", F.col("__r")).otherwise(F.col("__nr")))
    out = out.withColumn("__sentence", _squeezed(F.concat("__nl", "__own", "__nr"))).withColumn("__whole", _n_words(F.col("__sentence")) < least)
    out = out.withColumns({"__b": F.split(_squeezed(F.when(F.col("__whole"), F.col("__l")).otherwise(F.col("__nl"))), " "), "__a": F.split(_squeezed(F.when(F.col("__whole"), F.col("__r")).otherwise(F.col("__nr"))), " ")})
    words = F.concat_ws(" ", F.array_join(F.slice("__b", F.greatest(F.size("__b") - side, F.lit(0)) + 1, F.lit(side)), " "), F.lit(MASK), F.array_join(F.slice("__a", F.lit(1), F.lit(side)), " "))
    out = out.withColumn("context", F.when(inside, F.trim(words)))
    return out.select(*[c for c in occurrences.columns if c not in ("context", "drop_reason")], "context", F.when(F.col("context").isNull(), "mask_lost").alias("drop_reason"))


def gated(occurrences: DataFrame, eligible: DataFrame) -> DataFrame:
    """Occurrences (token, half_year) of target words, with drop_reason before_eligible where the word was not eligible yet. The join comes before any costly scoring; the word list is broadcast where it is small by bytes, so that occurrences need no shuffle by a word."""
    own = small(eligible.select(F.col("word").alias("token"), "eligible_from"))
    return occurrences.join(own, "token").withColumn("drop_reason", F.when(F.col("half_year") < F.col("eligible_from"), "before_eligible"))


#: Runs of word characters with what belongs to them inside, or single signs.
PIECES = r"[\p{L}\p{N}_]+(?:[-'.][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"


def pieces(text: Column) -> Column:
    """Tokens of a text with punctuation set apart; hyphens, apostrophes and points inside a word stay in it."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def masked_units(texts: DataFrame, keywords: list[str], longest: int | None = 150, by_sentence: bool = False) -> DataFrame:
    """Units (records or sentences) of at most so many characters, once for each keyword in them, its first occurrence masked: record_id, half_year, unit_no, keyword, masked. Tokens are words and signs (pieces); case counts."""
    units = tx.sentences(F.col("text")) if by_sentence else F.array("text")
    out = texts.select("record_id", "half_year", F.posexplode(units).alias("unit_no", "unit"))
    if longest and longest > 0:
        out = out.where(F.length("unit") <= longest)
    out = out.withColumn("tokens", pieces(F.col("unit"))).withColumn("keyword", F.explode(F.array_intersect(F.array(*[F.lit(k) for k in sorted(set(keywords))]), F.col("tokens"))))
    at = F.array_position("tokens", F.col("keyword")).cast("int")
    masked = F.concat(F.slice("tokens", F.lit(1), at - 1), F.array(F.lit(MASK)), F.slice("tokens", at + 1, F.size("tokens")))
    return out.select("record_id", "half_year", "unit_no", "keyword", F.array_join(masked, " ").alias("masked"))


def too_long(texts: DataFrame, longest: int = 150) -> DataFrame:
    """How many units the length cap leaves out."""
    return texts.agg(F.count_if(F.length("text") > longest).alias("too_long"), F.count_if(F.length("text") <= longest).alias("kept"))


def token_window(texts: DataFrame, targets: list[str], side: int = 64) -> DataFrame:
    """For each occurrence of a target the words around it, `side` on each side."""
    t = texts.withColumn("tokens", tx.words(F.col("text")))
    out = t.select("record_id", "tokens", F.posexplode("tokens").alias("pos", "token")).where(F.col("token").isin(*targets))
    first = F.greatest(F.col("pos") - side, F.lit(0))
    return out.select("record_id", "pos", "token", F.array_join(F.slice("tokens", first + 1, F.col("pos") + side + 1 - first), " ").alias("window"))


def centred(tokens: Column, longest: int, mask: str = MASK) -> Column:
    """At most `longest` less two tokens (a model adds a mark at either end) with the mask in the middle, as far as both ends allow; without a mask the middle of the text."""
    n, budget = F.size(tokens), longest - 2
    at = F.array_position(tokens, mask).cast("int") - 1
    middle = F.when(at >= 0, at).otherwise(F.floor(n / 2).cast("int"))
    first = F.least(F.greatest(middle - budget // 2, F.lit(0)), n - budget)
    return F.when(n > budget, F.slice(tokens, first + 1, F.lit(budget))).otherwise(tokens)


def words_as_pieces(text: str) -> list[tuple[str, int, int]]:
    """A tokenizer for span_embeddings: the words of a text."""
    return spans_of(text)


class SpanEmbedder:
    """A Python model for spans: load() makes it once a worker, tokens(text) cuts a text into (piece, begin, end), hidden(model, windows) gives for each window (a list of pieces) an array of a vector for each piece."""

    def __init__(self, load: Callable[[], object], hidden: Callable[[object, list[list[str]]], list], tokens: Callable[[str], list[tuple[str, int, int]]] = words_as_pieces):
        self.load, self.hidden, self.tokens = load, hidden, tokens


def span_embeddings(occurrences: DataFrame, embedder: SpanEmbedder, side: int = 64, batch: int = 128) -> DataFrame:
    """Occurrences (text, begin, end) with embedding: the mean hidden vector of the pieces that lie in the span, in a window of `side` pieces around them; null (skipped) where no piece does."""
    load, hidden, tokens = embedder.load, embedder.hidden, embedder.tokens

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np

        model, last, cut = load(), None, []
        for text, begin, end in parts:
            out: list = [None] * len(text)
            asked: list[tuple[int, list[str], list[int]]] = []
            for i, (t, a, z) in enumerate(zip(text, begin, end)):
                if t != last:  # occurrences of a text follow each other
                    last, cut = t, tokens(t or "")
                own = [k for k, (_, p, q) in enumerate(cut) if q > a and p < z]
                if own:
                    first = max(0, own[0] - side)
                    asked.append((i, [w for w, _, _ in cut[first : own[-1] + 1 + side]], [k - first for k in own]))
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                for (i, _, own), h in zip(some, hidden(model, [w for _, w, _ in some])):
                    out[i] = np.asarray(h, float)[own].mean(axis=0).tolist()
            yield pd.Series(out, dtype=object)

    return occurrences.withColumn("embedding", run("text", "begin", "end"))


def embedding_stats(embedded: DataFrame) -> DataFrame:
    """matched, embedded and skipped occurrences, and whether they add up."""
    out = embedded.agg(F.count("*").alias("matches_found"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("skipped_no_tokens"))
    return out.withColumn("balanced", F.col("matches_found") == F.col("embedded") + F.col("skipped_no_tokens"))


def first_place(text: Column, word: Column) -> Column:
    """Where a whole word first stands in a text (1-based, 0 if nowhere), without regard to case."""
    return F.regexp_instr(text, F.concat(F.lit(r"(?i)\b"), word, F.lit(r"\b")))


def capped(rows: DataFrame, n: int, by: str = "half_year", order: tuple[str, ...] = ("record_id", "pos")) -> DataFrame:
    """The first n rows of each half-year, in the stream's order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)
