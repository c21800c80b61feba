"""Column expressions over text and time; all of them stay inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word starts and ends with a letter (or letter-like number); inside it may have letters, digits of that kind, `_`, `'` and `-`.
WORD = r"[\p{L}\p{Nl}\p{No}](?:[\p{L}\p{N}_'\-]*[\p{L}\p{Nl}\p{No}])?"
URL = r"https?://[^ \t\n\r\f\x0B]+"
SPACE = r"[ \t\n\r\f\x0B]+"
#: Bodies that stand for a text that is gone.
GONE = ("[deleted]", "[removed]")


def clean(text: Column, instead: str = "") -> Column:
    """text without URLs (or with `instead` in their place), white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, URL, instead), SPACE, " "))


def for_words(text: Column) -> Column:
    """text without URLs. It has the words of clean(text), as no word holds white space, and costs no pass over the white space."""
    return F.when(text.contains("://"), F.regexp_replace(text, URL, "")).otherwise(text)


def joined(*fields: Column) -> Column:
    """Cleaned fields, put together; null where fewer than three words are left."""
    text = F.trim(F.concat_ws(" ", *[F.nullif(clean(f), F.lit("")) for f in fields]))
    return F.when(F.size(F.split(text, " ")) >= 3, text)


def words(text: Column) -> Column:
    """The words of a text, in order, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def sentences(text: Column) -> Column:
    """A text cut after every run of .!? that white space follows; what trails behind stays."""
    return F.filter(F.split(F.regexp_replace(F.trim(text), r"([.!?]+)" + SPACE, "$1\u0001"), "\u0001"), lambda s: s != "")


def half_year(day: Column) -> Column:
    """YYYYH1 up to June, YYYYH2 after it."""
    return F.concat(F.year(day).cast("string"), F.lit("H"), F.when(F.month(day) <= 6, "1").otherwise("2"))


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_of_text(iso: Column) -> Column:
    """The month of an ISO date, "unknown" where it is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(iso, "Z$", ""), "T", " ")), "yyyy-MM"), F.lit("unknown"))


def half_year_of_month(m: Column) -> Column:
    """2014-H1 of 2014-03; "unknown" where the label is none."""
    return F.when(m.rlike(r"^\d{4}-\d{2}$"), F.concat(F.substring(m, 1, 4), F.when(F.substring(m, 6, 2).cast("int") <= 6, "-H1").otherwise("-H2"))).otherwise("unknown")


def ordinal(label: Column) -> Column:
    """The number of a half-year label, counted from year 0; null where it is no label."""
    return F.when(label.rlike(r"^\d{4}H[12]$"), F.substring(label, 1, 4).cast("int") * 2 + F.substring(label, 6, 1).cast("int") - 1)


def label(number: Column) -> Column:
    return F.concat(F.lpad(F.floor(number / 2).cast("string"), 4, "0"), F.lit("H"), (number % 2 + 1).cast("string"))


def epoch_day(seconds: Column) -> Column:
    """The UTC date of seconds since 1970, whatever the session's time zone; null for what is no finite number."""
    x = seconds.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 253402300800.0), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(x / 86400).cast("int")))


def channel(name: Column) -> Column:
    """A scope name without r/, trimmed, in lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r"(?i)^/?r/", ""))


def term_reason(term: Column, stop: list[str] | tuple[str, ...]) -> Column:
    """Why a term is left out before counting, first reason first; null where it stays."""
    bare = F.regexp_replace(term, SPACE, "")
    return F.when(term.isNull() | (F.length(bare) < 4), "short_terms").when(F.trim(term).rlike(SPACE), "multi_word_terms").when(F.lower(F.trim(term)).isin(*stop), "stop_words")


@dataclass(frozen=True)
class Fields:
    """Names of a raw record's fields."""

    channel: str = "subreddit"
    body: str = "body"
    other: str = "selftext"
    title: str = "title"
    time: str = "created_utc"
