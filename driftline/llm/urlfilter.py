"""URL filters by dated lists.

A list is a log of dated entries: an entry (a domain, which covers its subdomains, or a host with a path prefix) is put
on or taken off at a date, to block or to allow. Entries become validity intervals, and an as-of join holds every capture
against the entries that were active when it was fetched. The longest active entry decides; of two of the same length
a block wins; without one the capture is allowed.

A capture's keys (all domain suffixes of its host, all prefixes of its path that end where a segment ends, with and
without the slash) meet entries by equality, so the join is a hash join with the interval as a residual filter; nothing
is compared pair by pair. It runs over different (url, time) pairs only, and the list is broadcast if its bytes, counted
first, are few. Case does not matter, neither in entries nor in urls: `Example.net` and `example.net` are one entry.

Defined cases: a null or unparsable url has no key and is allowed; a capture with a null time meets no entry; an entry
put on twice stays on from the first time; taking off what is not on has no effect; entries of equal date are settled
with `off` last; a path entry covers whole segments (`h/en` covers `h/en` and `h/en/1`, not `h/english`; `h/en/` what is
below it); an interval holds its first instant and not its last; repeated captures are judged alike; urls of
any length are read whole; an empty list allows all, and no captures give no rows; columns that have a result's name are
replaced, no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import numbered_columns
from driftline.session import small

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def keys_of(url: Column) -> Column:
    """Domain suffixes of the host and path prefixes, longest names included."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(F.regexp_extract(url, PATH, 1), "/", -1)
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host_of(url), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    inner = F.transform(F.slice(upto, F.lit(1), F.size(upto) - 1), lambda x: F.concat(x, F.lit("/")))
    paths = F.when(F.size(parts) > 1, F.concat(upto, inner)).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, verdict, since, until) from a log of entry, verdict (block, allow), at, action (on, off). A window over the few lines of one entry."""
    each = Window.partitionBy("entry", "verdict").orderBy(F.col("at"), F.col("action").desc())
    log = entries.where("entry IS NOT NULL AND at IS NOT NULL").withColumn("entry", F.lower("entry")).withColumn("before", F.lag("action").over(each))
    turns = log.where("action = 'on' AND (before IS NULL OR before = 'off') OR action = 'off' AND before = 'on'")
    turns = turns.withColumn("until", F.lead("at").over(each))
    return turns.where("action = 'on' AND (until IS NULL OR until > at)").select("entry", "verdict", F.col("at").alias("since"), "until")


def filtered(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetched") -> DataFrame:
    """captures with n_active (active entries that cover it), entry (the one that decides, null if none) and verdict."""
    names = ("n_active", "entry", "verdict")
    own = [c for c in captures.columns if c not in names]
    read = numbered_columns(captures, own, url=F.col(f"`{url}`"), time=F.col(f"`{time}`"))
    asked = read.select("url", "time").where("url IS NOT NULL").distinct().withColumn("key", F.explode(keys_of(F.col("url")))).withColumn("key", F.lower("key"))
    met = asked.join(small(intervals(entries)), (F.col("key") == F.col("entry")) & (F.col("since") <= F.col("time")) & (F.col("until").isNull() | (F.col("time") < F.col("until"))))
    best = met.groupBy("url", "time").agg(F.count("*").alias("n"), F.max(F.struct(F.length("entry").alias("n"), F.col("verdict"), F.col("entry"))).alias("best"))  # "block" is above "allow"
    out = read.join(best, ["url", "time"], "left")
    result = [F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.col("best.entry").alias("entry"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *result)
