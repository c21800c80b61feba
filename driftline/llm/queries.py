"""The queries opN_<name> with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import chat, decontam, mixing, ngram_lm, quality, repeats, secrets, simhash, urlfilter, wrappers
from driftline.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"), secrets.default_model(), carry=["doc_id"])


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    return ngram_lm.scored(table(spark, sf_dir, "documents"), train, carry=["doc_id"], stable=True)  # a scan of files


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"), carry=["doc_id"], with_text=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


#: A dated list over the hosts of the pages: (entry, verdict, at, action).
URL_LIST = [
    ("example.net", "block", "2024-02-01", "on"),
    ("example.net", "block", "2024-04-15", "off"),
    ("example.net", "block", "2024-09-01", "on"),
    ("tionsh.example.net", "allow", "2024-03-01", "on"),
    ("example.org", "block", "2024-06-10", "on"),
    ("example.org", "block", "2024-07-01", "on"),
    ("example.org", "block", "2025-01-20", "off"),
    ("ththth.example.org", "allow", "2024-08-01", "on"),
    ("ththth.example.org", "allow", "2024-08-01", "off"),
    ("blog.ththth.example.org", "allow", "2024-08-05", "on"),
    ("blog.ththth.example.org", "allow", "2024-12-24", "off"),
    ("m.tiontion.example.com", "block", "2024-01-05", "off"),
    ("m.tiontion.example.com", "block", "2024-05-05", "on"),
    ("example.com", "allow", "2024-01-01", "on"),
    ("example.com", "block", "2025-06-01", "on"),
    ("blog.tionble.example.com/en/", "block", "2024-03-03", "on"),
    ("blog.tionble.example.com/fr/", "block", "2024-10-10", "on"),
    ("blog.tionble.example.com/fr/", "block", "2025-10-10", "off"),
    ("Blog.Tionble.example.com/de", "block", "2024-02-02", "on"),
    ("BLOG.tionble.example.com/DE", "block", "2025-02-02", "off"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table has no dates: a page is taken as fetched page_id mod 730 days after the start of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 730).cast("int")).alias("fetched"))
    log = spark.createDataFrame(URL_LIST, "entry string, verdict string, at string, action string").withColumn("at", F.to_date("at"))
    return urlfilter.filtered(pages, log)


_VALUES = ", ".join(f"('{e}', '{v}', DATE '{a}', '{x}')" for e, v, a, x in URL_LIST)
OP6_SQL = rf"""
WITH given(entry, verdict, day, action) AS (VALUES {_VALUES}), log AS (SELECT lower(entry) AS entry, verdict, day, action FROM given),
seen AS (SELECT *, lag(action) OVER (PARTITION BY entry, verdict ORDER BY day, action DESC) AS before FROM log),
turns AS (SELECT *, lead(day) OVER (PARTITION BY entry, verdict ORDER BY day, action DESC) AS until FROM seen
          WHERE action = 'on' AND (before IS NULL OR before = 'off') OR action = 'off' AND before = 'on'),
valid AS (SELECT entry, verdict, day AS since, until FROM turns WHERE action = 'on' AND (until IS NULL OR until > day)),
captures AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS DATE) AS fetched,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS host,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
met AS (SELECT c.page_id, v.entry, v.verdict FROM captures c JOIN valid v ON v.since <= c.fetched AND (v.until IS NULL OR c.fetched < v.until)
    AND (c.host = v.entry OR ends_with(c.host, '.' || v.entry) OR (contains(v.entry, '/') AND (c.host || c.path = v.entry OR starts_with(c.host || c.path, regexp_replace(v.entry, '/$', '') || '/'))))),
best AS (SELECT page_id, count(*) AS n_active, arg_max(entry, (length(entry), verdict, entry)) AS entry, arg_max(verdict, (length(entry), verdict, entry)) AS verdict FROM met GROUP BY 1)
SELECT c.page_id, c.url, c.fetched, coalesce(n_active, 0) AS n_active, entry, coalesce(verdict, 'allow') AS verdict FROM captures c LEFT JOIN best USING (page_id)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), carry=["doc_id", "source"], size_power=0.5)


#: A conversation that says what a template might say.
PROBE = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    log = rows.select(F.col("conv_id").alias("conv"), F.col("turn").alias("slot"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    out = chat.rendered(log, regenerates=False)
    # The digest columns are read back from the rendered string alone.
    turns, masked = chat.parsed(F.col("formatted")), chat.under_mask(F.col("formatted"), F.col("loss"))
    read = out.select("conv", "formatted", turns.alias("turns"), masked.alias("masked"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
j AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t) AS said,
    string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, role, t) AS masked,
    CAST(sum(20 + length(role) + length(t) + length(regexp_replace(role || t, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(masked) AS BIGINT) AS loss_chars, sha256(masked) AS loss_sha256, formatted_chars FROM j
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"], near=20).drop("items")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 10) AS BIGINT) >> 1 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2e0 * source_size AS cap, 1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
o AS (SELECT *, row_number() OVER by_stop AS place, coalesce(sum(cap) OVER (by_stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before,
    sum(weight) OVER (by_stop ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w WINDOW by_stop AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT arg_min((total - before) / rest, place) AS level FROM o WHERE (total - before) / rest * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM o CROSS JOIN l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate FROM t),
p AS (SELECT *, target - floor(rate) * source_size AS need, (rate - floor(rate)) / (1 - (rate - floor(rate))) AS odds FROM r),
x AS (SELECT d.doc_id, d.size, d.u, p.*, (u + 0.5e0) / 549755813888e0 AS v FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
y AS (SELECT *, v / (1 - v) / nullif(odds * pow(CAST(size AS DOUBLE), 0.5e0), 0e0) AS q FROM x),
z AS (SELECT *, coalesce(least(CAST(floor(q / (1 + q) * 549755813888e0) AS BIGINT), 549755813887), 549755813887) AS place FROM y),
c AS (SELECT source, need, place, sum(size) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM z WHERE size > 0 AND need > 0 AND odds > 0),
e AS (SELECT source, any_value(need) AS need, min(place) FILTER (upto >= need) AS over_, min(upto) FILTER (upto >= need) AS over_words, max(place) FILTER (upto < need) AS under_, coalesce(max(upto) FILTER (upto < need), 0) AS under_words FROM c GROUP BY 1),
k AS (SELECT source, CASE WHEN over_ IS NOT NULL AND over_words - need <= need - under_words THEN over_ ELSE coalesce(under_, -1) END AS last FROM e)
SELECT doc_id, z.source, size, source_size, target, CAST(floor(rate) AS BIGINT) + CASE WHEN place <= coalesce(last, -1) THEN 1 ELSE 0 END AS copies,
    (CAST(floor(rate) AS BIGINT) + CASE WHEN place <= coalesce(last, -1) THEN 1 ELSE 0 END) * size AS taken FROM z LEFT JOIN k ON z.source IS NOT DISTINCT FROM k.source
"""


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_ngram_lm, op3_repeats, op4_quality_rules, op5_simhash, op6_url_filters, op7_mixing, op8_chat, op9_html_extraction, op10_decontamination)}
ORACLE_SQL: dict[str, str] = {"op6_url_filters": OP6_SQL, "op7_mixing": OP7_SQL, "op8_chat": OP8_SQL}
