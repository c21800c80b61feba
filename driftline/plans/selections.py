"""Queries over selections, checks and span embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import checks, sampling, series
from driftline.operators import contexts as cx
from driftline.operators import frequency as fq
from driftline.operators import scoring as sc
from driftline.plans import sql as q
from driftline.plans.registry import query
from driftline.plans.signals import WIDE, signal
from driftline.plans.words import FLOORS, KEYWORDS, LOW, TARGETS, TERMS, held, kept, lines
from driftline.sources import corpus as cp
from driftline.sources import fixtures as fx

_TARGETS = ", ".join(f"'{t}'" for t in TARGETS)


def neighbours(_, windows):
    """A model of its own kind for span_embeddings: a piece's vector is the lengths of the piece before it, its own and that of the one after it."""
    out = []
    for w in windows:
        n = [0, *map(len, w), 0]
        out.append([list(x) for x in zip(n, n[1:], n[2:])])
    return out


@query(f"""WITH {q.SPANS}, s AS (SELECT *, coalesce(lag(length(token)) OVER w, 0) AS a, length(token) AS b, coalesce(lead(length(token)) OVER w, 0) AS c FROM spans WINDOW w AS (PARTITION BY record_id ORDER BY "begin"))
SELECT record_id, half_year, token, "begin", CAST(a AS DOUBLE) AS e0, CAST(b AS DOUBLE) AS e1, CAST(c AS DOUBLE) AS e2 FROM s WHERE token IN ({_TARGETS})""", "e0 e1 e2")
def span_embedding(spark, d):
    spans = cx.token_spans(fx.texts(spark, d), TARGETS)
    out = cx.span_embeddings(spans, cx.SpanEmbedder(lambda: None, neighbours))
    return out.select("record_id", "half_year", "token", "begin", *[F.col("embedding")[i].alias(f"e{i}") for i in range(3)])


@query(f"""WITH {q.SPANS}, o AS (SELECT "begin" AS b FROM spans WHERE token IN ({_TARGETS}))
SELECT count(*) AS matches_found, count(*) FILTER (b % 5 <> 0) AS embedded, count(*) FILTER (b % 5 = 0) AS skipped_no_tokens, true AS balanced FROM o""")
def embedding_balance(spark, d):
    """Matched occurrences against those embedded and skipped; for spans that lie behind the text's end (every fifth here) no piece is found."""
    spans = cx.token_spans(fx.texts(spark, d), TARGETS)
    far = F.col("begin") % 5 == 0
    moved = spans.withColumns({c: F.when(far, F.col(c) + 10_000_000).otherwise(F.col(c)) for c in ("begin", "end")})
    return cx.embedding_stats(cx.span_embeddings(moved, cx.SpanEmbedder(lambda: None, neighbours)))


@query(f"WITH {q.TOKENS}, {q.values('terms', 'term', [(t,) for t in TERMS])} SELECT min(record_id) AS id, term FROM tokens JOIN terms ON token = term GROUP BY term QUALIFY row_number() OVER (PARTITION BY min(record_id) ORDER BY term DESC) = 1")
def term_token_ids(spark, d):
    """A vocabulary of the corpus: a token's number is the least record that has it; of tokens with one number the last by name counts."""
    vocabulary = fq.tokens(fx.texts(spark, d)).groupBy("token").agg(F.min("record_id").alias("id"))
    return sc.term_ids(cp.terms(lines(spark, TERMS)), vocabulary)


_KEYS = ", ".join(f"'{k}'" for k in KEYWORDS)
_PIECES = cx.PIECES.replace("'", "''")


@query(f"""WITH {q.TEXTS}, k AS (SELECT record_id, regexp_extract_all(text, '{_PIECES}') AS w, unnest([{_KEYS}]) AS keyword FROM texts),
m AS (SELECT record_id, keyword, len(w) AS n, list_position(w, keyword) - 1 AS m_at, list_concat(list_concat(w[1:list_position(w, keyword) - 1], ['[MASK]']), w[list_position(w, keyword) + 1:]) AS w FROM k WHERE list_contains(w, keyword)),
f AS (SELECT *, CASE WHEN n > 18 THEN least(greatest(m_at - 9, 0), n - 18) ELSE 0 END AS first FROM m)
SELECT record_id, keyword, array_to_string(w[first + 1:first + 18], ' ') AS "window" FROM f""")
def centred_window(spark, d):
    m = cx.masked_units(fx.texts(spark, d), KEYWORDS, None)
    return m.select("record_id", "keyword", F.array_join(cx.centred(F.split("masked", " "), 20), " ").alias("window"))


@query(r"SELECT doc_id AS record_id, CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN CAST(length(regexp_extract(text, '(?is)^(.*?)\bthe\b', 1)) + 1 AS INTEGER) ELSE 0 END AS place FROM documents")
def first_place(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), cx.first_place(F.col("text"), F.lit("the")).alias("place"))


_FILES = "SELECT DISTINCT 'RC_' || strftime(o_orderdate, '%Y-%m') || '.zst' AS file, strftime(o_orderdate, '%Y-%m') AS month FROM orders"


def _files(spark, d):
    m = fx.table(spark, d, "orders").select(tx.month(F.col("o_orderdate")).alias("m")).distinct()
    return cp.months_of(m.select(F.concat(F.lit("RC_"), "m", F.lit(".zst")).alias("file")))


@query(f"WITH f AS ({_FILES}), n AS (SELECT *, row_number() OVER (ORDER BY month) AS i FROM f) SELECT file, month, 'first' AS chosen FROM n WHERE i <= 5 UNION ALL SELECT file, month, 'at' FROM n WHERE i = 4 UNION ALL SELECT file, month, 'list' FROM n WHERE month IN ('1996-02', '1999-11')")
def month_selection(spark, d):
    f = _files(spark, d)
    ways = {"first": {"first": 5}, "at": {"first": 5, "at": 3}, "list": {"months": ["1999-11", "1996-02"]}}
    parts = [cp.pick_months(f, **how).withColumn("chosen", F.lit(name)) for name, how in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {q.COUNTS} SELECT DISTINCT word FROM freq WHERE half_year = '1998H2' AND c > 0")
def positive_vocabulary(spark, d):
    return fq.positive_vocabulary(kept(spark, d), "1998H2")


@query(f"WITH {q.COUNTS}, w AS (SELECT DISTINCT word FROM freq ORDER BY word LIMIT 40) SELECT half_year, word, c FROM freq WHERE word IN (SELECT word FROM w)")
def max_words(spark, d):
    return fq.first_words(held(spark, d), 40)


@query(f"WITH {q.COUNTS} SELECT half_year, word, c FROM freq WHERE half_year NOT IN ('1996H1', '2000H2')")
def exclude_half_years(spark, d):
    return fq.without_half_years(held(spark, d), ["1996H1", "2000H2"])


@query(f"WITH {q.COUNTS}, w AS (SELECT DISTINCT word FROM freq) SELECT word FROM w ORDER BY md5('3:' || word), word LIMIT 25")
def sample_n(spark, d):
    return sampling.sample(kept(spark, d).select("word").distinct(), 25, "word", 3)


@query(f"WITH {q.COUNTS}, grid AS (SELECT unnest([{', '.join(map(str, FLOORS))}]) AS floor) SELECT half_year, 'floor_' || floor AS floor, count(*) FILTER (c >= floor) AS n_words FROM freq CROSS JOIN grid GROUP BY ALL")
def unpivot_floor(spark, d):
    return fq.unpivoted(fq.pivot_floor(fq.survivors(held(spark, d), FLOORS), FLOORS), "half_year", "floor", "n_words")


@query("""WITH s AS (SELECT o_orderpriority AS scope, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 30 END AS min_freq FROM orders)
SELECT 'status' AS parameter, count(DISTINCT coalesce(status, '-')) AS n_different, n_different <= 1 AS agree FROM s UNION ALL SELECT 'scope', count(DISTINCT scope) AS n, n <= 1 FROM s UNION ALL SELECT 'min_freq', count(DISTINCT coalesce(min_freq, 30)) AS n, n <= 1 FROM s""")
def parameter_agreement(spark, d):
    """Shards that lack min_freq are filled with its default."""
    s = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, 30).alias("min_freq"))
    return checks.agreement(s, status="status", scope="scope", min_freq=F.coalesce("min_freq", F.lit(30)))


@query(f"""WITH c AS (SELECT o_orderkey AS cell, strftime(o_orderdate, '%Y-%m') AS month, {q.half_year("o_orderdate + INTERVAL 20 DAY")} AS half_year, {q.half_year("o_orderdate")} AS own FROM orders) SELECT cell, month, half_year FROM c WHERE half_year <> own""")
def misplaced_cells(spark, d):
    o = fx.table(spark, d, "orders")
    late = F.expr("o_orderdate + INTERVAL 20 DAY")
    return checks.misplaced(o.select(F.col("o_orderkey").alias("cell"), tx.month(F.col("o_orderdate")).alias("month"), tx.half_year(late).alias("half_year")))


@query(f"WITH {q.SIGNAL}, w AS (SELECT word FROM signal GROUP BY word HAVING count(*) >= 6 EXCEPT SELECT word FROM signal WHERE word LIKE '%3' GROUP BY 1) SELECT word FROM w ORDER BY md5('1:' || word), word LIMIT 8")
def replot_selection(spark, d):
    found = series.change_points(signal(spark, d), WIDE).select("word")
    return series.plot_selection(found, found.where("word LIKE '%3'"), 8, 1)


@query(f"""WITH {q.values('lines', 'value', [(x,) for x in ["r/a b", "/r/One", "—", "-", "# x", "", "two", "TWO"]])} SELECT DISTINCT lower(regexp_replace(trim(value), '(?i)^/?r/', '')) AS channel FROM lines WHERE trim(value) NOT IN ('', '-', '—') AND trim(value) NOT LIKE '#%' AND NOT regexp_matches(trim(value), '\\s')""")
def strict_scope(spark, d):
    return cp.scope_list(lines(spark, ["r/a b", "/r/One", "—", "-", "# x", "", "two", "TWO"]), strict=True)
