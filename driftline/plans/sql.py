"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations

from driftline.functions import text as tx
from driftline.functions.stopwords import STOP_WORDS

_q = lambda s: s.replace("'", "''")
STOP = ", ".join(f"'{_q(w)}'" for w in STOP_WORDS)


def half_year(day: str) -> str:
    return f"(CAST(year({day}) AS VARCHAR) || 'H' || CASE WHEN month({day}) <= 6 THEN '1' ELSE '2' END)"


def clean(x: str, instead: str = "") -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{tx.URL}', '{instead}', 'g'), '{tx.SPACE}', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{_q(tx.WORD)}'), lambda w: lower(w))"


def reason(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR length(regexp_replace({x}, '{tx.SPACE}', '', 'g')) < 4 THEN 'short_terms' WHEN regexp_matches(trim({x}), '{tx.SPACE}') THEN 'multi_word_terms' WHEN lower(trim({x})) IN ({STOP}) THEN 'stop_words' END"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else f"'{_q(v)}'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{tx.SPACE}', ' ', 'g'))"


def n_words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


CORPUS = "corpus AS (SELECT d.doc_id AS record_id, o.o_orderdate AS created, d.source AS channel, d.text AS body FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey)"
TEXTS = f"{CORPUS}, texts AS (SELECT record_id, {half_year('created')} AS half_year, {clean('body')} AS text FROM corpus)"
TOKENS = f"{TEXTS}, listed AS (SELECT record_id, half_year, {words('text')} AS w FROM texts), tokens AS (SELECT record_id, half_year, unnest(range(len(w))) AS pos, unnest(w) AS token FROM listed)"
SPANS = rf"""{TEXTS}, cutup AS (SELECT record_id, half_year, regexp_extract_all(text, '{_q(tx.WORD)}') AS w, string_split_regex(text, '{_q(tx.WORD)}') AS g FROM texts),
laid AS (SELECT record_id, half_year, unnest(range(len(w))) AS pos, unnest(w) AS raw, unnest(g[1:len(w)]) AS gap FROM cutup),
spans AS (SELECT record_id, half_year, lower(raw) AS token, CAST(e - length(raw) AS INTEGER) AS "begin", CAST(e AS INTEGER) AS "end" FROM (SELECT *, sum(length(gap) + length(raw)) OVER (PARTITION BY record_id ORDER BY pos) AS e FROM laid))"""


def contexts(occurrences: str) -> str:
    """The masked contexts of a table's occurrences (record_id, half_year, token, begin, end), as context."""
    return rf"""parts AS (SELECT o.*, text, text[greatest(o."begin" - 799, 1):o."begin"] AS l8, text[o."begin" + 1:o."end"] AS own, text[o."end" + 1:o."end" + 800] AS r8 FROM {occurrences} o JOIN texts USING (record_id)),
halves AS (SELECT * EXCLUDE (text), CASE WHEN len(string_split(trim(l8), ' ')) > 40 THEN l8 ELSE text[1:"begin"] END AS l, CASE WHEN len(string_split(trim(r8), ' ')) > 40 THEN r8 ELSE text["end" + 1:] END AS r FROM parts),
near AS (SELECT *, regexp_replace(l, '(?s)^.*[.!?]([ \t\n\r\f\v])', '\1') AS nl, coalesce(nullif(regexp_extract(r, '(?s)^(.*?[.!?]+)([ \t\n\r\f\v]|$)', 1), ''), r) AS nr FROM halves),
chosen AS (SELECT *, {n_words(squeezed("nl || own || nr"))} < 7 AS whole FROM near),
sides AS (SELECT *, string_split({squeezed("CASE WHEN whole THEN l ELSE nl END")}, ' ') AS b, string_split({squeezed("CASE WHEN whole THEN r ELSE nr END")}, ' ') AS a FROM chosen),
context AS (SELECT record_id, half_year, token, "begin", trim(array_to_string(b[greatest(len(b) - 32, 0) + 1:], ' ') || ' [MASK] ' || array_to_string(a[1:32], ' ')) AS context, CAST(NULL AS VARCHAR) AS drop_reason FROM sides)"""


COUNTS = f"{TOKENS}, counts AS (SELECT half_year, token AS word, count(*) AS c FROM tokens GROUP BY ALL), freq AS (SELECT * FROM counts WHERE {reason('word')} IS NULL)"
DENSE = f"dense AS (SELECT {half_year('l_shipdate')} AS half_year, p_brand AS word, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
SIGNAL = f"{DENSE}, signal AS (SELECT half_year, word, ln((c + 0.5e0) / sum(c) OVER (PARTITION BY half_year) * 1e6) AS value FROM dense)"
NOISE = f"{SIGNAL}, d AS (SELECT word, value - lag(value) OVER (PARTITION BY word ORDER BY half_year) AS d FROM signal), dm AS (SELECT word, median(d) AS m FROM d GROUP BY 1), noise AS (SELECT word, 1.4826e0 * median(abs(d - m)) / sqrt(2e0) AS noise FROM d JOIN dm USING (word) GROUP BY 1)"
VECTORS = f"vec AS (SELECT vec_id, {half_year('o_orderdate')} AS half_year, strftime(o_orderdate, '%Y-%m') AS month, 'w' || label AS word, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN orders ON vec_id = o_orderkey)"
LOGITS = f"""{VECTORS}, logits AS (SELECT a.vec_id AS ctx, a.half_year, a.word, t.vec_id AS token, 'w' || t.label AS token_word, t.label = 0 AS topic, t.vec_id % 17 = 0 AS junk,
    list_dot_product(a.e, CAST(t.embedding AS DOUBLE[])) AS logit FROM vec a JOIN embeddings t ON a.vec_id <> t.vec_id WHERE a.vec_id % 10 = 0)"""
SCORES = f"""{LOGITS}, m AS (SELECT *, max(logit) OVER (PARTITION BY ctx) AS mx, max(CASE WHEN topic THEN logit END) OVER (PARTITION BY ctx) AS best FROM logits WHERE NOT junk),
scores AS (SELECT ctx, half_year, word, CAST(1 + sum(CASE WHEN logit > best THEN 1 ELSE 0 END) AS BIGINT) AS best_rank, sum(CASE WHEN topic THEN exp(logit - mx) ELSE 0e0 END) / sum(exp(logit - mx)) AS soft_score FROM m GROUP BY ALL)"""
CELLS = f"{SCORES}, cells AS (SELECT half_year, word, count(*) AS n_scored, min(best_rank) AS min_rank, sum(ln(best_rank)) AS log_rank_sum, sum(soft_score) AS soft_sum, {', '.join(f'count(*) FILTER (best_rank <= {k}) AS hits_{k}' for k in (5, 10, 15, 20, 50))} FROM scores GROUP BY ALL), occurring AS (SELECT half_year, word, count(*) AS c FROM vec WHERE vec_id % 20 <> 10 GROUP BY ALL)"
SUMMARY = f"{CELLS}, summary AS (SELECT half_year, word, coalesce(c, 0) AS frequency, n_scored, min_rank, log_rank_sum / n_scored AS mean_log_rank, soft_sum / n_scored AS mean_soft, {', '.join(f'hits_{k}' for k in (5, 10, 15, 20, 50))} FROM cells LEFT JOIN occurring USING (half_year, word))"
RATES = f"{SUMMARY}, rates AS (SELECT half_year, word, {', '.join(f'CASE WHEN frequency > 0 THEN CAST(hits_{k} AS DOUBLE) / frequency END AS rate_{k}' for k in (5, 10, 15, 20, 50))} FROM summary)"
PEAKS = f"{RATES}, peaks AS ({' UNION ALL '.join(f'SELECT {k} AS k, word, max(rate_{k}) AS peak FROM rates GROUP BY word' for k in (5, 10, 15, 20, 50))})"
TOPK = f"{LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM logits), topk AS (SELECT * EXCLUDE (e), e / sum(e) OVER (PARTITION BY ctx) AS p, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, token) AS rank FROM e QUALIFY rank <= 50)"
CANDIDATES = f"""{TOPK}, kw AS (SELECT *, token_word IN ('w0', 'w1') AS kw FROM topk), good AS (SELECT ctx FROM kw WHERE kw AND rank <= 5 GROUP BY 1 HAVING count(DISTINCT token) >= 2),
informative AS (SELECT * FROM kw WHERE ctx IN (SELECT ctx FROM good) AND NOT kw AND NOT junk),
candidates AS (SELECT half_year, token_word AS word, sum(p) AS score, count(DISTINCT ctx) AS n_informative FROM informative GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY half_year ORDER BY score DESC, word) AS rank FROM candidates)"""
#: Every division of a series into segments of three values or more, by their ends; series have some fourteen values, so divisions are few.
SEGMENTS = f"""{NOISE}, least AS (SELECT greatest(0.25e0 * median(noise), 1e-6) AS floor FROM (SELECT noise FROM noise ORDER BY word LIMIT 2000)),
zs AS (SELECT word, half_year, value, row_number() OVER (PARTITION BY word ORDER BY half_year) AS t, count(*) OVER (PARTITION BY word) AS n, (value - avg(value) OVER (PARTITION BY word)) / greatest(noise, floor) AS z FROM signal JOIN noise USING (word) CROSS JOIN least),
sums AS (SELECT word, n, list_concat([0e0], list(s ORDER BY t)) AS s, list_concat([0e0], list(ss ORDER BY t)) AS ss FROM (SELECT *, sum(z) OVER (PARTITION BY word ORDER BY t) AS s, sum(z * z) OVER (PARTITION BY word ORDER BY t) AS ss FROM zs) WHERE n >= 6 GROUP BY word, n),
paths AS (SELECT word, n, s, ss, CAST(0 AS BIGINT) AS b_at, 0e0 AS cost, CAST([] AS BIGINT[]) AS cuts FROM sums
    UNION ALL SELECT word, n, s, ss, e, cost + ss[e + 1] - ss[b_at + 1] - (s[e + 1] - s[b_at + 1]) ** 2 / (e - b_at) + CASE WHEN b_at > 0 THEN 0.5e0 * ln(n) ELSE 0e0 END, CASE WHEN b_at > 0 THEN list_append(cuts, b_at) ELSE cuts END
    FROM (SELECT *, unnest(range(b_at + 3, n + 1)) AS e FROM paths WHERE b_at < n) WHERE e = n OR e <= n - 3),
best AS (SELECT word, arg_min(cuts, cost) AS cuts FROM paths WHERE b_at = n GROUP BY word),
parted AS (SELECT word, half_year, value, t, n, list_contains(cuts, t - 1) AS change, CAST(len(list_filter(cuts, lambda c: c < t)) AS BIGINT) AS segment FROM zs JOIN best USING (word)),
levelled AS (SELECT *, avg(value) OVER (PARTITION BY word, segment) AS level FROM parted),
firsts AS (SELECT word, segment, min(half_year) AS half_year, any_value(level) AS level_after, lag(any_value(level)) OVER (PARTITION BY word ORDER BY segment) AS level_before FROM levelled GROUP BY word, segment),
jumps AS (SELECT word, half_year, level_before, level_after, level_after - level_before AS jump FROM firsts WHERE segment > 0)"""
