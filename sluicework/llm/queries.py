"""The queries of this subpackage: QUERIES and, where DuckDB can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, quality, url_filter
from .ann import nearest_neighbours
from .bpe import encode_documents
from .common import table
from .line_dedup import line_dedup
from .mixing import mix_sources
from .ngram_jaccard import THRESHOLD, ngram_jaccard_join
from .secrets import scan_secrets
from .toxicity import fit, score_toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 20, among all vectors."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.score_quality(docs, quality.fit(docs, trusted), keep=["doc_id"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.label_words(docs, language_id.fit(docs), keep=["doc_id"])


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secrets": op2_secrets,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_mix_sources": op10_mix_sources,
}

SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+')"

SQL["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)) AS grams
      FROM w WHERE len(words) > 0),
c AS (SELECT min(doc_id) AS rep, grams, len(grams) AS size, count(*) AS copies FROM s GROUP BY grams),
g AS (SELECT rep, size, unnest(grams) AS gram FROM c),
o AS (SELECT x.rep AS a, y.rep AS b, x.size AS size_a, y.size AS size_b, count(*) AS overlap
      FROM g x JOIN g y ON x.gram = y.gram AND x.rep < y.rep
       AND least(x.size, y.size) >= {THRESHOLD} * greatest(x.size, y.size) - 1e-9 GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE overlap / (size_a + size_b - overlap) >= {THRESHOLD} UNION ALL SELECT b, a FROM o WHERE overlap / (size_a + size_b - overlap) >= {THRESHOLD}),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
root AS (SELECT a AS rep, min(b) AS root FROM r GROUP BY a),
links AS (SELECT e.a AS rep, sum(c.copies) AS links FROM e JOIN c ON e.b = c.rep GROUP BY e.a)
SELECT d.doc_id, coalesce(root.root, d.doc_id) AS class_id, CAST(coalesce(links.links, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN c ON s.grams = c.grams
LEFT JOIN root ON c.rep = root.rep LEFT JOIN links ON c.rep = links.rep
"""

SQL["op8_url_filter"] = url_filter.oracle()

SQL["op9_line_dedup"] = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
each AS (SELECT doc_id, unnest(range(0, len(ls))) AS no, unnest(ls) AS raw FROM split),
line AS (SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line, doc_id * 1000000 + no AS place FROM each),
first AS (SELECT line, min(place) AS place FROM line WHERE line <> '' GROUP BY line),
long AS (SELECT * FROM first WHERE length(line) >= 20),
variant AS (SELECT line, place, i, substr(line, 1, i - 1) || substr(line, i + 1) AS v
            FROM (SELECT line, place, unnest(range(1, length(line) + 1)) AS i FROM long)),
near AS (SELECT a.line, b.place FROM variant a JOIN variant b ON a.v = b.v AND a.i = b.i AND a.line <> b.line
         UNION ALL SELECT a.line, b.place FROM variant a JOIN long b ON a.v = b.line
         UNION ALL SELECT b.line, a.place FROM variant a JOIN long b ON a.v = b.line
         UNION ALL SELECT line, place FROM first),
earliest AS (SELECT line, min(place) AS place FROM near GROUP BY line),
mark AS (SELECT l.doc_id, l.no, l.raw, coalesce(e.place < l.place, FALSE) AS gone FROM line l LEFT JOIN earliest e ON l.line = e.line),
kept AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
         count(*) FILTER (gone) AS n_dropped FROM mark GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END AS text, CAST(coalesce(k.n_lines, 0) AS INT) AS n_lines,
       CAST(coalesce(k.n_dropped, 0) AS INT) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

SQL["op10_mix_sources"] = r"""
WITH RECURSIVE c AS (SELECT doc_id AS id, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS tokens FROM documents),
t AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM c GROUP BY source),
p AS (SELECT list(total / (SELECT sum(total) FROM t) ORDER BY source) AS p, count(*) AS n FROM t WHERE total > 0),
entropy(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN mid ELSE low END, CASE WHEN good THEN high ELSE mid END FROM (
    SELECT step, low, high, mid, list_sum([-(x ^ mid / z) * ln(x ^ mid / z) for x in p]) >= 0.9 * ln(n) - 1e-12 AS good FROM (
      SELECT step, low, high, CASE WHEN step = 0 THEN 1 ELSE (low + high) / 2 END AS mid, p, n,
        list_sum([x ^ (CASE WHEN step = 0 THEN 1 ELSE (low + high) / 2 END) for x in p]) AS z FROM entropy, p WHERE step <= 60 AND low < 1) )),
e AS (SELECT max_by(low, step) AS a FROM entropy),
epochs(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), 1 - a FROM e
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN mid ELSE low END, CASE WHEN good THEN high ELSE mid END FROM (
    SELECT step, low, high, mid, list_max([x ^ (1 - mid) / z / x for x in p]) <= 4 AS good FROM (
      SELECT step, low, high, CASE WHEN step = 0 THEN high ELSE (low + high) / 2 END AS mid, p,
        list_sum([x ^ (1 - CASE WHEN step = 0 THEN high ELSE (low + high) / 2 END) for x in p]) AS z FROM epochs, p WHERE step <= 60 AND low < high) )),
a AS (SELECT 1 - max_by(low, step) AS a FROM epochs),
w AS (SELECT t.source, total, CASE WHEN total = 0 THEN 0 ELSE CAST(round((total / (SELECT sum(total) FROM t)) ^ a.a / (SELECT list_sum([x ^ a.a for x in p]) FROM p) * 1e9) AS BIGINT) END AS weight FROM t, a),
b AS (SELECT source, total, CAST(((SELECT sum(total) FROM t) * weight + 500000000) // 1000000000 AS BIGINT) AS budget FROM w),
q AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE budget // total END AS whole, CASE WHEN total = 0 THEN 0 ELSE budget % total END AS rest FROM b),
r AS (SELECT c.source, c.id, c.tokens, unnest(range(0, q.whole + 1)) AS epoch, q.whole, q.rest, q.total, q.budget FROM c JOIN q ON c.source = q.source),
k AS (SELECT *, md5('17:' || epoch || ':' || coalesce(CAST(id AS VARCHAR), '')) AS key FROM r),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
m AS (SELECT * FROM s WHERE epoch < whole OR (rest > 0 AND before < rest)),
n AS (SELECT greatest(1, (sum(budget) + 999999) // 1000000) AS blocks FROM q),
o AS (SELECT m.*, CAST(least(CASE WHEN budget > 0 THEN ((epoch * total + before) * blocks) // budget ELSE 0 END, blocks - 1) AS BIGINT) AS block FROM m, n)
SELECT id AS doc_id, source, tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY key, source, id, epoch, tokens) AS place FROM o
"""
