"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import search_queries  # noqa: F401  registers its queries
from gleanspark.llm import bpe, hamming_join, language, line_rules, nra, packing, passages, quality_crf, sanitise, suffix_levels
from gleanspark.llm.registry import ORACLES, QUERIES, query, table


__all__ = ["ORACLES", "QUERIES"]


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(documents, path, public_tokenizers.PATTERN)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_crf_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language.held_out("doc_id", 5, 0)
    field = quality_crf.fit(documents, labels, ~out)
    scored = quality_crf.score(documents, field)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_byte_gru_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = language.held_out("doc_id", 3, 1)
    network = language.fit(documents, ~out)
    return language.predict(documents, network).select("doc_id", out.alias("held_out"), "lang_pred", "score")


OP9_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 50 = 0) q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op9_no_random_access_topk", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nra.usable(table(spark, sf_dir, "embeddings"))
    return nra.search(rows, F.col("vec_id") % 50 == 0, 5)


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT r, i, list_slice(words, i, i + 4) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM hit) GROUP BY r
), base AS (
  SELECT w.r, doc_id, source, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), lined AS (
  SELECT DISTINCT r, coalesce(source, chr(2)) AS host, l AS line, len(string_split(l, ' ')) AS n
  FROM (SELECT r, source, trim(regexp_replace(lower(l0), '[\x20\x09-\x0D0-9]+', ' ', 'g')) AS l
        FROM (SELECT r, source, unnest(lines) AS l0 FROM w))
  WHERE l <> ''
), often AS (
  SELECT host, line FROM lined GROUP BY ALL HAVING count(*) > 30
), rest AS (
  SELECT r, md5(coalesce(string_agg(CASE WHEN o.line IS NULL THEN l.line END, chr(10) ORDER BY l.line), '')) AS rest,
         sum(n) AS total
  FROM lined l LEFT JOIN often o USING (host, line) GROUP BY r
), ends AS (
  SELECT r, host, line, n, rest, total FROM lined JOIN often USING (host, line) JOIN rest USING (r)
), spread AS (
  SELECT host, line FROM ends GROUP BY ALL HAVING count(DISTINCT rest) > 30
), gone AS (
  SELECT r, sum(n) AS n, max(total) AS total FROM ends JOIN spread USING (host, line) GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       coalesce(gone.n, 0)::BIGINT AS n_boilerplate,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT coalesce(gone.total - gone.n < 10 OR gone.total - gone.n < 0.3 * gone.total, false) AS kept
FROM base LEFT JOIN gone USING (r)
"""


@query("op3_line_frequency", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


@query("op4_disclosure")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digests(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS s
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node
), c AS (
  SELECT node, min(root) AS component_id FROM r GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query("op8_hamming_neardup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, share=85)


OP6_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, s, md5(array_slice(b, s + 1, s + 100)) AS m
  FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS s FROM d)
), dup AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS k FROM w) WHERE k > 1
), cut AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM dup)
), runs AS (
  SELECT doc_id, run, min(s) AS a, max(s) + 100 AS z FROM cut GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM runs
  UNION ALL
  SELECT d.doc_id, coalesce(max(z), 0), max(octet_length(b)) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT doc_id, string_agg(hex(array_slice(b, lo + 1, hi)), '' ORDER BY lo, hi) AS h FROM gaps JOIN d USING (doc_id) WHERE hi > lo GROUP BY doc_id
), sums AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op6_suffix_levels", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.dedup(table(spark, sf_dir, "documents"))


@query("op2_compact_windows")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with repeated passages: their spans in words, and the first document that has one of them."""
    found = passages.spans(passages.repeated_passages(table(spark, sf_dir, "documents")))
    words = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    return found.select(F.col("doc").alias("doc_id"), "first_doc", "starts", "ends", words.alias("n_words"))
