"""Queries of lexical search, conversation repair and nearest neighbours, with the SQL of the first two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import code_search, lexical_blocks, turn_repair
from gleanspark.llm.registry import query, table

OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), c AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM d
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query("op11_lexical_blocks", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_blocks.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def _plus(state: str, cost: str, letters: str) -> str:
    """A state of the SQL repair is its cost in nine digits with the audit behind it; least() compares both."""
    return f"(lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letters}')"


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _stays(state: str, letter: str, initial: str | None = None) -> str:
    """A turn that is kept (if its role has the initial) or given another role."""
    cost = "CASE WHEN truncated THEN 1 ELSE 0 END"
    allowed = f"keeps AND initial = '{initial}'" if initial else "keeps"
    return f"CASE WHEN {allowed} THEN {_plus(state, cost if initial else f'2 + {cost}', letter)} END"


# Before a turn, the states "user given" (u) and "pair given" (a) may be reached by inserts.
_U = _least("u", _plus("z", "2", "I"), _plus("s", "2", "I"), _plus("a", "2", "I"))
_A = _least("a", _plus("u", "2", "I"), _plus("z", "4", "II"), _plus("s", "4", "II"))

OP12_SQL = f"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), f AS (
  SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, x: list_reduce(CAST(range(8) AS BIGINT[]), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(c, x)),
    4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fault
  FROM b
), r AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, range(2) AS c(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r
), g AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS unended,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS two
  FROM n
), x AS (
  SELECT *, NOT blank AND NOT seen AS keeps, NOT blank AND NOT seen AND unended AS truncated FROM g
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a
  FROM (SELECT DISTINCT conv_id FROM x)
  UNION ALL
  SELECT conv_id, i, {_plus("z", "3", "D")}, {_least(_plus("s", "3", "D"), _stays("z", "K", "s"))},
         {_least(_plus("u", "3", "D"), *[_stays(k, "K", "u") for k in "zsa"], *[_stays(k, "R") for k in "zsa"])},
         {_least(_plus("a", "3", "D"), _stays("u", "K", "a"), _stays("u", "R"))}
  FROM (SELECT dp.conv_id, x.i, z, s, {_U} AS u, {_A} AS a, initial, keeps, truncated
        FROM dp JOIN x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.i = dp.i + 1)
), last AS (
  SELECT conv_id, max_by({_least("z", _A)}, i) AS best FROM dp GROUP BY conv_id
), edits AS (
  SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM last
), letters AS (
  SELECT conv_id, p, letter,
         sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i,
         sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS o
  FROM (SELECT conv_id, p, audit[p] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM edits))
), lines AS (
  SELECT l.conv_id, p, letter, o, role, text,
         max(CASE WHEN o = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.i = l.i AND letter <> 'I' WHERE letter <> 'D'
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t
  FROM lines GROUP BY conv_id
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM x GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN edits e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_turn_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(table(spark, sf_dir, "conversations"))


@query("op13_multi_index_codes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_search.usable(table(spark, sf_dir, "embeddings"))
    return code_search.search(rows, F.col("vec_id") % 20 == 0, 20)
