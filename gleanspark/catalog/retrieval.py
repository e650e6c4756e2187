"""BM25, fusion, reranking, dense search and support-based evaluation."""

from pyspark.sql import functions as F

from gleanspark.catalog.fixtures import Tables, bm25_sql, sql
from gleanspark.catalog.registry import query
from gleanspark.catalog.rows import SENTENCES_SQL
from gleanspark.functions.questions import distinctive_keywords, options_array, pooled_query, position_of, support_hit
from gleanspark.functions.scores import ndcg_at, recall_at, reciprocal_rank
from gleanspark.operators import dense, fusion, rerank, stats, support
from gleanspark.operators.bm25 import Bm25Parameters, build_index, load_index, query_terms, save_index, score_chunks, search
from gleanspark.plans import retrieval as plan
from gleanspark.runtime import materialize, scratch_path

HALVES = {
    "chunks_a": (["chunks"], "SELECT * FROM chunks WHERE article_id % 2 = 0"),
    "chunks_b": (["chunks"], "SELECT * FROM chunks WHERE article_id % 2 = 1"),
    "option_queries": (["option_rows"], "SELECT qid, option_no, prompt || ' ' || option AS query FROM option_rows"),
}
GRAMS = (
    "SELECT DISTINCT qid, array_to_string(w[i : i + n - 1], ' ') AS g FROM "
    "(SELECT qid, regexp_extract_all(lower(query), '[A-Za-z0-9]+') AS w FROM queries), unnest([2, 3, 4]) v(n), "
    "unnest(range(1, len(w) + 1)) u(i) WHERE i + n - 1 <= len(w)"
)


def hit_sql(text: str) -> str:
    return f"len(list_filter(wanted, lambda k: contains(lower({text}), k))) > 0"


def recall_sql(rank: str, k: int) -> str:
    return f"CASE WHEN {rank} BETWEEN 1 AND {k} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


VIEWS = {
    **HALVES,
    **bm25_sql("s", "chunks", "queries", "qid", 100),
    **bm25_sql("a", "chunks_a", "queries", "qid", 5),
    **bm25_sql("b", "chunks_b", "queries", "qid", 5),
    **bm25_sql("o", "chunks", "option_queries", "qid, option_no", 20),
    "hit_ranks": (
        ["s_ranked", "chunks", "wanted", "questions"],
        "SELECT q.qid, coalesce(min(r.rank), 0) AS hit_rank FROM questions q LEFT JOIN "
        f"(SELECT r.qid, r.rank FROM s_ranked r JOIN chunks c USING (chunk_id) JOIN wanted w ON w.qid = r.qid WHERE {hit_sql('c.text')}) r "
        "ON r.qid = q.qid GROUP BY q.qid",
    ),
    "contexts": (
        ["s_ranked", "chunks", "questions"],
        "SELECT q.qid, coalesce(c.context, '') AS context FROM questions q LEFT JOIN (SELECT r.qid, string_agg(c.text, ' ' ORDER BY r.rank) AS context "
        "FROM s_ranked r JOIN chunks c USING (chunk_id) WHERE r.rank <= 5 GROUP BY r.qid) c ON c.qid = q.qid",
    ),
    "grams": (["queries"], GRAMS),
    "reranked": (
        ["s_ranked", "chunks", "grams"],
        "SELECT qid, chunk_id, score, phrase_count, row_number() OVER (PARTITION BY qid ORDER BY phrase_count DESC, round(score, 9) DESC, rank) AS rank FROM "
        "(SELECT r.qid, r.rank, r.chunk_id, any_value(r.score) AS score, count(*) FILTER (contains(lower(c.text), g.g)) AS phrase_count "
        "FROM s_ranked r JOIN chunks c USING (chunk_id) JOIN grams g ON g.qid = r.qid WHERE r.rank <= 50 GROUP BY r.qid, r.rank, r.chunk_id)",
    ),
    "option_fused": (
        ["o_ranked"],
        "SELECT qid, chunk_id, fused, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, met) AS rank FROM "
        "(SELECT qid, chunk_id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS fused, min(option_no * 1000 + rank) AS met FROM o_ranked GROUP BY qid, chunk_id)",
    ),
    "lists": (
        ["a_ranked", "b_ranked", "chunks"],
        "SELECT 0 AS list_no, r.*, c.text FROM a_ranked r JOIN chunks c USING (chunk_id) UNION ALL BY NAME "
        "SELECT 1 AS list_no, r.*, c.text FROM b_ranked r JOIN chunks c USING (chunk_id)",
    ),
    "fused": (
        ["lists"],
        "SELECT * FROM (SELECT qid, text, fused, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, met) AS rank FROM "
        "(SELECT qid, text, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS fused, min(list_no * 1000 + rank) AS met FROM lists GROUP BY qid, text)) WHERE rank <= 5",
    ),
    "pooled": (
        ["lists"],
        "SELECT * FROM (SELECT qid, list_no, chunk_id, text, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, list_no, rank) AS rank "
        "FROM lists) WHERE rank <= 5",
    ),
    "arms": (
        ["lists", "fused", "pooled", "wanted", "questions"],
        "SELECT v.arm, q.qid, CASE WHEN coalesce(" + hit_sql("c.context") + ", false) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score "
        "FROM questions q JOIN wanted w ON w.qid = q.qid CROSS JOIN (SELECT unnest(['a', 'b', 'pool', 'rrf']) AS arm) v LEFT JOIN ("
        "SELECT 'a' AS arm, qid, string_agg(text, ' ' ORDER BY rank) AS context FROM lists WHERE list_no = 0 GROUP BY qid UNION ALL "
        "SELECT 'b', qid, string_agg(text, ' ' ORDER BY rank) FROM lists WHERE list_no = 1 GROUP BY qid UNION ALL "
        "SELECT 'pool', qid, string_agg(text, ' ' ORDER BY rank) FROM pooled GROUP BY qid UNION ALL "
        "SELECT 'rrf', qid, string_agg(text, ' ' ORDER BY rank) FROM fused GROUP BY qid) c ON c.qid = q.qid AND c.arm = v.arm",
    ),
    "prompt_hits": (
        ["option_fused", "chunks", "wanted", "questions"],
        "SELECT q.qid, coalesce(min(r.rank), 0) AS hit_rank FROM questions q LEFT JOIN "
        f"(SELECT r.qid, r.rank FROM option_fused r JOIN chunks c USING (chunk_id) JOIN wanted w ON w.qid = r.qid WHERE r.rank <= 5 AND {hit_sql('c.text')}) r "
        "ON r.qid = q.qid GROUP BY q.qid",
    ),
}


def view(body: str, *needs: str) -> str:
    return sql(body, *needs, extra=VIEWS)


def whole(name: str):
    return F.col(name).cast("long").alias(name)


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# --- BM25 ----------------------------------------------------------------------------------


@query(
    "b1_index_postings",
    view("SELECT f.chunk_id, f.term, f.tf, d.dl FROM s_tf f JOIN s_dl d USING (chunk_id)", "s_tf", "s_dl"),
)
def b1(t: Tables):
    return t.index.postings


@query(
    "b2_search_one",
    sql(
        "SELECT rank, chunk_id, round(score, 6) AS score FROM x_ranked",
        "x_ranked",
        extra={
            "longest": (["queries"], "SELECT 0 AS qid, query FROM queries ORDER BY length(query) DESC, qid LIMIT 1"),
            **bm25_sql("x", "chunks", "longest", "qid", 10),
        },
    ),
)
def b2(t: Tables):
    one = support.question_queries(t.questions).orderBy(F.length("query").desc(), "qid").limit(1)
    return search(t.index, one, 10).select(whole("rank"), "chunk_id", rounded("score"))


@query("b3_bm25_topk", view("SELECT qid, rank, chunk_id, round(score, 6) AS score FROM s_ranked WHERE rank <= 5", "s_ranked"))
def b3(t: Tables):
    found = search(t.index, support.question_queries(t.questions), 5)
    return found.select("qid", whole("rank"), "chunk_id", rounded("score"))


@query("j6_query_postings", view("SELECT qid, count(*) AS n_chunks, round(sum(score), 5) AS score_sum FROM s_scored GROUP BY qid", "s_scored"))
def j6(t: Tables):
    everything = score_chunks(t.index, support.question_queries(t.questions))
    return everything.groupBy("qid").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.sum("score"), 5).alias("score_sum"))


@query("b4_saved_index", view("SELECT qid, rank, chunk_id, round(score, 6) AS score FROM s_ranked WHERE rank <= 5", "s_ranked"))
def b4(t: Tables):
    path = scratch_path(t.spark, "index")
    save_index(t.index, path, folders=16)
    index = load_index(t.spark, path)
    found = search(index, support.question_queries(t.questions), 5)
    return found.select("qid", whole("rank"), "chunk_id", rounded("score"))


PROMPT_ONLY = {
    **VIEWS,
    "prompt_queries": (["questions"], "SELECT qid, prompt AS query FROM questions"),
    **bm25_sql("pq", "chunks", "prompt_queries", "qid", 100),
}


@query("query_fn_prompt_only", sql("SELECT qid, rank, chunk_id, round(score, 6) AS score FROM pq_ranked WHERE rank <= 5", "pq_ranked", extra=PROMPT_ONLY))
def query_fn_prompt_only(t: Tables):
    """Another query builder: the prompt without its options."""
    asked = support.question_queries(t.questions, lambda prompt, options: prompt)
    found = search(t.index, asked, 5)
    return found.select("qid", whole("rank"), "chunk_id", rounded("score"))


@query(
    "b1_query_terms_once",
    view("SELECT qid, count(*) AS n_terms, sum(CASE WHEN qtf > 1 THEN 1 ELSE 0 END)::BIGINT AS n_repeated FROM s_qt GROUP BY qid", "s_qt"),
)
def b1_terms(t: Tables):
    terms = query_terms(support.question_queries(t.questions), Bm25Parameters(), ["qid"])
    return terms.groupBy("qid").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("qtf") > 1).alias("n_repeated"))


@query("b5_attach_context", view("SELECT qid, md5(context) AS context_md5 FROM contexts", "contexts"))
def b5(t: Tables):
    return plan.attach_context(t.questions, t.index, t.chunks_of).select("qid", F.md5("context").alias("context_md5"))


@query(
    "b5_attach_reranked_context",
    view(
        "SELECT r.qid, md5(string_agg(c.text, ' ' ORDER BY r.rank)) AS context_md5 FROM reranked r JOIN chunks c USING (chunk_id) WHERE r.rank <= 5 GROUP BY r.qid",
        "reranked",
        "chunks",
    ),
)
def b5_rerank(t: Tables):
    rows = plan.attach_context(t.questions, t.index, t.chunks_of, rerank=True)
    return rows.select("qid", F.md5("context").alias("context_md5"))


@query("j7_chunk_texts", view("SELECT r.qid, r.rank, md5(c.text) AS text_md5 FROM s_ranked r JOIN chunks c USING (chunk_id) WHERE r.rank <= 5", "s_ranked", "chunks"))
def j7(t: Tables):
    found = search(t.index, support.question_queries(t.questions), 5)
    return support.with_texts(found, t.chunks_of, t.questions.count() * 5).select("qid", whole("rank"), F.md5("text").alias("text_md5"))


# --- fusion and reranking ------------------------------------------------------------------


def option_search(t: Tables):
    return plan.search_per_option(t.questions, t.index)


@query("b6_rank_fusion", view("SELECT qid, rank, chunk_id, round(fused, 9) AS fused FROM option_fused", "option_fused"))
def b6(t: Tables):
    rows = t.option_rows.withColumn("query", F.concat("prompt", F.lit(" "), "option"))
    ranked = search(t.index, rows, 20, ["qid", "option_no"]).withColumnRenamed("option_no", "list_no")
    return fusion.fuse_ranks(ranked, ["qid"], "chunk_id").select("qid", whole("rank"), "chunk_id", rounded("fused", 9))


@query("b7_per_option_search", view("SELECT qid, rank, chunk_id, round(fused, 9) AS fused FROM option_fused WHERE rank <= 5", "option_fused"))
def b7(t: Tables):
    return option_search(t).select("qid", whole("rank"), "chunk_id", rounded("fused", 9))


@query("a9_fused_sums", view("SELECT qid, text AS chunk, round(fused, 9) AS fused FROM (SELECT qid, md5(text) AS text, fused FROM fused)", "fused"))
def a9(t: Tables):
    return plan.fuse_indexes(halves(t)).select("qid", F.md5("text").alias("chunk"), rounded("fused", 9))


@query("b8_phrase_rerank", view("SELECT qid, rank, chunk_id, phrase_count, round(score, 6) AS score FROM reranked WHERE rank <= 10", "reranked"))
def b8(t: Tables):
    rows = plan.retrieve(t.questions, t.index, t.chunks_of, 10, rerank=True)
    return rows.select("qid", whole("rank"), "chunk_id", whole("phrase_count"), rounded("score"))


def halves(t: Tables):
    legs = [(build_index(t.half(i)), t.half_of(i)) for i in (0, 1)]
    return plan.dual_index_lists(t.questions, legs)


@query("b9_dual_index_fusion", view("SELECT qid, rank, md5(text) AS text_md5, round(fused, 9) AS fused FROM fused", "fused"))
def b9(t: Tables):
    return plan.fuse_indexes(halves(t)).select("qid", whole("rank"), F.md5("text").alias("text_md5"), rounded("fused", 9))


@query("b10_score_pool", view("SELECT qid, rank, CAST(list_no AS BIGINT) AS list_no, chunk_id, round(score, 6) AS score FROM pooled", "pooled"))
def b10(t: Tables):
    return plan.pool_indexes(halves(t)).select("qid", whole("rank"), whole("list_no"), "chunk_id", rounded("score"))


NEW_SHARE = (
    "SELECT round((SELECT avg(share) FROM (SELECT f.qid, CAST(count(h.text) AS DOUBLE) / 5 AS share FROM fused f LEFT JOIN "
    "(SELECT DISTINCT qid, text FROM lists WHERE list_no = 1) h ON h.qid = f.qid AND h.text = f.text GROUP BY f.qid)), 9) AS fused_share, "
    "round((SELECT avg(share) FROM (SELECT qid, CAST(count(*) FILTER (list_no = 1) AS DOUBLE) / 5 AS share FROM pooled GROUP BY qid)), 9) AS pooled_share"
)


@query("b24_new_half_share", view(NEW_SHARE, "lists", "fused", "pooled"))
def b24(t: Tables):
    return plan.new_share(halves(t)).select(rounded("fused_share", 9), rounded("pooled_share", 9))


@query(
    "a13_share_of_top",
    view(
        "SELECT f.qid, CAST(count(h.text) AS DOUBLE) / 5 AS share FROM fused f LEFT JOIN (SELECT DISTINCT qid, text FROM lists WHERE list_no = 0) h "
        "ON h.qid = f.qid AND h.text = f.text GROUP BY f.qid",
        "lists",
        "fused",
    ),
)
def a13(t: Tables):
    lists = halves(t)
    return fusion.share_from_list(plan.fuse_indexes(lists), lists, ["qid"], "text", 0, 5)


@query("b9_dual_index_arms", view("SELECT arm, qid, score FROM arms", "arms"))
def b9_arms(t: Tables):
    return plan.dual_index_arms(t.questions, halves(t))


POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


def hashed_means_sql(source: str, key: str, value: str, groups: str = "") -> str:
    """Resample means of the hash-seeded bootstrap: ``(groups, b, m)``."""
    weight = " + ".join(f"CASE WHEN u >= CAST({p} AS DOUBLE) THEN 1 ELSE 0 END" for p in POISSON)
    by = f"{groups}, " if groups else ""
    return (
        f"SELECT {by}b, sum(w * {value}) / sum(w) AS m FROM (SELECT *, {weight} AS w FROM (SELECT {by}{value}, b, "
        f"CAST('0x' || substr(md5('0|' || b || '|' || {key}), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u "
        f"FROM {source}, unnest(range(0, 200)) r(b))) GROUP BY {by}b HAVING sum(w) > 0"
    )


def _horner_sql(coefficients, x: str) -> str:
    total = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r})"
    return total


def binomial_sql(n: str, share: str, u: str) -> str:
    """Binomial quantile: summed up for small means, else normal with a term for skewness; the rarer side is drawn."""
    q, v = f"least({share}, 1 - {share})", f"CASE WHEN {share} > 0.5 THEN 1 - {u} ELSE {u} END"
    state = "{{'j': CAST({} AS DOUBLE), 'k': CAST(0 AS DOUBLE), 'p': {}, 'c': {}}}"
    step = "a.p * (n - x.j) / (x.j + 1) * (q / (1 - q))"
    start = "exp(n * ln(1 - q))"
    exact = (
        f"list_reduce(list_transform(range(0, {stats.EXACT_STEPS}), lambda j: {state.format('j', 'CAST(0 AS DOUBLE)', 'CAST(0 AS DOUBLE)')}), "
        f"lambda a, x: {{'j': x.j, 'k': a.k + CASE WHEN v > a.c THEN 1 ELSE 0 END, 'p': {step}, 'c': a.c + {step}}}, {state.format('-1', start, start)}).k"
    )
    t, r = "sqrt(-2 * ln(least(v, 1 - v)))", "(v - 0.5)"
    outer = f"{_horner_sql(stats.NORMAL_C, t)} / {_horner_sql((*stats.NORMAL_D, 1.0), t)}"
    inner = f"{r} * {_horner_sql(stats.NORMAL_A, f'({r} * {r})')} / {_horner_sql((*stats.NORMAL_B, 1.0), f'({r} * {r})')}"
    z = f"CASE WHEN least(v, 1 - v) < {stats.NORMAL_TAIL} THEN CASE WHEN v < 0.5 THEN {outer} ELSE -({outer}) END ELSE {inner} END"
    wide = "floor(n * q + sqrt(n * q * (1 - q)) * z + (1 - 2 * q) * (z * z - 1) / 6 + 0.5)"
    return (
        f"(SELECT CASE WHEN share > 0.5 THEN n - k ELSE k END FROM (SELECT n, share, greatest(0, least(n, CASE WHEN n * q <= {stats.EXACT_MEAN} THEN {exact} ELSE {wide} END)) AS k "
        f"FROM (SELECT *, {z} AS z FROM (SELECT CAST({n} AS DOUBLE) AS n, {share} AS share, {q} AS q, {v} AS v))))"
    )


def drawn_intervals_sql(source: str, value: str, group: str, resamples: int = 10_000, seed: int = 0) -> str:
    """``(group, n, mean, ci_lower, ci_upper)`` of the multinomial bootstrap, a binomial draw for one value after another."""
    digest = f"md5('{seed}|' || b || '|' || i)"
    u = f"((CAST('0x' || substr({digest}, 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE))"
    return (
        f"WITH RECURSIVE counted AS MATERIALIZED (SELECT {group}, v, c, row_number() OVER (PARTITION BY {group} ORDER BY v) - 1 AS i, "
        f"sum(c) OVER (PARTITION BY {group} ORDER BY v DESC) AS behind FROM (SELECT {group}, {value} AS v, count(*) AS c FROM {source} GROUP BY ALL)), "
        f"sized AS MATERIALIZED (SELECT {group}, sum(c) AS n, sum(v * c) / sum(c) AS mean FROM counted GROUP BY {group}), "
        f"chain AS (SELECT {group}, b, -1::BIGINT AS i, CAST(n AS DOUBLE) AS rows_left, CAST(0 AS DOUBLE) AS t FROM sized, unnest(range(0, {resamples})) r(b) "
        f"UNION ALL SELECT {group}, b, i, rows_left - k, t + v * k FROM (SELECT s.{group}, s.b, c.i, s.rows_left, s.t, c.v, "
        f"{binomial_sql('s.rows_left', 'CAST(c.c AS DOUBLE) / c.behind', u.replace('|| b ||', '|| s.b ||').replace('|| i)', '|| c.i)'))} AS k "
        f"FROM chain s JOIN counted c ON c.{group} = s.{group} AND c.i = s.i + 1)) "
        f"SELECT {group}, CAST(any_value(n) AS BIGINT) AS n, any_value(mean) AS mean, quantile_cont(t / n, 0.025) AS ci_lower, quantile_cont(t / n, 0.975) AS ci_upper "
        f"FROM (SELECT {group}, b, max_by(t, i) AS t FROM chain GROUP BY {group}, b) JOIN sized USING ({group}) GROUP BY {group}"
    )


ENDS = "round(mean, 9) AS mean, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper"


@query(
    "m12_arms_against_baseline",
    view(
        "SELECT arm, n, round(mean, 9) AS mean, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper, ci_lower > 0 OR ci_upper < 0 AS resolved FROM ("
        "WITH d AS MATERIALIZED (SELECT arm, qid, score - base AS d FROM arms JOIN (SELECT qid, score AS base FROM arms WHERE arm = 'a') USING (qid) WHERE arm <> 'a') "
        "SELECT * FROM (SELECT arm, count(*) AS n, avg(d) AS mean FROM d GROUP BY arm) JOIN (SELECT arm, quantile_cont(m, 0.025) AS ci_lower, "
        f"quantile_cont(m, 0.975) AS ci_upper FROM ({hashed_means_sql('d', 'qid', 'd', 'arm')}) GROUP BY arm) USING (arm))",
        "arms",
    ),
)
def m12(t: Tables):
    report = stats.compare_arms(plan.dual_index_arms(t.questions, halves(t)), "a", hashed=True, resamples=200)
    return report.select("arm", "n", *[rounded(c, 9) for c in ("mean", "ci_lower", "ci_upper")], "resolved")


# --- dense ---------------------------------------------------------------------------------

DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
DENSE = {
    "sims": (
        [],
        f"SELECT q.vec_id AS qid, c.vec_id AS vec_id, c.label AS label, round({DOT.format('q.embedding', 'c.embedding')}, 9) AS score "
        "FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0",
    ),
    "near5": (
        ["sims"],
        "SELECT * FROM (SELECT qid, vec_id, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 5",
    ),
    "inside": (
        ["sims", "near5"],
        "SELECT * FROM (SELECT s.qid, s.vec_id, s.label, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.vec_id) AS rank "
        "FROM sims s JOIN (SELECT DISTINCT qid, label FROM near5) a ON a.qid = s.qid AND a.label = s.label) WHERE rank <= 20",
    ),
}


@query("j10_nearest_global", sql("SELECT qid, rank, vec_id, score FROM near5", "near5", extra=DENSE))
def j10(t: Tables):
    asked, _ = dense_inputs(t)
    found = dense.nearest(asked, t.embeddings, 5)
    return found.select("qid", whole("rank"), "vec_id", "score")


def dense_inputs(t: Tables):
    """Every twentieth vector asks; all are searched."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    stored = t.embeddings.select(F.col("label").alias("document_id"), F.col("vec_id").alias("sentence_id"), "embedding")
    return asked, stored


@query("j11_nearest_within", sql("SELECT qid, rank, vec_id AS sentence_id, score FROM inside", "inside", extra=DENSE))
def j11(t: Tables):
    asked, stored = dense_inputs(t)
    labels = t.embeddings.select("vec_id", F.col("label").alias("document_id"))
    allowed = dense.nearest(asked, t.embeddings, 5).join(labels, "vec_id").select("qid", "document_id")
    found = dense.nearest_within(asked, allowed, stored, 20)
    return found.select("qid", whole("rank"), "sentence_id", "score")


UNIT = "list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
TWO_STAGE = {
    "docs": (
        [],
        "SELECT label AS document_id, list(avg ORDER BY i) AS embedding FROM (SELECT label, i, avg(CAST(e AS DOUBLE)) AS avg FROM "
        "(SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label",
    ),
    "stage1": (
        ["docs"],
        "SELECT * FROM (SELECT qid, document_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id) AS rank FROM "
        f"(SELECT q.vec_id AS qid, d.document_id, round({DOT.format(UNIT, 'd.embedding')}, 9) AS score FROM embeddings q, docs d WHERE q.vec_id % 20 = 0)) WHERE rank <= 5",
    ),
    "stage2": (
        ["stage1"],
        "SELECT * FROM (SELECT qid, document_id, sentence_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sentence_id) AS rank FROM "
        f"(SELECT s.qid, s.document_id, e.vec_id AS sentence_id, round({DOT.format('list_transform(q.embedding, lambda x: -x)', 'e.embedding')}, 9) AS score "
        "FROM stage1 s JOIN embeddings e ON e.label = s.document_id JOIN embeddings q ON q.vec_id = s.qid)) WHERE rank <= 20",
    ),
}


@query("b11_two_stage_dense", sql("SELECT qid, rank, sentence_id, score FROM stage2", "stage2", extra=TWO_STAGE))
def b11(t: Tables):
    asked, stored = dense_inputs(t)
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "e"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    articles = means.groupBy(F.col("label").alias("document_id")).agg(F.transform(ordered, lambda s: s["m"]).alias("embedding"))
    # The two stages ask with different vectors, so that a mix-up would show.
    prompts = asked.select("qid", dense.normalized().alias("embedding"))
    questions = asked.select("qid", F.transform("embedding", lambda x: -x).alias("embedding"))
    found = plan.two_stage_dense(prompts, articles, stored, questions)
    return found.select("qid", whole("rank"), "sentence_id", "score")


# --- sentence rerank -----------------------------------------------------------------------

TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({})))"


def rerank_views():
    from gleanspark.catalog.fixtures import STOP_SQL

    q, s = TOKENS.format("query", STOP_SQL), TOKENS.format("s", STOP_SQL)
    return {
        **VIEWS,
        "context_sentences": (
            ["contexts", "queries"],
            f"SELECT qid, query, context, {SENTENCES_SQL.replace('(text', '(context')} AS s FROM contexts JOIN queries USING (qid)",
        ),
        "sentence_rows": (["context_sentences"], "SELECT qid, query, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM context_sentences WHERE len(s) > 1"),
        "sentence_scores": (["sentence_rows"], f"SELECT qid, i, s, len(list_intersect({q}, {s})) AS pair FROM sentence_rows"),
        "sentence_order": (
            ["context_sentences", "sentence_scores"],
            "SELECT c.qid, len(c.s) AS n_sentences, coalesce(o.joined, c.context) AS context_reranked FROM context_sentences c LEFT JOIN "
            "(SELECT qid, string_agg(s, ' ' ORDER BY pair DESC, i) AS joined FROM sentence_scores GROUP BY qid) o ON o.qid = c.qid",
        ),
    }


def reranked_contexts(t: Tables):
    rows = plan.attach_context(t.questions, t.index, t.chunks_of)
    return rerank.rerank_sentences(rows, pooled_query("prompt", options_array()))


@query(
    "b12_sentence_rerank",
    sql("SELECT qid, n_sentences, md5(context_reranked) AS context_md5 FROM sentence_order", "sentence_order", extra=rerank_views()),
)
def b12(t: Tables):
    return reranked_contexts(t).select("qid", "n_sentences", F.md5("context_reranked").alias("context_md5"))


# --- support -------------------------------------------------------------------------------


@query(
    "b13_oracle_context",
    view(
        "SELECT q.qid, md5(coalesce(x.text, '')) AS context_md5, x.text IS NOT NULL AS oracle_available FROM questions q LEFT JOIN ("
        "SELECT r.qid, min_by(c.text, r.rank) AS text FROM s_ranked r JOIN chunks c USING (chunk_id) JOIN wanted w ON w.qid = r.qid "
        f"WHERE {hit_sql('c.text')} GROUP BY r.qid) x USING (qid)",
        "s_ranked",
        "chunks",
        "wanted",
        "questions",
    ),
)
def b13(t: Tables):
    ranked = plan.retrieve(t.questions, t.index, t.chunks_of, 100)
    rows = support.oracle_contexts(t.questions, ranked)
    return rows.select("qid", F.md5("oracle_context").alias("context_md5"), "oracle_available")


@query("f8_oracle_available", view("SELECT qid FROM hit_ranks WHERE hit_rank > 0", "hit_ranks"))
def f8(t: Tables):
    ranked = plan.retrieve(t.questions, t.index, t.chunks_of, 100)
    return support.oracle_contexts(t.questions, ranked).where("oracle_available").select("qid")


@query(
    "b14_support_hits",
    view(
        "SELECT r.qid, r.rank, " + hit_sql("c.text") + " AS hit FROM s_ranked r JOIN chunks c USING (chunk_id) JOIN wanted w ON w.qid = r.qid WHERE r.rank <= 20",
        "s_ranked",
        "chunks",
        "wanted",
    ),
)
def b14(t: Tables):
    ranked = plan.retrieve(t.questions, t.index, t.chunks_of, 20)
    wanted = support.question_keywords(t.questions)
    return ranked.join(wanted, "qid").select("qid", whole("rank"), support_hit("text", "wanted").alias("hit"))


@query("b15_first_hit_ranks", view("SELECT qid, hit_rank FROM hit_ranks", "hit_ranks"))
def b15(t: Tables):
    return support.retrieve_ranks(t.questions, t.index, t.chunks_of, 100)


@query("a8_first_hit", view("SELECT hit_rank, count(*) AS n_questions FROM hit_ranks GROUP BY hit_rank", "hit_ranks"))
def a8(t: Tables):
    ranks = support.retrieve_ranks(t.questions, t.index, t.chunks_of, 100)
    return ranks.groupBy("hit_rank").agg(F.count(F.lit(1)).alias("n_questions"))


EVAL_SQL = (
    " UNION ALL ".join(
        f"SELECT 'recall@{k}' AS metric, count(*) AS n, round(avg({recall_sql('hit_rank', k)}), 9) AS mean FROM hit_ranks"
        for k in (1, 5, 10, 20, 50, 100)
    )
    + " UNION ALL SELECT 'MRR', count(*), round(avg(CASE WHEN hit_rank > 0 THEN CAST(1 AS DOUBLE) / hit_rank ELSE 0 END), 9) FROM hit_ranks"
    " UNION ALL SELECT 'nDCG@10', count(*), round(avg(CASE WHEN hit_rank BETWEEN 1 AND 10 THEN CAST(1 AS DOUBLE) / log2(hit_rank + 1) ELSE 0 END), 9) FROM hit_ranks"
)


METRIC_ROWS = " UNION ALL ".join(
    [f"SELECT qid, 'recall@{k}' AS metric, {recall_sql('hit_rank', k)} AS score FROM hit_ranks" for k in (1, 5, 10, 20, 50, 100)]
    + [
        "SELECT qid, 'MRR', CASE WHEN hit_rank > 0 THEN CAST(1 AS DOUBLE) / hit_rank ELSE 0 END FROM hit_ranks",
        "SELECT qid, 'nDCG@10', CASE WHEN hit_rank BETWEEN 1 AND 10 THEN CAST(1 AS DOUBLE) / log2(hit_rank + 1) ELSE 0 END FROM hit_ranks",
    ]
)


@query("b16_evaluate_retrieval", view(EVAL_SQL, "hit_ranks"))
def b16(t: Tables):
    ranks = support.retrieve_ranks(t.questions, t.index, t.chunks_of, 100)
    means = support.metric_rows(ranks).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean"))
    return means


def with_ends(report, *keys: str):
    return report.select(*keys, "n", *[rounded(c, 9) for c in ("mean", "ci_lower", "ci_upper")])


@query(
    "b16_evaluate_with_intervals",
    view(f"SELECT metric, n, {ENDS} FROM ({drawn_intervals_sql(f'({METRIC_ROWS})', 'score', 'metric')})", "hit_ranks"),
)
def b16_intervals(t: Tables):
    ranks = support.retrieve_ranks(t.questions, t.index, t.chunks_of, 100)
    return with_ends(support.evaluate_ranks(ranks), "metric")


@query(
    "m7_recall_mrr_ndcg",
    view(
        f"SELECT qid, {recall_sql('hit_rank', 5)} AS recall_5, CASE WHEN hit_rank > 0 THEN round(CAST(1 AS DOUBLE) / hit_rank, 9) ELSE 0 END AS rr, "
        "CASE WHEN hit_rank BETWEEN 1 AND 10 THEN round(CAST(1 AS DOUBLE) / log2(hit_rank + 1), 9) ELSE 0 END AS ndcg FROM hit_ranks",
        "hit_ranks",
    ),
)
def m7(t: Tables):
    ranks = support.retrieve_ranks(t.questions, t.index, t.chunks_of, 100)
    return ranks.select(
        "qid",
        recall_at("hit_rank", 5).alias("recall_5"),
        F.round(reciprocal_rank("hit_rank"), 9).alias("rr"),
        F.round(ndcg_at("hit_rank", 10), 9).alias("ndcg"),
    )


CONTEXT_HIT = "CASE WHEN " + hit_sql("context") + " THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@query("b17_context_hits", view(f"SELECT c.qid, {CONTEXT_HIT} AS score FROM contexts c JOIN wanted w ON w.qid = c.qid", "contexts", "wanted"))
def b17(t: Tables):
    return support.context_hits(plan.attach_context(t.questions, t.index, t.chunks_of))


@query(
    "b18_alignment",
    "SELECT count(*) AS n_rows, count(*) FILTER (item_id % 4 <> 1) AS n_same, count(*) FILTER (item_id % 4 <> 1) >= 0.95 * count(*) AS aligned FROM benchmark",
)
def b18(t: Tables):
    """Written contexts, every fourth of them changed, against those of a second search."""
    path = scratch_path(t.spark, "contexts")
    changed = F.when(F.col("qid") % 4 == 1, F.concat("context", F.lit(" changed"))).otherwise(F.col("context"))
    plan.attach_context(t.questions, t.index, t.chunks_of).select("qid", changed.alias("context")).write.parquet(path)
    stored = t.spark.read.schema("qid long, context string").parquet(path)
    return support.alignment(stored, plan.attach_context(t.questions, build_index(t.chunks), t.chunks_of))


ROLES = ("baseline", "variant", "delta")
INTERVALS = [f"{role}_{end}" for role in ROLES for end in ("ci_lower", "ci_upper")]
COMPARE_COLUMNS = ["baseline_mean", "variant_mean", "delta_mean", *INTERVALS, "rows_changed", "mde"]


def compared(report, *more: str):
    return report.select("n", *[rounded(c, 9) for c in [*COMPARE_COLUMNS, *more]], "resolved")


def compare_sql(a: str, b: str) -> str:
    """A paired comparison of ``(qid, score)`` relations with its intervals from the hashed bootstrap."""
    ends = ", ".join(
        f"max(CASE WHEN role = '{role}' THEN {end} END) AS {role}_{end}" for role in ROLES for end in ("ci_lower", "ci_upper")
    )
    rounds = ", ".join(f"round({c}, 9) AS {c}" for c in COMPARE_COLUMNS)
    return (
        f"SELECT n, {rounds}, delta_ci_lower > 0 OR delta_ci_upper < 0 AS resolved FROM ("
        f"WITH j AS MATERIALIZED (SELECT qid, a.score AS a, b.score AS b FROM {a} a JOIN {b} b USING (qid)), "
        "long AS (SELECT qid, role, CASE role WHEN 'baseline' THEN a WHEN 'variant' THEN b ELSE b - a END AS x FROM j, "
        "(VALUES ('baseline'), ('variant'), ('delta')) r(role)), "
        f"q AS (SELECT {ends} FROM (SELECT role, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper "
        f"FROM ({hashed_means_sql('long', 'qid', 'x', 'role')}) GROUP BY role)), "
        "p AS (SELECT count(*) AS n, avg(a) AS baseline_mean, avg(b) AS variant_mean, avg(b - a) AS delta_mean, "
        "avg(CASE WHEN a <> b THEN CAST(1 AS DOUBLE) ELSE 0 END) AS rows_changed, "
        "CAST(1.96 AS DOUBLE) * stddev_samp(b - a) / sqrt(count(*)) AS mde FROM j) SELECT * FROM p, q)"
    )


@query("b19_two_corpora", view(compare_sql("(SELECT * FROM arms WHERE arm = 'a')", "(SELECT * FROM arms WHERE arm = 'b')"), "arms"))
def b19(t: Tables):
    lists = halves(t)
    a, b = (lists.where(F.col("list_no") == i) for i in (0, 1))
    return compared(plan.compare_recall(t.questions, a, b, hashed=True, resamples=200))


FULL_HIT = f"(SELECT qid, {recall_sql('hit_rank', 5)} AS score FROM hit_ranks)"


@query(
    "b20_coverage_growth",
    view(
        "SELECT *, round((SELECT CAST(count(*) AS DOUBLE) FROM chunks) / (SELECT count(*) FROM chunks_a), 9) AS growth FROM ("
        + compare_sql("(SELECT qid, score FROM arms WHERE arm = 'a')", FULL_HIT)
        + ")",
        "arms",
        "hit_ranks",
        "chunks_a",
    ),
)
def b20(t: Tables):
    small = build_index(t.half(0))
    half = plan.recall_scores(t.questions, plan.retrieve(t.questions, small, t.half_of(0)), "half")
    full = plan.recall_scores(t.questions, plan.retrieve(t.questions, t.index, t.chunks_of), "full")
    sizes = plan.index_sizes({"half": small, "full": t.index})
    report = plan.coverage_growth(half.unionByName(full), sizes, hashed=True, resamples=200)
    return compared(report, "growth")


@query("b21_per_option_vs_pooled", view(compare_sql(FULL_HIT, f"(SELECT qid, {recall_sql('hit_rank', 5)} AS score FROM prompt_hits)"), "hit_ranks", "prompt_hits"))
def b21(t: Tables):
    pooled = plan.retrieve(t.questions, t.index, t.chunks_of)
    fused = support.with_texts(option_search(t), t.chunks_of, t.questions.count() * 5)
    return compared(plan.compare_recall(t.questions, pooled, fused, hashed=True, resamples=200))


def second_segment():
    right = F.get(options_array(), position_of("answer"))
    return F.concat(F.lit(" #### "), F.col("prompt"), F.lit(" [SEP] "), right, F.lit(" [SEP]"))


def words_of(text: str) -> str:
    from gleanspark.catalog.fixtures import words_sql

    return words_sql(text)


def window_views():
    return {
        **rerank_views(),
        "kept": (
            ["contexts", "sentence_order", "option_rows", "wanted"],
            "SELECT qid, wanted, context, "
            f"array_to_string({words_of('context')}[1 : greatest(256 - len({words_of('second')}), 0)], ' ') AS plain, "
            f"array_to_string({words_of('context_reranked')}[1 : greatest(256 - len({words_of('second')}), 0)], ' ') AS moved FROM "
            "(SELECT c.qid, c.context, s.context_reranked, w.wanted, ' #### ' || o.prompt || ' [SEP] ' || o.option || ' [SEP]' AS second FROM contexts c "
            "JOIN sentence_order s USING (qid) JOIN wanted w USING (qid) JOIN option_rows o ON o.qid = c.qid AND o.option_no = o.answer_no)",
        ),
    }


def window_hit(text: str) -> str:
    return f"(SELECT qid, CASE WHEN {hit_sql(text)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM kept)"


@query("b22_window_recall", sql(compare_sql(window_hit("plain"), window_hit("moved")), "kept", extra=window_views()))
def b22(t: Tables):
    rows = materialize(reranked_contexts(t), "contexts")
    wanted = distinctive_keywords(options_array(), position_of("answer"))
    arms = {}
    for name, column in (("plain", "context"), ("moved", "context_reranked")):
        kept = rows.withColumn("__kept", support.kept_context(column, second_segment(), 256))
        arms[name] = kept.select("qid", F.when(support_hit("__kept", wanted), 1.0).otherwise(0.0).alias("score"))
    return compared(stats.compare(arms["plain"], arms["moved"], hashed=True, resamples=200))


@query(
    "b23_truncation",
    sql(
        "SELECT count(*) AS n_rows, sum(k)::BIGINT AS words_kept, sum(g)::BIGINT AS words_given, round(CAST(sum(k) AS DOUBLE) / sum(g), 9) AS share FROM "
        f"(SELECT len({words_of('plain')}) AS k, len({words_of('context')}) AS g FROM kept)",
        "kept",
        extra=window_views(),
    ),
)
def b23(t: Tables):
    rows = plan.attach_context(t.questions, t.index, t.chunks_of)
    report = support.truncation(rows, "context", second_segment(), 256)
    return report.select("n_rows", "words_kept", "words_given", rounded("share", 9))
