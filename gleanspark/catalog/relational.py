"""Joins, aggregations, windows, set operations, sampling and splitting."""

from pyspark.sql import functions as F

from gleanspark.catalog.fixtures import Tables, collapse_sql, sql
from gleanspark.catalog.registry import query
from gleanspark.operators import corpus, joins, neardup, ordering, quality, readers, selection, tiers
from gleanspark.operators.bm25 import build_index
from gleanspark.schemas import OPTION_COLUMNS, QUESTION_KEY

KEY_SQL = " AND ".join(f"l.{c} IS NOT DISTINCT FROM r.{c}" for c in QUESTION_KEY)
KEY_LIST = ", ".join(QUESTION_KEY)


def count(name: str = "n_rows"):
    return F.count(F.lit(1)).alias(name)


# --- joins ---------------------------------------------------------------------------------


@query(
    "j1_attach_on_all_keys",
    sql(
        f"SELECT l.doc_id, r.context FROM pool l LEFT JOIN (SELECT {KEY_LIST}, min(context) AS context FROM pool_all GROUP BY ALL) r ON {KEY_SQL}",
        "pool",
        "pool_all",
    ),
)
def j1(t: Tables):
    source = t.pool_all.groupBy(*QUESTION_KEY).agg(F.min("context").alias("context"))
    attached = joins.attach(t.pool.drop("context"), source, QUESTION_KEY, ["context"])
    return joins.require_attached(attached, "doc_id", "context").select("doc_id", "context")


@query(
    "j1_attach_checks",
    sql(
        f"SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) FILTER (context IS NULL) AS n_missing, "
        f"CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) AS n_surplus FROM "
        f"(SELECT l.doc_id, r.context FROM pool l LEFT JOIN gold r ON l.prompt = r.prompt)",
        "pool",
        "gold",
    ),
)
def j1_checks(t: Tables):
    attached = joins.attach(t.pool.drop("context"), t.gold, ["prompt"], ["context"])
    return joins.check_attached(attached, "doc_id", "context")


@query(
    "j2_pool_minus_dev",
    sql(
        f"SELECT md5(prompt) AS prompt_md5, A, B, C, D, E, answer FROM (SELECT DISTINCT {KEY_LIST} FROM pool l "
        f"WHERE NOT EXISTS (SELECT 1 FROM dev r WHERE {KEY_SQL}))",
        "pool",
        "dev",
    ),
)
def j2(t: Tables):
    rest = joins.without(t.pool, t.dev).select(*QUESTION_KEY).distinct()
    return rest.select(F.md5("prompt").alias("prompt_md5"), *OPTION_COLUMNS, "answer")


@query(
    "j3_prompt_anti_join",
    sql(
        "SELECT doc_id, 'left' AS part FROM pool WHERE prompt NOT IN (SELECT prompt FROM gold) "
        "UNION ALL SELECT doc_id, 'shared' FROM pool WHERE prompt IN (SELECT prompt FROM gold)",
        "pool",
        "gold",
    ),
)
def j3(t: Tables):
    left = joins.without(t.pool, t.gold, ["prompt"]).select("doc_id", F.lit("left").alias("part"))
    shared = joins.within(t.pool, t.gold, ["prompt"]).select("doc_id", F.lit("shared").alias("part"))
    return left.unionByName(shared)


@query(
    "j4_first_context_per_prompt",
    sql(
        "SELECT d.doc_id, p.context FROM gold d LEFT JOIN (SELECT prompt, arg_min(context, doc_id) AS context FROM pool GROUP BY prompt) p "
        "ON p.prompt = d.prompt",
        "gold",
        "pool",
    ),
)
def j4(t: Tables):
    attached = joins.attach_first(t.gold.drop("context"), t.pool, "prompt", ["context"], "doc_id")
    return attached.select("doc_id", "context")


NEAR = {
    "flat": (["pool_all"], f"SELECT doc_id, {collapse_sql('prompt')} AS f, doc_id IN (SELECT doc_id FROM labels) AS is_gold FROM pool_all"),
    "grams": (
        ["flat"],
        "SELECT DISTINCT doc_id, is_gold, CASE WHEN length(f) < 5 THEN f ELSE substr(f, i, 5) END AS g "
        "FROM flat, unnest(range(1, greatest(length(f) - 3, 2))) u(i)",
    ),
    "sizes": (["grams"], "SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id"),
    "shared": (
        ["grams", "sizes"],
        "SELECT p.doc_id, q.doc_id AS other, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common "
        "FROM grams p JOIN sizes a ON a.doc_id = p.doc_id JOIN grams q ON p.g = q.g JOIN sizes b ON b.doc_id = q.doc_id "
        "WHERE NOT p.is_gold AND q.is_gold AND least(a.n, b.n) >= 0.79 * greatest(a.n, b.n) GROUP BY ALL",
    ),
    "near": (
        ["shared"],
        "SELECT DISTINCT doc_id FROM shared WHERE CAST(common AS DOUBLE) / (n + m - common) >= CAST(0.8 AS DOUBLE)",
    ),
}


@query(
    "j5_near_duplicates",
    sql("SELECT doc_id, doc_id IN (SELECT doc_id FROM near) AS near_duplicate FROM pool", "near", "pool", extra=NEAR),
)
def j5(t: Tables):
    return neardup.mark_near_duplicates(t.pool, t.gold).select("doc_id", "near_duplicate")


@query("f7_drop_near_duplicates", sql("SELECT doc_id, answer FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM near)", "near", "pool", extra=NEAR))
def f7(t: Tables):
    return neardup.drop_near_duplicates(t.pool, t.gold).select("doc_id", "answer")


@query(
    "j8_pair_scores",
    sql("SELECT a.qid, a.score AS a, b.score AS b, b.score - a.score AS difference FROM scores a JOIN scores b USING (qid) WHERE a.arm = 'r0' AND b.arm = 'r1'", "scores"),
)
def j8(t: Tables):
    from gleanspark.operators.stats import paired

    scores = readers.precision_rows(t.both_logits, t.answers, 3, ["arm", "qid"])
    return paired(scores.where("arm = 'r0'"), scores.where("arm = 'r1'"))


@query(
    "j9_membership_join",
    "SELECT l.doc_id, e.vec_id FROM labels l JOIN documents d USING (doc_id) JOIN embeddings e ON e.label = d.doc_id",
)
def j9(t: Tables):
    allowed = joins.within(t.documents, t.labels, ["doc_id"]).select("doc_id")
    return allowed.join(t.embeddings.select(F.col("label").cast("long").alias("doc_id"), "vec_id"), "doc_id")


@query(
    "j12_changed_rows",
    sql(
        "SELECT count(*) AS n_rows, count(*) FILTER (a.context IS DISTINCT FROM b.context) AS n_changed FROM pool_all a JOIN "
        "(SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN context ELSE context || '!' END AS context FROM pool_all) b USING (doc_id)",
        "pool_all",
    ),
)
def j12(t: Tables):
    other = joins.mark_overlap(t.pool_all, t.labels, ["doc_id"], "labelled").withColumn(
        "context", F.when(F.col("labelled"), F.col("context")).otherwise(F.concat("context", F.lit("!")))
    )
    return joins.changed_rows(t.pool_all, other, "doc_id", "context")


@query("j13_overlap_flag", sql("SELECT doc_id, prompt IN (SELECT prompt FROM gold) AS shared FROM pool", "pool", "gold"))
def j13(t: Tables):
    return joins.mark_overlap(t.pool, t.gold, ["prompt"], "shared").select("doc_id", "shared")


@query(
    "j14_title_ids",
    sql(
        "SELECT p.para_no, a.article_id FROM paragraphs p JOIN (SELECT title, row_number() OVER (ORDER BY min(para_no)) - 1 AS article_id "
        "FROM paragraphs GROUP BY title) a USING (title)",
        "paragraphs",
    ),
)
def j14(t: Tables):
    return t.paragraphs.join(corpus.article_ids(t.paragraphs, "para_no"), "title").select("para_no", "article_id")


# --- aggregations --------------------------------------------------------------------------

TERMS = {
    "tok": (["chunks"], "SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM chunks"),
}


@query(
    "a1_term_statistics",
    sql(
        "SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM tok GROUP BY term", "tok", extra=TERMS
    ),
)
def a1(t: Tables):
    from gleanspark.operators.bm25 import Bm25Parameters

    index = build_index(t.chunks, Bm25Parameters(stopwords=[]))
    return index.postings.groupBy("term").agg(count("df"), F.sum("tf").alias("tf"))


@query(
    "a1_corpus_totals",
    sql(
        "SELECT (SELECT count(*) FROM chunks) AS n_chunks, round(CAST((SELECT count(*) FROM tok) AS DOUBLE) / (SELECT count(*) FROM chunks), 9) AS avg_dl",
        "tok",
        "chunks",
        extra=TERMS,
    ),
)
def a1_totals(t: Tables):
    from gleanspark.operators.bm25 import Bm25Parameters

    index = build_index(t.chunks, Bm25Parameters(stopwords=[]))
    return index.totals.select("n_chunks", F.round("avg_dl", 9).alias("avg_dl"))


@query("a2_mean_score", sql("SELECT arm, round(avg(score), 9) AS mean FROM scores GROUP BY arm", "scores"))
def a2(t: Tables):
    scores = readers.precision_rows(t.both_logits, t.answers, 3, ["arm", "qid"])
    return scores.groupBy("arm").agg(F.round(F.avg("score"), 9).alias("mean"))


@query(
    "a3_exact_quantiles",
    "SELECT round(quantile_cont(CAST(n_chars AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6) AS p50, "
    "round(quantile_cont(CAST(n_chars AS DOUBLE), 0.9), 6) AS p90 FROM documents",
)
def a3(t: Tables):
    found = ordering.exact_quantiles(t.documents, "n_chars", [0.1, 0.5, 0.9])
    at = lambda p: F.round(F.max(F.when(F.col("prob") == p, F.col("quantile"))), 6)
    return found.agg(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("a4_value_counts", sql("SELECT source, answer, count(*) AS n_rows FROM pool_all GROUP BY ALL", "pool_all"))
def a4(t: Tables):
    return quality.value_counts(t.pool_all, ["source", "answer"])


@query("a5_distinct_count", "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_repeated FROM documents")
def a5(t: Tables):
    return quality.repeated_values(t.documents, "text")


@query(
    "a6_null_rates",
    sql(
        "SELECT source, count(*) AS n_rows, count(*) FILTER (A IS NULL) AS n_null_a, round(avg(CAST(A IS NULL AS INTEGER)), 9) AS rate_a FROM pool_all GROUP BY source",
        "pool_all",
    ),
)
def a6(t: Tables):
    missing = F.col("A").isNull()
    rate = F.round(F.avg(F.when(missing, 1.0).otherwise(0.0)), 9)
    return t.pool_all.groupBy("source").agg(count(), F.count_if(missing).alias("n_null_a"), rate.alias("rate_a"))


@query(
    "a7_crosstab",
    "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality",
)
def a7(t: Tables):
    table = t.labels.groupBy("quality").pivot("toxic", [0, 1]).count()
    return table.select(
        "quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1")
    )


@query(
    "a11_rows_changed",
    sql(
        "SELECT round(avg(CASE WHEN a.score <> b.score THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS rows_changed FROM scores a JOIN scores b USING (qid) "
        "WHERE a.arm = 'r0' AND b.arm = 'r1'",
        "scores",
    ),
)
def a11(t: Tables):
    from gleanspark.operators.stats import paired

    scores = readers.precision_rows(t.both_logits, t.answers, 3, ["arm", "qid"])
    pairs = paired(scores.where("arm = 'r0'"), scores.where("arm = 'r1'"))
    return pairs.agg(F.round(F.avg(F.when(F.col("a") != F.col("b"), 1.0).otherwise(0.0)), 9).alias("rows_changed"))


@query(
    "a12_logit_spread",
    sql("SELECT arm, round(avg(s), 9) AS spread FROM (SELECT arm, qid, max(logit) - min(logit) AS s FROM logits GROUP BY arm, qid) GROUP BY arm", "logits"),
)
def a12(t: Tables):
    return readers.logit_spread(t.both_logits, ["arm"]).select("arm", F.round("spread", 9).alias("spread"))


@query(
    "a14_argmax",
    "SELECT lang, arg_max(source, n * 1000 - num) AS source FROM (SELECT lang, source, count(*) AS n, CAST(source[4:] AS BIGINT) AS num "
    "FROM documents GROUP BY ALL) GROUP BY lang",
)
def a14(t: Tables):
    counted = t.documents.groupBy("lang", "source").agg(count("n"))
    number = F.substring("source", 4, 9).cast("long")
    return counted.groupBy("lang").agg(F.max_by("source", F.struct("n", -number)).alias("source"))


# --- windows, sorting, top-k ---------------------------------------------------------------


@query(
    "w1_top_k_per_group",
    "SELECT source, rank, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank "
    "FROM documents) WHERE rank <= 5",
)
def w1(t: Tables):
    best = selection.top_k(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 5)
    return best.select("source", F.col("rank").cast("long").alias("rank"), "doc_id")


@query(
    "w2_rank_in_list",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations",
)
def w2(t: Tables):
    ranked = selection.rank_within(t.read("conversations"), ["conv_id"], [F.length("text").desc(), F.col("turn")])
    return ranked.select("conv_id", "turn", F.col("rank").cast("long").alias("rank"))


@query("w3_keep_first", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def w3(t: Tables):
    first = selection.keep_first(t.documents.select("doc_id", "text"), ["text"], ["doc_id"])
    return first.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "w4_dense_ids",
    sql("SELECT title, row_number() OVER (ORDER BY min(para_no)) - 1 AS article_id FROM paragraphs GROUP BY title", "paragraphs"),
)
def w4(t: Tables):
    return corpus.article_ids(t.paragraphs, "para_no")


@query(
    "w5_first_n_articles",
    sql(
        "SELECT para_no, title FROM paragraphs WHERE para_no < (SELECT f FROM (SELECT min(para_no) AS f FROM paragraphs GROUP BY title) ORDER BY f LIMIT 1 OFFSET 10)",
        "paragraphs",
    ),
)
def w5(t: Tables):
    return corpus.slice_by_article_count(t.paragraphs, 10).select("para_no", "title")


@query(
    "w6_option_order",
    sql("SELECT arm, qid, array_to_string(letters, '') AS letters FROM letters", "letters"),
)
def w6(t: Tables):
    return readers.ranked_letters(t.both_logits, ["arm", "qid"]).select("arm", "qid", F.array_join("letters", "").alias("letters"))


@query(
    "w7_option_ranks",
    sql("SELECT arm, qid, option_no, row_number() OVER (PARTITION BY arm, qid ORDER BY logit DESC, option_no) - 1 AS rank FROM logits", "logits"),
)
def w7(t: Tables):
    ranked = readers.option_ranks(t.both_logits, ["arm", "qid"], 0)
    return ranked.select("arm", "qid", F.col("option_no").cast("long").alias("option_no"), F.col("rank").cast("long").alias("rank"))


@query("w10_sort_by_offset", sql("SELECT article_id, piece_no, row_number() OVER (ORDER BY article_id, piece_no) - 1 AS position FROM chunks", "chunks"))
def w10(t: Tables):
    pieces = corpus.explode_chunks(t.documents.select("doc_id", "text"), ["doc_id"]).select(
        F.col("doc_id").alias("article_id"), F.col("piece_no").cast("long").alias("piece_no")
    )
    keyed = pieces.withColumn("k", F.col("article_id") * 100000 + F.col("piece_no"))
    return ordering.running_total(keyed, "k", None, "position").drop("k")


@query(
    "w11_running_counter",
    "SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) - n_chars AS chars_before FROM documents",
)
def w11(t: Tables):
    rows = t.documents.select("doc_id", "n_chars")
    return ordering.running_total(rows, "doc_id", F.col("n_chars"), "chars_before", rows_per_bucket=100).drop("n_chars")


@query("w12_longest", "SELECT doc_id, length(text) AS n_chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20")
def w12(t: Tables):
    return selection.longest(t.documents, "text", "doc_id", 20).select("doc_id", F.length("text").cast("long").alias("n_chars"))


# --- set operations ------------------------------------------------------------------------


@query("u1_concat", sql("SELECT answer, count(*) AS n_rows FROM (SELECT answer FROM pool UNION ALL SELECT answer FROM gold) GROUP BY answer", "pool", "gold"))
def u1(t: Tables):
    both = t.pool.select(*QUESTION_KEY).unionByName(t.gold.select(*QUESTION_KEY))
    return both.groupBy("answer").agg(count())


@query(
    "u2_shared_rows",
    sql(f"SELECT count(*) AS n_shared FROM (SELECT {KEY_LIST} FROM pool INTERSECT SELECT {KEY_LIST} FROM gold)", "pool", "gold"),
)
def u2(t: Tables):
    return quality.shared_rows(t.pool, t.gold)


@query(
    "u3_row_set_equality",
    sql(
        "SELECT (SELECT count(*) FROM (SELECT prompt FROM pool EXCEPT ALL SELECT prompt FROM gold)) AS n_only_left, "
        "(SELECT count(*) FROM (SELECT prompt FROM gold EXCEPT ALL SELECT prompt FROM pool)) AS n_only_right",
        "pool",
        "gold",
    ),
)
def u3(t: Tables):
    return joins.same_rows(t.pool.select("prompt"), t.gold.select("prompt"))


@query("u4_keyword_difference", sql("SELECT qid, array_to_string(list_sort(wanted), ' ') AS wanted FROM wanted", "wanted"))
def u4(t: Tables):
    from gleanspark.operators.support import question_keywords

    return question_keywords(t.questions).select("qid", F.array_join(F.array_sort("wanted"), " ").alias("wanted"))


PAIRED = {
    "pairs": ([], "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"),
    "pgrams": (
        ["pairs"],
        "SELECT DISTINCT conv_id, turn, side, CASE WHEN length(f) < 5 THEN f ELSE substr(f, i, 5) END AS g FROM "
        f"(SELECT conv_id, turn, 'x' AS side, {collapse_sql('x')} AS f FROM pairs UNION ALL SELECT conv_id, turn, 'y', {collapse_sql('y')} FROM pairs), "
        "unnest(range(1, greatest(length(f) - 3, 2))) u(i)",
    ),
}


@query(
    "u5_jaccard",
    sql(
        "SELECT conv_id, turn, round(CAST(count(*) FILTER (n = 2) AS DOUBLE) / count(*), 9) AS similarity FROM "
        "(SELECT conv_id, turn, g, count(*) AS n FROM pgrams GROUP BY ALL) GROUP BY ALL",
        "pgrams",
        extra=PAIRED,
    ),
)
def u5(t: Tables):
    turns = t.read("conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    pairs = turns.join(following, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(neardup.jaccard("text", "y"), 9).alias("similarity"))


@query(
    "u6_subset_check",
    "SELECT count(*) AS n_missing, count(*) = 0 AS is_subset FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)",
)
def u6(t: Tables):
    return quality.subset_check(t.labels, t.documents, ["doc_id"])


# --- sampling and splitting ----------------------------------------------------------------


@query(
    "r1_build_t1",
    sql(
        "SELECT doc_id, 'T1' AS tier FROM (SELECT min(doc_id) AS doc_id, prompt FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM near) GROUP BY prompt) "
        "ORDER BY md5('42|' || prompt) LIMIT 50",
        "near",
        "pool",
        extra=NEAR,
    ),
)
def r1(t: Tables):
    return tiers.build_t1(t.pool, t.gold, "doc_id", 50).select("doc_id", "tier")


@query(
    "r2_build_t3",
    sql(
        "SELECT source, id, 'T3' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || question), question) AS r FROM "
        "(SELECT source, question, min(id) AS id FROM (SELECT 'arc_challenge' AS source, prompt AS question, CAST(qid AS VARCHAR) AS id FROM questions WHERE qid % 7 <> 0 "
        "UNION ALL SELECT 'mmlu', prompt, 'mmlu_' || qid FROM questions WHERE qid % 3 <> 1) GROUP BY source, question)) WHERE r <= 20",
        "questions",
    ),
)
def r2(t: Tables):
    arc = tiers.normalize_arc(t.arc_raw)
    mmlu = tiers.normalize_mmlu(t.mmlu_raw, tiers.STEM_SUBJECTS)
    return tiers.build_t3(arc, mmlu, "id", 20).select("source", "id", "tier")


@query(
    "r3_hash_sample",
    "SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5('42|' || doc_id), 1, 13) AS BIGINT) < 0.14 * 4503599627370496",
)
def r3(t: Tables):
    return selection.sample_share(t.documents, "doc_id", 0.14).select("doc_id")


SPLIT_SQL = (
    "SELECT doc_id, answer, prompt, CASE WHEN drawn < 100 THEN 'monitor' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || prompt), prompt) - 1 AS drawn FROM "
    "(SELECT * FROM pool WHERE doc_id IN (SELECT min(doc_id) FROM pool WHERE prompt NOT IN (SELECT prompt FROM dev) AND prompt NOT IN (SELECT prompt FROM gold) GROUP BY prompt))) WHERE drawn < 300"
)
SPLIT = {"parts": (["pool", "dev", "gold"], SPLIT_SQL)}


@query("r4_disjoint_split", sql("SELECT doc_id, part FROM parts", "parts", extra=SPLIT))
def r4(t: Tables):
    return tiers.split_train_monitor(t.pool, t.dev, t.gold, "doc_id", 100, 200).select("doc_id", "part")


@query("r5_seeded_subset", "SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 120")
def r5(t: Tables):
    return selection.sample_exact(t.documents, "doc_id", 120, 7).select("doc_id")


@query(
    "r6_train_pool",
    sql(
        "SELECT doc_id FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM near) AND prompt NOT IN (SELECT prompt FROM dev)",
        "near",
        "pool",
        "dev",
        extra=NEAR,
    ),
)
def r6(t: Tables):
    return tiers.build_train_pool(t.pool, t.gold, t.dev).select("doc_id")


@query(
    "r7_split_checks",
    sql(
        "SELECT count(DISTINCT prompt) FILTER (part = 'train' AND prompt IN (SELECT prompt FROM dev)) AS train_in_dev, "
        "count(DISTINCT prompt) FILTER (part = 'monitor' AND prompt IN (SELECT prompt FROM dev)) AS monitor_in_dev, "
        "count(DISTINCT prompt) FILTER (part = 'train' AND prompt IN (SELECT prompt FROM gold)) AS train_in_gold, "
        "CAST(0 AS BIGINT) AS train_in_monitor, count(*) FILTER (answer NOT IN ('A', 'B', 'C', 'D', 'E')) AS bad_answers FROM parts",
        "parts",
        extra=SPLIT,
    ),
)
def r7(t: Tables):
    parts = tiers.split_train_monitor(t.pool, t.dev, t.gold, "doc_id", 100, 200)
    return tiers.split_violations(parts, t.dev, t.gold)
