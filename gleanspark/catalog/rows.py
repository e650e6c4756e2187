"""Chunking, query texts, layouts, normalisation, row filters and text functions."""

from pyspark.sql import functions as F

from gleanspark.catalog.fixtures import (
    BLANK_SQL,


    Tables,
    collapse_sql,
    keywords_sql,
    sql,
    strip_sql,
    tokens_sql,
    words_sql,
)
from gleanspark.catalog.registry import query
from gleanspark.functions import questions as Q
from gleanspark.functions import text as X
from gleanspark.operators import corpus, readers, selection, support, tiers
from gleanspark.schemas import OPTION_COLUMNS


def long(name: str):
    return F.col(name).cast("long").alias(name)


def digest(name: str, out: str):
    return F.md5(name).alias(out)


@query(
    "p1_windows",
    sql(
        "SELECT article_id AS doc_id, piece_no, md5(text[length(title) + 3 :]) AS piece_md5 FROM chunks", "chunks"
    ),
)
def p1(t: Tables):
    pieces = corpus.explode_chunks(t.documents, ["doc_id"])
    return pieces.select("doc_id", long("piece_no"), digest("piece", "piece_md5"))


P2_SQL = """
SELECT p.first_chunk + i AS chunk_id, a.article_id, p.title, p.section,
       md5(p.title || ': ' || CASE WHEN len(w) <= 200 THEN text ELSE array_to_string(w[i * 200 + 1 : i * 200 + 200], ' ') END) AS text_md5
FROM (SELECT *, CAST(sum(n) OVER (ORDER BY para_no) AS BIGINT) - n AS first_chunk FROM
      (SELECT *, greatest(1, (len(w) + 199) // 200) AS n FROM (SELECT *, {words} AS w FROM {source}))) p
JOIN (SELECT title, row_number() OVER (ORDER BY min(para_no)) - 1 AS article_id FROM {source} GROUP BY title) a USING (title),
unnest(range(0, n)) u(i)
"""


@query("p2_chunk_paragraphs", sql(P2_SQL.format(words=words_sql("text"), source="paragraphs"), "paragraphs"))
def p2(t: Tables):
    return corpus.chunk_paragraphs(t.paragraphs).select(
        "chunk_id", "article_id", "title", "section", digest("text", "text_md5")
    )


ARTICLES = {"arts": ([], "SELECT doc_id AS para_no, 'doc ' || doc_id AS title, '' AS section, text FROM documents WHERE length(text) > 0")}


@query("p3_chunk_articles", sql(P2_SQL.format(words=words_sql("text"), source="arts"), "arts", extra=ARTICLES))
def p3(t: Tables):
    return corpus.chunk_articles(t.articles, "para_no").select(
        "chunk_id", "article_id", "title", "section", digest("text", "text_md5")
    )


@query("p4_pooled_query", sql("SELECT qid, query FROM queries", "queries"))
def p4(t: Tables):
    return support.question_queries(t.questions)


@query("p5_option_queries", sql("SELECT qid, option_no, prompt || ' ' || option AS query FROM option_rows", "option_rows"))
def p5(t: Tables):
    rows = readers.option_rows(t.questions, ["qid", "prompt"])
    return rows.select("qid", long("option_no"), Q.option_query("prompt", "option").alias("query"))


CTX = {
    "ctx": (
        ["option_rows"],
        "SELECT o.*, d.doc_id, d.text AS context FROM option_rows o JOIN documents d ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = o.qid",
    )
}


def with_context(t: Tables):
    """Every document as the context of one question's options."""
    last = F.broadcast(t.benchmark.agg((F.max("item_id") + 1).alias("n")))  # one row
    context = t.documents.crossJoin(last).select((F.col("doc_id") % F.col("n")).alias("qid"), "doc_id", F.col("text").alias("context"))
    return t.option_rows.join(context, "qid")


@query("p6_layout_pair", sql("SELECT doc_id, qid, option_no, md5(context) AS first_md5, prompt || ' ' || option AS second FROM ctx", "ctx", extra=CTX))
def p6(t: Tables):
    rows = with_context(t).select("doc_id", "qid", long("option_no"), *Q.layout_pair("context", "prompt", "option"))
    return rows.select("doc_id", "qid", "option_no", digest("first", "first_md5"), "second")


@query(
    "p7_layout_inference",
    sql("SELECT doc_id, qid, option_no, md5(substr(context, 1, 1750) || ' #### ' || prompt) AS first_md5, option AS second FROM ctx", "ctx", extra=CTX),
)
def p7(t: Tables):
    rows = with_context(t).select("doc_id", "qid", long("option_no"), *Q.layout_inference("context", "prompt", "option"))
    return rows.select("doc_id", "qid", "option_no", digest("first", "first_md5"), "second")


@query(
    "p8_layout_training",
    sql(
        "SELECT doc_id, qid, option_no, md5('[CLS] ' || context) AS first_md5, "
        "' #### ' || prompt || ' [SEP] ' || option || ' [SEP]' AS second FROM ctx",
        "ctx",
        extra=CTX,
    ),
)
def p8(t: Tables):
    rows = with_context(t).select("doc_id", "qid", long("option_no"), *Q.layout_training("context", "prompt", "option"))
    return rows.select("doc_id", "qid", "option_no", digest("first", "first_md5"), "second")


@query(
    "p9_context_clip",
    "SELECT doc_id, CAST(chars AS BIGINT) AS chars, length(substr(text, 1, chars)) AS kept, md5(substr(text, 1, chars)) AS clip_md5 "
    "FROM documents, unnest([1750, 2750, 4000, 5500, 8000]) u(chars)",
)
def p9(t: Tables):
    sizes = [1750, 2750, 4000, 5500, 8000]
    clips = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("chars"), Q.clip("text", n).alias("c")) for n in sizes]))
    rows = t.documents.select("doc_id", clips.alias("x"))
    return rows.select("doc_id", "x.chars", F.length("x.c").cast("long").alias("kept"), F.md5("x.c").alias("clip_md5"))


@query(
    "p10_assemble_context",
    sql("SELECT article_id AS qid, md5(string_agg(text, ' ' ORDER BY piece_no)) AS context_md5 FROM chunks GROUP BY 1", "chunks"),
)
def p10(t: Tables):
    ranked = t.chunks.select(F.col("article_id").alias("qid"), (F.col("chunk_id") % 1000 + 1).alias("rank"), "text")
    asked = t.documents.select(F.col("doc_id").alias("qid"))
    return support.join_contexts(asked, ranked).select("qid", digest("context", "context_md5"))


@query(
    "p11_tier_tag",
    sql("SELECT tier, count(*) AS n_rows FROM (SELECT 'T2' AS tier FROM gold UNION ALL SELECT 'T1' FROM pool) GROUP BY tier", "gold", "pool"),
)
def p11(t: Tables):
    both = tiers.tag(t.gold, "T2").unionByName(tiers.tag(t.pool, "T1"))
    return both.groupBy("tier").agg(F.count(F.lit(1)).alias("n_rows"))


ARC_SQL = (
    "SELECT CAST(qid AS VARCHAR) AS id, 'arc_challenge' AS source, prompt AS question, "
    "array_to_string([A, B, C, D, E], ' | ') AS options, answer FROM questions WHERE qid % 7 <> 0"
)
MMLU_SQL = (
    "SELECT 'mmlu_' || qid AS id, 'mmlu' AS source, CASE qid % 3 WHEN 0 THEN 'astronomy' ELSE 'anatomy' END AS subject, "
    "prompt AS question, array_to_string(CASE WHEN qid % 2 = 0 OR answer = 'E' THEN [A, B, C, D, E] ELSE [A, B, C, D] END, ' | ') AS options, "
    "answer FROM questions WHERE qid % 3 <> 1"
)


@query("p12_normalize_arc", sql(ARC_SQL, "questions"))
def p12(t: Tables):
    rows = tiers.normalize_arc(t.arc_raw)
    return rows.select("id", "source", "question", F.array_join("options", " | ").alias("options"), "answer")


@query("p13_normalize_mmlu", sql(MMLU_SQL, "questions"))
def p13(t: Tables):
    rows = tiers.normalize_mmlu(t.mmlu_raw, tiers.STEM_SUBJECTS)
    return rows.select("id", "source", "subject", "question", F.array_join("options", " | ").alias("options"), "answer")


@query(
    "p14_options_to_columns",
    sql(
        "SELECT 'mmlu_' || qid AS id, A, B, C, D, CASE WHEN qid % 2 = 0 OR answer = 'E' THEN E ELSE '' END AS E "
        "FROM questions WHERE qid % 3 <> 1",
        "questions",
    ),
)
def p14(t: Tables):
    return tiers.widen_options(tiers.normalize_mmlu(t.mmlu_raw, tiers.STEM_SUBJECTS)).select("id", *OPTION_COLUMNS)


@query(
    "p15_letter_index",
    sql("SELECT doc_id, answer, CAST(ascii(answer) - 65 AS BIGINT) AS position, answer AS letter FROM pool_all", "pool_all"),
)
def p15(t: Tables):
    at = Q.position_of("answer")
    return t.pool_all.select("doc_id", "answer", at.cast("long").alias("position"), Q.letter_of(at).alias("letter"))


@query(
    "p16_fill_null_options",
    sql(
        "SELECT doc_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in "ABCDE") + " FROM pool_all", "pool_all"
    ),
)
def p16(t: Tables):
    return tiers.apply_null_policy(t.pool_all, "empty").select("doc_id", *OPTION_COLUMNS)


@query("p17_replace_context", sql("SELECT doc_id, md5(prompt) AS context_md5 FROM pool", "pool"))
def p17(t: Tables):
    ranked = t.pool.select(F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), F.col("prompt").alias("text"))
    stale = t.pool.withColumnRenamed("doc_id", "qid")
    fresh = support.join_contexts(stale.drop("context"), ranked)
    return fresh.select(F.col("qid").alias("doc_id"), digest("context", "context_md5"))


@query("p18_predictions", sql("SELECT arm, qid, array_to_string(letters[1:3], ' ') AS prediction FROM letters", "letters"))
def p18(t: Tables):
    return readers.predictions(t.both_logits, 3, ["arm", "qid"])


@query(
    "p19_fallback",
    sql(
        "SELECT d.doc_id AS qid, coalesce(array_to_string(l.letters[1:3], ' '), 'A B C') AS prediction "
        "FROM documents d LEFT JOIN (SELECT * FROM letters WHERE arm = 'r0') l ON l.qid = d.doc_id",
        "letters",
    ),
)
def p19(t: Tables):
    asked = t.documents.select(F.col("doc_id").alias("qid"))
    return readers.with_fallback(asked, readers.predictions(t.logits(0)))


@query(
    "f1_drop_null_options",
    sql(
        "SELECT count(*) AS n_rows, count(*) FILTER (A IS NOT NULL AND B IS NOT NULL AND C IS NOT NULL AND D IS NOT NULL AND E IS NOT NULL) AS n_kept, "
        "sum(doc_id) FILTER (A IS NOT NULL AND B IS NOT NULL AND C IS NOT NULL AND D IS NOT NULL AND E IS NOT NULL)::BIGINT AS id_sum FROM pool_all",
        "pool_all",
    ),
)
def f1(t: Tables):
    kept = tiers.apply_null_policy(t.pool_all, "drop").select("doc_id", F.lit(True).alias("kept"))
    marked = t.pool_all.select("doc_id").join(kept, "doc_id", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("kept").alias("n_kept"),
        F.sum(F.when(F.col("kept"), F.col("doc_id"))).alias("id_sum"),
    )


@query("f2_drop_empty_text", "SELECT source, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE length(text) > 0 GROUP BY source")
def f2(t: Tables):
    filled = t.documents.where(F.length("text") > 0)
    return filled.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("f3_stem_subjects", sql("SELECT qid AS row_no FROM questions WHERE qid % 3 <> 1", "questions"))
def f3(t: Tables):
    return tiers.only_subjects(t.mmlu_raw).select("row_no")


@query("f4_source_slice", sql("SELECT doc_id, answer FROM pool_all WHERE source = 'src2'", "pool_all"))
def f4(t: Tables):
    return t.pool_all.where(F.col("source") == "src2").select("doc_id", "answer")


# RE2 has no look-behind: mark the boundaries, then split at the marks.
SENTENCES_SQL = (
    "list_filter(list_transform(string_split(regexp_replace(" + strip_sql("text") + ", "
    "'([.!?][\"'')]?)[" + BLANK_SQL + "]+([A-Z0-9=*(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), "
    "lambda s: " + strip_sql("s") + "), lambda s: length(s) > 3)"
)


@query(
    "f5_min_sentence_length",
    f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 "
    f"FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)",
)
def f5(t: Tables):
    rows = t.documents.select("doc_id", X.sentences("text").alias("s"))
    return rows.select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5")
    )


@query("f6_head", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def f6(t: Tables):
    return selection.first_rows(t.documents.select("doc_id", "n_chars"), ["doc_id"], 25)


@query(
    "f9_label_domain",
    sql("SELECT answer, answer IN ('A', 'B', 'C', 'D', 'E') AS valid, count(*) AS n_rows FROM pool_all GROUP BY ALL", "pool_all"),
)
def f9(t: Tables):
    rows = tiers.require_answers(t.pool_all)
    valid = (Q.position_of("answer") >= 0).alias("valid")
    return rows.groupBy("answer", valid).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "fn_words",
    f"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5, md5({collapse_sql('text')}) AS flat_md5 "
    f"FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents)",
)
def fn_words(t: Tables):
    rows = t.documents.select("doc_id", "text", X.words("text").alias("w"))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.md5(F.array_join("w", " ")).alias("words_md5"),
        F.md5(X.collapse("text")).alias("flat_md5"),
    )


@query(
    "fn_tokens",
    f"SELECT doc_id, len(k) AS n_tokens, md5(array_to_string(k, ' ')) AS tokens_md5 "
    f"FROM (SELECT doc_id, {tokens_sql('text')} AS k FROM documents)",
)
def fn_tokens(t: Tables):
    rows = t.documents.select("doc_id", X.tokens("text").alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("tokens_md5"))


@query(
    "fn_shingles",
    f"SELECT doc_id, count(*) AS n_shingles, md5(string_agg(g, '|' ORDER BY g)) AS shingles_md5 FROM "
    f"(SELECT DISTINCT doc_id, CASE WHEN length(f) < 5 THEN f ELSE substr(f, i, 5) END AS g FROM "
    f"(SELECT doc_id, {collapse_sql('text')} AS f FROM documents), unnest(range(1, greatest(length(f) - 3, 2))) u(i)) GROUP BY doc_id",
)
def fn_shingles(t: Tables):
    rows = t.documents.select("doc_id", X.shingles("text").alias("g"))
    text = F.array_join(F.array_sort("g"), "|")
    return rows.select("doc_id", F.size("g").cast("long").alias("n_shingles"), F.md5(text).alias("shingles_md5"))


@query(
    "fn_keywords",
    f"SELECT doc_id, len(k) AS n_keywords, md5(array_to_string(list_sort(k), ' ')) AS keywords_md5 "
    f"FROM (SELECT doc_id, {keywords_sql('text')} AS k FROM documents)",
)
def fn_keywords(t: Tables):
    rows = t.documents.select("doc_id", F.array_sort(X.keywords("text")).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_keywords"), F.md5(F.array_join("k", " ")).alias("keywords_md5"))


PHRASES_SQL = (
    "SELECT item_id, count(*) AS n_phrases, md5(string_agg(g, '|' ORDER BY g)) AS phrases_md5 FROM "
    "(SELECT DISTINCT item_id, array_to_string(w[i : i + n - 1], ' ') AS g FROM "
    "(SELECT item_id, regexp_extract_all(lower(text), '[A-Za-z0-9]+') AS w FROM benchmark), unnest([2, 3, 4]) v(n), "
    "unnest(range(1, len(w) + 1)) u(i) WHERE i + n - 1 <= len(w)) GROUP BY item_id"
)


@query("fn_phrases", PHRASES_SQL)
def fn_phrases(t: Tables):
    rows = t.benchmark.select("item_id", X.phrases("text").alias("g"))
    text = F.array_join(F.array_sort("g"), "|")
    return rows.select("item_id", F.size("g").cast("long").alias("n_phrases"), F.md5(text).alias("phrases_md5"))


@query(
    "fn_sentence_offsets",
    sql(
        "SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (contains(text, s)) AS n_found, "
        "md5(string_agg(s, chr(10) ORDER BY i)) AS sentences_md5 FROM "
        f"(SELECT doc_id, text, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, text, {SENTENCES_SQL} AS s FROM documents)) GROUP BY doc_id"
    ),
)
def fn_sentence_offsets(t: Tables):
    rows = t.documents.select("doc_id", "text", X.sentences_with_offsets("text").alias("s"))
    found = F.filter("s", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["text"])
    return rows.where(F.size("s") > 0).select(
        "doc_id",
        F.size("s").cast("long").alias("n_sentences"),
        F.size(found).cast("long").alias("n_found"),
        F.md5(F.array_join(F.transform("s", lambda s: s["text"]), "\n")).alias("sentences_md5"),
    )
