"""Metrics, intervals, comparisons, readers and ensembles."""

from pyspark.sql import functions as F

from gleanspark.catalog.fixtures import Tables, sql
from gleanspark.catalog.registry import query
from gleanspark.catalog.retrieval import CONTEXT_HIT, ENDS, compare_sql, compared, drawn_intervals_sql, hashed_means_sql, hit_sql, with_ends
from gleanspark.catalog.retrieval import VIEWS as RETRIEVAL
from gleanspark.functions import scores as S
from gleanspark.functions.questions import layout_pair, options_array, pooled_query
from gleanspark.operators import readers, rerank, selection, stats, support
from gleanspark.operators.bm25 import build_index
from gleanspark.plans import attribution, inference
from gleanspark.plans import retrieval as plan
from gleanspark.runtime import materialize, scratch_path
from gleanspark.sources import readers as R
from gleanspark.sources import writers as W


def rounded(name: str, digits: int = 9):
    return F.round(name, digits).alias(name)


def whole(name: str):
    return F.col(name).cast("long").alias(name)


def scored(t: Tables):
    return readers.precision_rows(t.both_logits, t.answers, 3, ["arm", "qid"])


def arm(t: Tables, name: str):
    return scored(t).where(F.col("arm") == name)


ARM = "(SELECT * FROM scores WHERE arm = '{}')"


@query("m1_average_precision", sql("SELECT arm, qid, round(score, 9) AS score FROM scores", "scores"))
def m1(t: Tables):
    return scored(t).select("arm", "qid", rounded("score"))


@query(
    "m1_precision_by_k",
    sql(
        "SELECT arm, qid, CAST(k AS BIGINT) AS k, CASE WHEN list_position(letters[1:k], answer) > 0 "
        "THEN round(CAST(1 AS DOUBLE) / list_position(letters[1:k], answer), 9) ELSE CAST(0 AS DOUBLE) END AS score "
        "FROM letters JOIN answers USING (qid), unnest(range(1, 6)) u(k)",
        "letters",
        "answers",
    ),
)
def m1_by_k(t: Tables):
    rows = readers.ranked_letters(t.both_logits, ["arm", "qid"]).join(t.answers, "qid")
    per_k = [F.struct(F.lit(k).cast("long").alias("k"), S.average_precision("answer", "letters", k).alias("s")) for k in range(1, 6)]
    return rows.select("arm", "qid", F.explode(F.array(*per_k)).alias("x")).select("arm", "qid", "x.k", F.round("x.s", 9).alias("score"))


@query("m2_map_at_3", sql("SELECT arm, count(*) AS n, round(avg(score), 9) AS map3 FROM scores GROUP BY arm", "scores"))
def m2(t: Tables):
    return scored(t).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("map3"))


@query(
    "m3_random_baseline",
    sql(
        "SELECT arm, round(avg(score), 9) AS map3, round((CAST(1 AS DOUBLE) + CAST(1 AS DOUBLE) / 2 + CAST(1 AS DOUBLE) / 3) / 5, 9) AS baseline FROM scores GROUP BY arm",
        "scores",
    ),
)
def m3(t: Tables):
    means = scored(t).groupBy("arm").agg(F.round(F.avg("score"), 9).alias("map3"))
    return means.withColumn("baseline", F.round(S.random_baseline(5, 3), 9))


@query(
    "m4_bootstrap_ci",
    sql(f"SELECT arm, n, {ENDS} FROM ({drawn_intervals_sql('scores', 'score', 'arm')})", "scores"),
)
def m4(t: Tables):
    return with_ends(stats.bootstrap_ci(scored(t), "score", ["arm"]), "arm")


@query(
    "m4_hashed_bootstrap",
    sql(
        "SELECT arm, n, round(mean, 9) AS mean, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper FROM (SELECT arm, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper "
        f"FROM ({hashed_means_sql('scores', 'qid', 'score', 'arm')}) GROUP BY arm) JOIN (SELECT arm, count(*) AS n, avg(score) AS mean FROM scores GROUP BY arm) USING (arm)",
        "scores",
    ),
)
def m4_hashed(t: Tables):
    report = stats.hashed_bootstrap_ci(scored(t), "qid", "score", ["arm"])
    return report.select("arm", "n", rounded("mean"), rounded("ci_lower"), rounded("ci_upper"))


@query(
    "a15_resample_quantiles",
    sql(
        "SELECT round(quantile_cont(m, 0.05), 9) AS ci_lower, round(quantile_cont(m, 0.95), 9) AS ci_upper FROM ("
        + hashed_means_sql("(SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents)", "doc_id", "n_chars")
        + ")"
    ),
)
def a15(t: Tables):
    rows = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    means = stats.hashed_resample_means(rows, "doc_id", "n_chars")
    return stats.interval(means, (), 0.90).select(rounded("ci_lower"), rounded("ci_upper"))


DIFF = "(SELECT a.qid, b.score - a.score AS d FROM scores a JOIN scores b USING (qid) WHERE a.arm = 'r0' AND b.arm = 'r1')"


ALL_PAIRS = f"(SELECT 'all' AS pair, d FROM {DIFF})"


@query(
    "m5_paired_bootstrap",
    sql(f"SELECT n, {ENDS} FROM ({drawn_intervals_sql(ALL_PAIRS, 'd', 'pair')})", "scores"),
)
def m5(t: Tables):
    return with_ends(stats.paired_bootstrap(arm(t, "r0"), arm(t, "r1")))


@query(
    "m5_hashed_paired_bootstrap",
    sql(
        f"SELECT (SELECT count(*) FROM {DIFF}) AS n, round((SELECT avg(d) FROM {DIFF}), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS ci_lower, "
        f"round(quantile_cont(m, 0.975), 9) AS ci_upper FROM ({hashed_means_sql(DIFF, 'qid', 'd')})",
        "scores",
    ),
)
def m5_hashed(t: Tables):
    pairs = stats.paired(arm(t, "r0"), arm(t, "r1"))
    report = stats.hashed_bootstrap_ci(pairs, "qid", "difference")
    return report.select("n", rounded("mean"), rounded("ci_lower"), rounded("ci_upper"))


@query(
    "m6_detectable_effect",
    sql(
        f"SELECT CAST(ci AS DOUBLE) AS ci, round(CAST(z AS DOUBLE) * (SELECT stddev_samp(d) / sqrt(count(*)) FROM {DIFF}), 9) AS mde FROM (VALUES (0.9, 1.645), (0.95, 1.96), (0.99, 2.576)) v(ci, z)",
        "scores",
    ),
)
def m6(t: Tables):
    pairs = stats.paired(arm(t, "r0"), arm(t, "r1"))
    levels = [F.struct(F.lit(ci).alias("ci"), F.round(stats.detectable_effect("difference", ci), 9).alias("mde")) for ci in (0.90, 0.95, 0.99)]
    return pairs.agg(F.array(*levels).alias("all")).select(F.explode("all").alias("x")).select("x.ci", "x.mde")


@query("m11_comparison_report", sql(compare_sql(ARM.format("r0"), ARM.format("r1")), "scores"))
def m11(t: Tables):
    return compared(stats.compare(arm(t, "r0"), arm(t, "r1"), hashed=True, resamples=200))


@query(
    "m10_verdicts",
    sql(
        "SELECT x.source, count(*) AS n, quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS resolved FROM "
        "(SELECT * FROM (" + hashed_means_sql("(SELECT d.source, l.doc_id, CAST(l.quality - 0.5 AS DOUBLE) AS v FROM labels l JOIN documents d USING (doc_id))", "doc_id", "v", "source") + ")) x GROUP BY x.source"
    ),
)
def m10(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", "doc_id", (F.col("quality") - 0.5).alias("v"))
    means = stats.hashed_resample_means(rows, "doc_id", "v", ["source"])
    counted = means.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return stats.interval(means, ["source"]).join(counted, "source").select("source", "n", S.resolved("ci_lower", "ci_upper").alias("resolved"))


@query(
    "m13_attribution",
    sql(
        "SELECT n, baseline_mean AS own_mean, variant_mean AS ceiling_mean, delta_mean AS loss, delta_ci_lower AS loss_lower, delta_ci_upper AS loss_upper, "
        "rows_changed AS disagreement, mde, resolved FROM ("
        + compare_sql(ARM.format("r0"), ARM.format("r1"))
        + ")",
        "scores",
    ),
)
def m13(t: Tables):
    report = attribution.reader_loss(arm(t, "r0"), arm(t, "r1"), hashed=True, resamples=200)
    columns = ("own_mean", "ceiling_mean", "loss", "loss_lower", "loss_upper", "disagreement", "mde")
    return report.select("n", *[rounded(c) for c in columns], "resolved")


FAILURES = (
    "SELECT r.ok AS reader_correct, count(*) FILTER (c.score = 0) AS n_missing, count(*) FILTER (c.score = 1) AS n_found, "
    "round(CAST(100 AS DOUBLE) * count(*) FILTER (c.score = 0) / (SELECT count(*) FROM questions), 9) AS pct_missing, "
    "round(CAST(100 AS DOUBLE) * count(*) FILTER (c.score = 1) / (SELECT count(*) FROM questions), 9) AS pct_found FROM "
    "(SELECT l.qid, CAST(l.letters[1] = a.answer AS BIGINT) AS ok FROM letters l JOIN answers a USING (qid) WHERE l.arm = 'r0') r JOIN "
    f"(SELECT c.qid, {CONTEXT_HIT} AS score FROM contexts c JOIN wanted w ON w.qid = c.qid) c ON c.qid = r.qid GROUP BY r.ok"
)


@query("m14_failure_table", sql(FAILURES, "letters", "answers", "contexts", "wanted", "questions", extra=RETRIEVAL))
def m14(t: Tables):
    letters = readers.ranked_letters(t.logits(0)).join(t.answers, "qid")
    right = F.when(F.get("letters", F.lit(0)) == F.col("answer"), 1).otherwise(0).cast("long")
    reader = letters.select("qid", right.alias("reader_correct"))
    hits = support.context_hits(plan.attach_context(t.questions, t.index, t.chunks_of))
    found = hits.select("qid", F.col("score").cast("int").alias("gold_retrieved"))
    return attribution.failure_table(reader, found).select(
        "reader_correct", "n_missing", "n_found", rounded("pct_missing"), rounded("pct_found")
    )


@query(
    "m15_oracle_gap",
    sql(
        "SELECT count(*) AS n_rows, count(o.score) AS n_oracle, round(avg(o.score), 9) AS oracle_mean, round(avg(a.score), 9) AS actual_mean, "
        "round(avg(o.score) - avg(a.score) FILTER (o.score IS NOT NULL), 9) AS gap, round(avg(o.score) - avg(a.score), 9) AS gap_mixed FROM "
        "(SELECT * FROM scores WHERE arm = 'r0') a LEFT JOIN (SELECT s.* FROM scores s JOIN hit_ranks h ON h.qid = s.qid AND h.hit_rank > 0 WHERE s.arm = 'r1') o ON o.qid = a.qid",
        "scores",
        "hit_ranks",
        extra=RETRIEVAL,
    ),
)
def m15(t: Tables):
    ranks = support.retrieve_ranks(t.questions, t.index, t.chunks_of, 100).where("hit_rank > 0")
    oracle = arm(t, "r1").join(ranks.select("qid"), "qid", "left_semi")
    report = attribution.oracle_gap(arm(t, "r0"), oracle)
    return report.select("n_rows", "n_oracle", *[rounded(c) for c in ("oracle_mean", "actual_mean", "gap", "gap_mixed")])


@query("m16_other_map", sql("SELECT arm, qid, round(score, 9) AS score, true AS same FROM scores", "scores"))
def m16(t: Tables):
    rows = readers.ranked_letters(t.both_logits, ["arm", "qid"]).join(t.answers, "qid")
    other = F.round(S.precision_sum("answer", "letters"), 9)
    same = other == F.round(S.average_precision("answer", "letters"), 9)
    return rows.select("arm", "qid", other.alias("score"), same.alias("same"))


# --- readers and ensembles -----------------------------------------------------------------


@query("e1_score_options", sql("SELECT qid, option_no, CAST(length(prompt || ' ' || option) AS DOUBLE) AS logit FROM option_rows", "option_rows"))
def e1(t: Tables):
    pairs = t.option_rows.select("qid", whole("option_no"), *layout_pair(F.lit(""), "prompt", "option"))
    return readers.score_pairs(pairs, readers.length_scorer)


MEAN = "(SELECT qid, option_no, round(avg(logit), 12) AS logit FROM logits GROUP BY qid, option_no)"
Z = (
    "(SELECT arm, qid, option_no, (logit - avg(logit) OVER w) / CASE WHEN stddev_pop(logit) OVER w = 0 THEN 1 ELSE stddev_pop(logit) OVER w END AS z "
    "FROM logits WINDOW w AS (PARTITION BY arm, qid))"
)
WEIGHTS = [0.2, 0.35, 0.5]
MIXED = (
    f"(SELECT CAST(wt AS DOUBLE) AS weight, a.qid, a.option_no, round((CAST(1 AS DOUBLE) - wt) * a.z + CAST(wt AS DOUBLE) * b.z, 12) AS logit "
    f"FROM {Z} a JOIN {Z} b ON a.qid = b.qid AND a.option_no = b.option_no AND a.arm = 'r0' AND b.arm = 'r1', unnest([0.2, 0.35, 0.5]) v(wt))"
)
FUSED = "(SELECT qid, option_no, round(sum(CAST(1 AS DOUBLE) / (60 + r)), 12) AS logit FROM (SELECT *, row_number() OVER (PARTITION BY arm, qid ORDER BY logit DESC, option_no) AS r FROM logits) GROUP BY qid, option_no)"


def ap_sql(logits: str, groups: str = "qid") -> str:
    """``(groups, score)``: AP@3 of an option order."""
    return (
        f"SELECT {groups}, CASE WHEN list_position(letters[1:3], answer) > 0 THEN CAST(1 AS DOUBLE) / list_position(letters[1:3], answer) ELSE CAST(0 AS DOUBLE) END AS score "
        f"FROM (SELECT {groups}, list(chr(65 + CAST(option_no AS INTEGER)) ORDER BY logit DESC, option_no) AS letters FROM {logits} GROUP BY {groups}) JOIN answers USING (qid)"
    )


@query("e2_mean_logits", sql(f"SELECT qid, round(score, 9) AS score FROM ({ap_sql(MEAN)})", "logits", "answers"))
def e2(t: Tables):
    mean = readers.average_readers(t.both_logits).withColumn("logit", F.round("logit", 12))
    return readers.precision_rows(mean, t.answers).select("qid", rounded("score"))


@query("e3_normalized_weights", sql(f"SELECT weight, qid, round(score, 9) AS score FROM ({ap_sql(MIXED, 'weight, qid')})", "logits", "answers"))
def e3(t: Tables):
    mixed = readers.weighted_readers(t.both_logits, "r0", "r1", WEIGHTS)
    return readers.precision_rows(mixed, t.answers, 3, ["weight", "qid"]).select("weight", "qid", rounded("score"))


@query(
    "e3_normalized_epsilon",
    sql(
        "SELECT arm, qid, option_no, round((logit - avg(logit) OVER w) / (stddev_pop(logit) OVER w + CAST(1e-9 AS DOUBLE)), 6) AS logit FROM logits WINDOW w AS (PARTITION BY arm, qid)",
        "logits",
    ),
)
def e3_epsilon(t: Tables):
    return readers.normalized_logits(t.both_logits, 1e-9).select("arm", "qid", whole("option_no"), rounded("logit", 6))


@query("e4_reader_rank_fusion", sql(f"SELECT qid, option_no, round(logit, 9) AS fused FROM {FUSED}", "logits"))
def e4(t: Tables):
    return readers.fuse_readers(t.both_logits).select("qid", whole("option_no"), F.round("logit", 9).alias("fused"))


COMPLEMENT = (
    "SELECT count(*) AS n_rows, round(avg(CASE WHEN a.l <> b.l THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS disagreement, "
    "count(*) FILTER (a.l <> y.answer AND b.l = y.answer) AS n_rescued, count(*) FILTER (a.l = y.answer AND b.l <> y.answer) AS n_broken FROM "
    "(SELECT qid, letters[1] AS l FROM letters WHERE arm = 'r0') a JOIN (SELECT qid, letters[1] AS l FROM letters WHERE arm = 'r1') b USING (qid) JOIN answers y USING (qid)"
)


@query("e5_complementarity", sql(COMPLEMENT, "letters", "answers"))
def e5(t: Tables):
    report = readers.complementarity(t.both_logits, t.answers, "r0", "r1")
    return report.select("n_rows", rounded("disagreement"), "n_rescued", "n_broken")


@query("a10_rescue_counts", sql(f"SELECT n_rescued, n_broken, n_rescued - n_broken AS net FROM ({COMPLEMENT})", "letters", "answers"))
def a10(t: Tables):
    report = readers.complementarity(t.both_logits, t.answers, "r0", "r1")
    return report.select("n_rescued", "n_broken", (F.col("n_rescued") - F.col("n_broken")).alias("net"))


def ensemble_arms(t: Tables):
    """``(arm, qid, score)`` of reader r0, every weight and the rank fusion."""
    mixed = readers.weighted_readers(t.both_logits, "r0", "r1", WEIGHTS)
    weights = readers.precision_rows(mixed, t.answers, 3, ["weight", "qid"])
    named = weights.select(F.concat(F.lit("mix_"), F.col("weight").cast("string")).alias("arm"), "qid", "score")
    fused = readers.precision_rows(readers.fuse_readers(t.both_logits), t.answers).select(F.lit("rrf").alias("arm"), "qid", "score")
    return arm(t, "r0").unionByName(named).unionByName(fused)


ARMS = {
    "ens": (
        ["scores", "logits", "answers"],
        "SELECT 'r0' AS arm, 0 AS config_no, qid, score FROM scores WHERE arm = 'r0' UNION ALL "
        "SELECT 'mix_' || CAST(weight AS VARCHAR), CASE weight WHEN 0.2 THEN 1 WHEN 0.35 THEN 2 ELSE 3 END, qid, score FROM (" + ap_sql(MIXED, "weight, qid") + ") UNION ALL "
        "SELECT 'rrf', 4, qid, score FROM (" + ap_sql(FUSED) + ")",
    ),
    "deltas": (["ens"], "SELECT e.arm, e.qid, e.score - b.score AS d FROM ens e JOIN ens b ON b.qid = e.qid AND b.arm = 'r0' WHERE e.arm <> 'r0'"),
    "delta_cis": (
        ["deltas"],
        "SELECT arm, mean, ci_lower, ci_upper FROM (SELECT arm, avg(d) AS mean FROM deltas GROUP BY arm) JOIN "
        f"(SELECT arm, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper FROM ({hashed_means_sql('deltas', 'qid', 'd', 'arm')}) GROUP BY arm) USING (arm)",
    ),
}


@query(
    "e6_select_config",
    sql("SELECT arm AS config, round(m, 9) AS mean FROM (SELECT arm, config_no, avg(score) AS m FROM ens GROUP BY ALL) ORDER BY round(m, 12) DESC, config_no LIMIT 1", "ens", extra=ARMS),
)
def e6(t: Tables):
    order = ["r0", *[f"mix_{w}" for w in WEIGHTS], "rrf"]
    number = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("arm"))
    report = ensemble_arms(t).groupBy(F.col("arm").alias("config"), number.alias("config_no")).agg(F.avg("score").alias("mean"))
    return readers.select_config(report).select("config", rounded("mean"))


@query(
    "e7_ship_rule",
    sql(
        "SELECT arm, round(mean, 9) AS mean, round(ci_lower, 9) AS ci_lower FROM delta_cis WHERE mean > 0 AND ci_lower > 0 ORDER BY mean DESC, arm LIMIT 1",
        "delta_cis",
        extra=ARMS,
    ),
)
def e7(t: Tables):
    report = stats.compare_arms(ensemble_arms(t), "r0", hashed=True, resamples=200)
    return stats.ship(report).select("arm", rounded("mean"), rounded("ci_lower"))


@query(
    "e7_arm_table",
    sql(
        "SELECT arm, round(mean, 9) AS mean, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper, ci_lower > 0 OR ci_upper < 0 AS resolved FROM delta_cis",
        "delta_cis",
        extra=ARMS,
    ),
)
def e7_table(t: Tables):
    report = stats.compare_arms(ensemble_arms(t), "r0", hashed=True, resamples=200)
    return report.select("arm", rounded("mean"), rounded("ci_lower"), rounded("ci_upper"), "resolved")


LENGTHS = "(SELECT qid, option_no, CAST(length(option) AS DOUBLE) AS logit FROM option_rows)"


@query("e8_longest_option", sql(f"SELECT qid, round(score, 9) AS score FROM ({ap_sql(LENGTHS)})", "option_rows", "answers"))
def e8(t: Tables):
    return readers.precision_rows(readers.length_logits(t.questions), t.answers).select("qid", rounded("score"))


@query(
    "e10_sample_drift",
    sql(
        "SELECT arm, count(*) FILTER (p < 20) AS n_sampled, count(*) AS n_rows, round(avg(score) FILTER (p < 20), 9) AS mean_sampled, round(avg(score) FILTER (p >= 20), 9) AS mean_rest, "
        "round(avg(score), 9) AS mean_all FROM (SELECT s.*, q.p FROM scores s JOIN (SELECT qid, row_number() OVER (ORDER BY md5('0|' || qid), qid) - 1 AS p FROM questions) q USING (qid)) GROUP BY arm",
        "scores",
        "questions",
    ),
)
def e10(t: Tables):
    flags = selection.mark_sample(t.questions.select("qid"), "qid", 20, 0)
    report = readers.drift(scored(t).join(flags, "qid"), "sampled", ["arm"])
    return report.select("arm", "n_sampled", "n_rows", rounded("mean_sampled"), rounded("mean_rest"), rounded("mean_all"))


@query(
    "w8_two_key_sort",
    sql("SELECT qid, rank, chunk_id, phrase_count FROM reranked", "reranked", extra=RETRIEVAL),
)
def w8(t: Tables):
    queries = support.question_queries(t.questions, pooled_query)
    pool = plan.retrieve(t.questions, t.index, t.chunks_of, 50)
    ranked = rerank.rerank_by_phrases(pool, queries, 50)
    return ranked.select("qid", whole("rank"), "chunk_id", whole("phrase_count"))


@query(
    "w9_sentence_order",
    sql("SELECT qid, md5(string_agg(s, ' ' ORDER BY hits DESC, i)) AS joined_md5 FROM (SELECT w.qid, o.option AS s, o.option_no AS i, CAST(" + hit_sql("o.option") + " AS INTEGER) AS hits FROM option_rows o JOIN wanted w ON w.qid = o.qid) GROUP BY qid", "option_rows", "wanted"),
)
def w9(t: Tables):
    from gleanspark.functions.questions import distinctive_keywords, position_of, support_hit

    wanted = distinctive_keywords(options_array(), position_of("answer"))
    rows = t.questions.select("qid", wanted.alias("wanted"), options_array().alias("options"))
    keyed = F.transform("options", lambda o, i: F.struct(F.when(support_hit(o, "wanted"), 0).otherwise(1).alias("by"), i.alias("i"), o.alias("o")))
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["o"]), " ")
    return rows.select("qid", F.md5(joined).alias("joined_md5"))


def distinct_words(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> ''))"


INFERENCE = {
    **RETRIEVAL,
    "fused_context": (
        ["fused", "questions"],
        "SELECT q.qid, coalesce(string_agg(f.text, ' ' ORDER BY f.rank), '') AS context FROM questions q LEFT JOIN fused f ON f.qid = q.qid AND f.rank <= 5 GROUP BY q.qid",
    ),
    "option_scores": (
        ["fused_context", "option_rows"],
        "SELECT qid, option_no, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(b), 1) AS logit FROM (SELECT o.qid, o.option_no, "
        f"{distinct_words("substr(c.context, 1, 1750) || ' #### ' || o.prompt")} AS a, {distinct_words('o.option')} AS b "
        "FROM option_rows o JOIN fused_context c USING (qid))",
    ),
}


@query(
    "inference_submission",
    sql(
        "SELECT qid AS id, array_to_string(list(chr(65 + CAST(option_no AS INTEGER)) ORDER BY logit DESC, option_no)[1:3], ' ') AS prediction FROM option_scores GROUP BY qid",
        "option_scores",
        extra=INFERENCE,
    ),
)
def inference_submission(t: Tables):
    """The whole chain: two indexes, fused contexts, reader scores, option order, checked and written submission."""
    legs = [(build_index(t.half(i)), t.half_of(i)) for i in (0, 1)]
    made = inference.infer(t.questions, legs).select(F.col("qid").alias("id"), "prediction")
    path = scratch_path(t.spark, "inference")
    W.write_submission(materialize(made, "predictions"), t.answers.select(F.col("qid").alias("id")), path)
    return R.read_csv(t.spark, path, made.schema)


SWEEP = {
    **RETRIEVAL,
    "sweep_logits": (
        ["contexts", "option_rows"],
        "SELECT chars, qid, option_no, CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(b), 1) AS logit FROM (SELECT CAST(s.chars AS BIGINT) AS chars, o.qid, o.option_no, "
        f"{distinct_words("substr(c.context, 1, s.chars) || ' #### ' || o.prompt")} AS a, {distinct_words('o.option')} AS b "
        "FROM option_rows o JOIN contexts c USING (qid), unnest([250, 1000, 1750, 4000]) s(chars) WHERE o.option IS NOT NULL)",
    ),
}
SWEEP["sweep_scores"] = (["sweep_logits", "answers"], f"SELECT chars, qid, score FROM ({ap_sql('sweep_logits', 'chars, qid')})")
SIZES = (1750, 250, 1000, 4000)


def swept(t: Tables):
    return inference.context_sweep(plan.attach_context(t.questions, t.index, t.chunks_of), SIZES)


@query("sweep_context_scores", sql("SELECT chars, qid, round(score, 9) AS score FROM sweep_scores", "sweep_scores", extra=SWEEP))
def sweep_scores(t: Tables):
    return swept(t).select("chars", "qid", rounded("score", 9))


AGAINST = "(SELECT chars, qid, score - base AS d FROM sweep_scores JOIN (SELECT qid, score AS base FROM sweep_scores WHERE chars = 1750) USING (qid) WHERE chars <> 1750)"


@query(
    "sweep_context_report",
    sql(
        f"SELECT chars, a.n, round(a.mean, 9) AS mean, round(a.ci_lower, 9) AS ci_lower, round(a.ci_upper, 9) AS ci_upper, round(b.mean, 9) AS delta, "
        "round(b.ci_lower, 9) AS delta_lower, round(b.ci_upper, 9) AS delta_upper, b.ci_lower > 0 OR b.ci_upper < 0 AS resolved "
        f"FROM ({drawn_intervals_sql('sweep_scores', 'score', 'chars')}) a LEFT JOIN ({drawn_intervals_sql(AGAINST, 'd', 'chars')}) b USING (chars)",
        "sweep_scores",
        extra=SWEEP,
    ),
)
def sweep_report(t: Tables):
    report = inference.sweep_report(swept(t), 1750)
    ends = ("mean", "ci_lower", "ci_upper", "delta", "delta_lower", "delta_upper")
    return report.select("chars", "n", *[rounded(c, 9) for c in ends], "resolved")


@query(
    "sweep_context_lengths",
    sql(
        "SELECT p AS prob, round(q, 6) AS quantile FROM (SELECT quantile_cont(CAST(length(context) AS DOUBLE), [0.5, 0.9]) AS qs FROM contexts), "
        "unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) WITH ORDINALITY u(p, i), unnest(qs) WITH ORDINALITY v(q, j) WHERE i = j",
        "contexts",
        extra=RETRIEVAL,
    ),
)
def sweep_lengths(t: Tables):
    found = inference.context_lengths(plan.attach_context(t.questions, t.index, t.chunks_of))
    return found.select(F.col("prob").cast("double").alias("prob"), rounded("quantile"))
