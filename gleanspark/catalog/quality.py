"""Audits of question sets."""

from pyspark.sql import functions as F

from gleanspark.catalog.fixtures import Tables, sql
from gleanspark.catalog.registry import query
from gleanspark.operators import quality
from gleanspark.operators.joins import mark_overlap


def rounded(name: str, digits: int = 9):
    return F.round(name, digits).alias(name)


OPTIONS = "[A, B, C, D, E]"
FILLED = "[coalesce(A, ''), coalesce(B, ''), coalesce(C, ''), coalesce(D, ''), coalesce(E, '')]"
LENGTHS = f"list_transform({FILLED}, lambda o: CAST(length(o) AS DOUBLE))"


@query(
    "q1_null_option_rate",
    sql(
        "SELECT count(*) AS n_rows, count(*) FILTER (bad) AS n_null, round(avg(CASE WHEN bad THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS null_rate FROM "
        "(SELECT A IS NULL OR B IS NULL OR C IS NULL OR D IS NULL OR E IS NULL AS bad FROM pool_all)",
        "pool_all",
    ),
)
def q1(t: Tables):
    return quality.null_options(t.pool_all).select("n_rows", "n_null", rounded("null_rate"))


@query("q2_repeated_prompts", sql("SELECT count(*) AS n_rows, count(DISTINCT prompt) AS n_distinct, count(*) - count(DISTINCT prompt) AS n_repeated FROM pool", "pool"))
def q2(t: Tables):
    return quality.repeated_values(t.pool, "prompt")


@query(
    "q3_repeated_options",
    sql(
        "SELECT count(*) AS n_rows, count(*) FILTER (bad) AS n_repeated, round(avg(CASE WHEN bad THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS share FROM "
        f"(SELECT len(list_distinct({OPTIONS})) < len(list_filter({OPTIONS}, lambda o: o IS NOT NULL)) AS bad FROM pool_all)",
        "pool_all",
    ),
)
def q3(t: Tables):
    return quality.repeated_options(t.pool_all).select("n_rows", "n_repeated", rounded("share"))


@query(
    "q4_source_mix",
    sql(
        "SELECT split, source, count(*) AS n_rows, round(CAST(count(*) AS DOUBLE) / any_value(n), 9) AS share FROM (SELECT *, count(*) OVER (PARTITION BY split) AS n FROM "
        "(SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'gold' ELSE 'pool' END AS split FROM pool_all)) GROUP BY split, source",
        "pool_all",
    ),
)
def q4(t: Tables):
    marked = mark_overlap(t.pool_all, t.labels, ["doc_id"], "labelled")
    split = F.when(F.col("labelled"), "gold").otherwise("pool")
    return quality.mix(marked.withColumn("split", split), "split", "source").select("split", "source", "n_rows", rounded("share"))


@query(
    "q5_leak_counts",
    sql("SELECT count(*) AS n_rows, count(DISTINCT prompt) AS n_distinct FROM pool WHERE prompt IN (SELECT prompt FROM gold)", "pool", "gold"),
)
def q5(t: Tables):
    return quality.overlap(t.pool, t.gold)


@query(
    "q6_longest_is_answer",
    sql(
        "SELECT count(*) AS n_rows, count(*) FILTER (hit) AS n_longest, round(avg(CASE WHEN hit THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS rate FROM "
        f"(SELECT list_position(l, list_max(l)) - 1 = ascii(answer) - 65 AS hit FROM (SELECT answer, {LENGTHS} AS l FROM pool_all))",
        "pool_all",
    ),
)
def q6(t: Tables):
    return quality.longest_is_answer(t.pool_all).select("n_rows", "n_longest", rounded("rate"))


@query(
    "q7_answer_profile",
    sql(
        "SELECT answer, count(*) AS n_rows, round(avg(l[ascii(answer) - 64]), 9) AS right_length, round(avg((list_sum(l) - l[ascii(answer) - 64]) / 4), 9) AS wrong_length FROM "
        f"(SELECT answer, {LENGTHS} AS l FROM pool_all) GROUP BY answer",
        "pool_all",
    ),
)
def q7(t: Tables):
    return quality.answer_profile(t.pool_all).select("answer", "n_rows", rounded("right_length"), rounded("wrong_length"))


@query(
    "q8_ambiguous_prompts",
    sql(
        "SELECT md5(prompt) AS prompt_md5, count(*) AS n_versions FROM (SELECT DISTINCT prompt, A, B, C, D, E, answer FROM pool_all) GROUP BY prompt HAVING count(*) > 1",
        "pool_all",
    ),
)
def q8(t: Tables):
    return quality.ambiguous_prompts(t.pool_all).select(F.md5("prompt").alias("prompt_md5"), "n_versions")


@query(
    "q9_contamination",
    sql(
        "SELECT source, count(DISTINCT CASE WHEN prompt IN (SELECT prompt FROM gold) THEN prompt END) AS n_shared, "
        "round(CAST(count(DISTINCT CASE WHEN prompt IN (SELECT prompt FROM gold) THEN prompt END) AS DOUBLE) / (SELECT count(DISTINCT prompt) FROM gold), 9) AS share FROM pool GROUP BY source",
        "pool",
        "gold",
    ),
)
def q9(t: Tables):
    return quality.contamination(t.gold, t.pool).select("source", "n_shared", rounded("share"))


@query("q10_dev_has_no_repeats", sql("SELECT count(*) AS n_rows, count(DISTINCT prompt) AS n_distinct, count(*) - count(DISTINCT prompt) AS n_repeated FROM (SELECT prompt FROM dev UNION ALL SELECT prompt FROM pool)", "dev", "pool"))
def q10(t: Tables):
    """The audit on rows that do repeat: the dev rows beside the pool they were drawn from."""
    return quality.repeated_values(t.dev.select("prompt").unionByName(t.pool.select("prompt")), "prompt")
