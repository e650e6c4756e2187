"""Sources and sinks: write to the shared scratch folder, read back, compare."""

from pyspark.sql import functions as F

from gleanspark.catalog.fixtures import Tables, sql
from gleanspark.catalog.registry import query
from gleanspark.functions.questions import prediction_text
from gleanspark.operators import readers, tiers
from gleanspark.runtime import scratch_path
from gleanspark.schemas import CHUNKS, OPTION_COLUMNS, QUESTION_KEY
from gleanspark.sources import logs
from gleanspark.sources import readers as R
from gleanspark.sources import writers as W


def count(name: str = "n_rows"):
    return F.count(F.lit(1)).alias(name)


def profile(rows):
    """Enough of every row to notice any change."""
    options = F.concat_ws("|", *OPTION_COLUMNS)
    return rows.select(F.md5("prompt").alias("prompt_md5"), options.alias("options"), "answer")


PROFILE = "md5(prompt) AS prompt_md5, concat_ws('|', A, B, C, D, E) AS options, answer"


@query("s1_csv_scan", sql(f"SELECT {PROFILE} FROM gold", "gold"))
def s1(t: Tables):
    path = scratch_path(t.spark, "gold")
    W.write_csv(t.gold.select(*QUESTION_KEY), path)
    return profile(R.read_gold(t.spark, path))


@query("s2_load_pool", sql(f"SELECT {PROFILE} FROM pool_all", "pool_all"))
def s2(t: Tables):
    paths = [scratch_path(t.spark, name) for name in ("pool", "gold")]
    W.write_csv(t.pool.select(*QUESTION_KEY), paths[0])
    W.write_csv(t.gold.select(*QUESTION_KEY), paths[1])
    return profile(R.read_pool(t.spark, paths))


@query("s3_column_projection", sql("SELECT chunk_id, title, md5(text) AS text_md5 FROM chunks", "chunks"))
def s3(t: Tables):
    path = scratch_path(t.spark, "chunks")
    W.write_chunk_shards(t.chunks, path, 500)
    return R.read_chunks(t.spark, path).select("chunk_id", "title", F.md5("text").alias("text_md5"))


@query("s4_scan_nonempty", "SELECT lang, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents WHERE length(text) > 0 GROUP BY lang")
def s4(t: Tables):
    filled = t.documents.where(F.length("text") > 0)
    return filled.groupBy("lang").agg(count(), F.sum(F.length("text")).alias("n_chars"))


@query("s5_load_paragraphs", sql("SELECT title, section, count(*) AS n_rows, min(para_no) AS first_row FROM paragraphs GROUP BY title, section", "paragraphs"))
def s5(t: Tables):
    return t.paragraphs.groupBy("title", "section").agg(count(), F.min("para_no").alias("first_row"))


@query(
    "s6_every_nth_shard",
    "SELECT CAST(o AS BIGINT) AS shard_offset, doc_id FROM documents, unnest(range(0, 3)) u(o) WHERE (doc_id // 10) % 3 = o",
)
def s6(t: Tables):
    rows = t.documents.select("doc_id", F.floor(F.col("doc_id") / 10).alias("shard"))
    parts = [R.every_nth_shard(rows, "shard", 3, o).select(F.lit(o).cast("long").alias("shard_offset"), "doc_id") for o in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s7_recursive_discovery", sql("SELECT article_id, count(*) AS n_chunks FROM chunks GROUP BY article_id", "chunks"))
def s7(t: Tables):
    root = scratch_path(t.spark, "tree")
    for parity in (0, 1):
        W.write_chunk_shards(t.half(parity), f"{root}/part/{parity}/shards")
    found = R.read_matching(t.spark, root, "*.parquet", CHUNKS)
    return found.groupBy("article_id").agg(count("n_chunks"))


@query("s8_fetch_by_id", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s8(t: Tables):
    path = scratch_path(t.spark, "by-source")
    t.documents.select("doc_id", "source", "n_chars").repartition("source", F.pmod("doc_id", F.lit(4))).write.partitionBy("source").parquet(path)
    toxic = t.labels.where("toxic = 1").select("doc_id")
    wanted = t.documents.select("doc_id", "source").join(toxic, "doc_id", "left_semi")
    stored = t.spark.read.schema("doc_id long, n_chars long, source string").parquet(path)
    return R.fetch_by_id(stored, wanted, "source", "doc_id").select("doc_id", "source", "n_chars")


@query(
    "s9_chunk_shards",
    sql("SELECT count(*) AS n_written, count(*) AS n_read, true AS within_limit FROM chunks", "chunks"),
)
def s9(t: Tables):
    path = scratch_path(t.spark, "shards")
    written = W.write_chunk_shards(t.chunks, path, 300)
    per_file = t.spark.read.schema(CHUNKS).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(count("n"))
    return per_file.agg(
        F.lit(written).cast("long").alias("n_written"),
        F.sum("n").alias("n_read"),
        (F.max("n") <= 300).alias("within_limit"),
    )


@query(
    "s9_articles_by_letter",
    "SELECT CASE WHEN regexp_matches(lower(substr(text, 1, 1)), '^[a-z]$') THEN lower(substr(text, 1, 1)) ELSE 'other' END AS letter, count(*) AS n_rows "
    "FROM documents GROUP BY 1",
)
def s9_letters(t: Tables):
    path = scratch_path(t.spark, "letters")
    W.write_articles_by_letter(t.documents.select("doc_id", F.col("text").alias("title")), path)
    stored = t.spark.read.schema("doc_id long, title string, letter string").parquet(path)
    return stored.groupBy("letter").agg(count())


@query("s10_csv_sink", sql(f"SELECT {PROFILE} FROM pool", "pool"))
def s10(t: Tables):
    path = scratch_path(t.spark, "pool-csv")
    W.write_csv(t.pool.select(*QUESTION_KEY), path)
    return profile(R.read_pool(t.spark, [path]))


@query(
    "s11_json_options",
    sql("SELECT 'mmlu_' || qid AS id, len(o) AS n_options, array_to_string(o, ' | ') AS options FROM "
        "(SELECT qid, CASE WHEN qid % 2 = 0 OR answer = 'E' THEN [A, B, C, D, E] ELSE [A, B, C, D] END AS o FROM questions)", "questions"),
)
def s11(t: Tables):
    path = scratch_path(t.spark, "t3")
    W.write_t3(tiers.normalize_mmlu(t.mmlu_raw).select("id", "options"), path)
    stored = R.decode_options(t.spark.read.schema("id string, options string").parquet(path))
    return stored.select("id", F.size("options").cast("long").alias("n_options"), F.array_join("options", " | ").alias("options"))


@query("s12_json_report", sql("SELECT source, count(*) AS n_rows, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY source"))
def s12(t: Tables):
    path = scratch_path(t.spark, "report")
    report = t.documents.groupBy("source").agg(count(), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    W.write_json(report, path)
    return t.spark.read.schema("source string, n_rows long, mean_chars double").json(path)


@query("s13_score_store", sql("SELECT arm, qid, score FROM scores WHERE arm = 'r1'", "scores"))
def s13(t: Tables):
    path = scratch_path(t.spark, "scores")
    for number in (0, 1):
        scores = readers.precision_rows(t.logits(number), t.answers)
        W.write_scores(scores.withColumn("arm", F.lit(f"r{number}")), path)
    stored = t.spark.read.schema("qid long, score double, arm string").parquet(path)
    return stored.where("arm = 'r1'").select("arm", "qid", "score")


@query(
    "s14_experiment_log",
    "SELECT 'mean length of ' || source AS config, CAST(count(*) AS VARCHAR) AS n, '' AS hypothesis, '' AS git_sha, true AS is_dated FROM documents GROUP BY source "
    "UNION ALL SELECT 'languages', CAST(count(DISTINCT lang) AS VARCHAR), 'four, with \"quotes\"', '', true FROM documents",
)
def s14(t: Tables):
    path = scratch_path(t.spark, "log")
    per_source = t.documents.groupBy("source").agg(count("n"))
    logs.append_log(per_source.select(F.concat(F.lit("mean length of "), "source").alias("config"), "n"), path)
    langs = t.documents.agg(F.count_distinct("lang").alias("n"))
    logs.append_log(langs.withColumns({"config": F.lit("languages"), "hypothesis": F.lit('four, with "quotes"')}), path)
    dated = F.col("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return logs.read_log(t.spark, path).select("config", "n", "hypothesis", "git_sha", dated.alias("is_dated"))


def shifted(name: str, digits: int):
    """A count over a power of ten as text, with all its digits."""
    n, power = F.col(name), 10**digits
    return F.concat(F.floor(n / power).cast("string"), F.lit("."), F.lpad((n % power).cast("string"), digits, "0"))


@query(
    "s15_harvest_summaries",
    "SELECT source, 'best_map3' AS field, CAST(count(*) AS DOUBLE) / 1000 AS mean, CAST(count(*) AS DOUBLE) / 10000 AS ci_lower, CAST(count(*) AS DOUBLE) / 100 AS ci_upper FROM documents GROUP BY source "
    "UNION ALL SELECT source, 'rows', NULL, NULL, NULL FROM documents GROUP BY source",
)
def s15(t: Tables):
    path = scratch_path(t.spark, "summaries")
    n = t.documents.groupBy("source").agg(count("n"))

    lines = n.select(
        "source",
        F.explode(
            F.array(
                F.concat(F.lit("best_map3: "), shifted("n", 3), F.lit(" ["), shifted("n", 4), F.lit(","), (F.col("n") / 100).cast("string"), F.lit("]")),
                F.concat(F.lit("rows: total: "), F.col("n").cast("string")),
                F.lit("no colon here"),
            )
        ).alias("value"),
    )
    lines.write.partitionBy("source").text(path)
    fields = logs.read_summaries(t.spark, path)
    source = F.regexp_extract("file", "source=([^/]+)/", 1).alias("source")
    return fields.select(source, "field", "mean", "ci_lower", "ci_upper")


BROKEN_SQL = (
    "SELECT count(*) FILTER (qid % 13 = 0) AS bad_ids, count(*) FILTER (qid % 13 <> 0 AND qid % 11 = 0) AS bad_length, "
    "count(*) FILTER (qid % 13 <> 0 AND qid % 11 <> 0 AND qid % 5 = 0) AS bad_letters, "
    "count(*) FILTER (qid % 13 <> 0 AND qid % 11 <> 0 AND qid % 5 <> 0 AND qid % 7 = 0) AS bad_repeats FROM answers"
)


@query("s16_submission_checks", sql(BROKEN_SQL, "answers"))
def s16_checks(t: Tables):
    good = readers.predictions(t.logits(0))
    q = F.col("qid")
    broken = (
        F.when(q % 11 == 0, "A B C D").when(q % 5 == 0, "A F").when(q % 7 == 0, "A A B").otherwise(F.col("prediction"))
    )
    given = good.where(q % 13 != 0).select(q.alias("id"), broken.alias("prediction"))
    return W.submission_problems(given, t.answers.select(q.alias("id")))


@query("s16_submission", sql("SELECT qid AS id, array_to_string(letters[1:3], ' ') AS prediction FROM letters WHERE arm = 'r1'", "letters"))
def s16(t: Tables):
    path = scratch_path(t.spark, "submission")
    letters = readers.ranked_letters(t.logits(1))
    made = letters.select(F.col("qid").alias("id"), prediction_text("letters").alias("prediction"))
    W.write_submission(made, t.answers.select(F.col("qid").alias("id")), path)
    return R.read_csv(t.spark, path, made.schema)


OUTCOMES = (
    "SELECT source, CAST(count(*) AS DOUBLE) / 10000 AS predicted_value, round(CAST(count(*) AS DOUBLE) / 100 - CAST(count(*) AS DOUBLE) / 10000, 9) AS public_miss, "
    "round(CAST(count(*) AS DOUBLE) / 200 - CAST(count(*) AS DOUBLE) / 10000, 9) AS private_miss FROM documents GROUP BY source"
)


def outcomes(t: Tables):
    path = scratch_path(t.spark, "outcomes")
    n = t.documents.groupBy("source").agg(count("n"))
    number = F.concat(F.lit("~"), shifted("n", 4), F.lit(" (range 0.1-0.9)"))
    rows = n.select(
        F.lit("2020-01-01").alias("date"),
        F.lit("sha").alias("git_sha"),
        F.col("source").alias("config"),
        number.alias("predicted"),
        (F.col("n") / 100).alias("public"),
        (F.col("n") / 200).alias("private"),
        F.lit('a "quoted", note').alias("notes"),
    )
    W.write_csv(rows, path)
    return logs.read_outcomes(t.spark, path)


@query("s17_outcome_log", "SELECT source AS config, CAST(count(*) AS DOUBLE) / 100 AS public, 'a \"quoted\", note' AS notes FROM documents GROUP BY source")
def s17(t: Tables):
    return outcomes(t).select("config", "public", "notes")


@query("e9_prediction_calibration", OUTCOMES)
def e9(t: Tables):
    report = logs.calibration(outcomes(t))
    return report.select(
        F.col("config").alias("source"),
        "predicted_value",
        F.round("public_miss", 9).alias("public_miss"),
        F.round("private_miss", 9).alias("private_miss"),
    )
