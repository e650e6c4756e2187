"""Sinks. Counts come from the write itself, not from a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleanspark.functions.questions import LETTERS
from gleanspark.schemas import CHUNKS
from gleanspark.sources.readers import encode_options


def write_chunk_shards(chunks: DataFrame, path: str, shard_rows: int = 200_000) -> int:
    """Parquet shards of at most ``shard_rows`` rows; returns the number of chunks."""
    seen = Observation()
    typed = chunks.select(*[F.col(f.name).cast(f.dataType) for f in CHUNKS.fields])
    (
        typed.observe(seen, F.count(F.lit(1)).alias("n"))
        .write.option("maxRecordsPerFile", shard_rows)
        .mode("errorifexists")
        .parquet(path)
    )
    return int(seen.get["n"])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(report: DataFrame, path: str) -> None:
    report.write.json(path)


def write_t3(rows: DataFrame, path: str) -> None:
    """Out-of-distribution questions with their options as JSON text."""
    encode_options(rows).write.parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Add the scores of one or more arms to the store; reading one arm reads only its folder."""
    scores.write.mode("append").partitionBy("arm").parquet(path)


def write_articles_by_letter(articles: DataFrame, path: str) -> None:
    """Articles in one partition per first letter of the title.

    A letter with very many articles is written by several tasks.
    """
    first = F.lower(F.substring("title", 1, 1))
    letter = F.when(first.rlike("^[a-z]$"), first).otherwise("other")
    lettered = articles.withColumn("letter", letter)
    spread = F.pmod(F.xxhash64("title"), F.lit(16))
    lettered.repartition("letter", spread).write.partitionBy("letter").parquet(path)


def submission_problems(submission: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """One row of counts that have to be zero before a submission may be written."""
    tokens = F.split("prediction", " ")
    per = submission.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.size(tokens) < 1) | (F.size(tokens) > 3)).alias("length"),
        F.count_if(F.exists(tokens, lambda t: ~t.isin(list(LETTERS)))).alias("letters"),
        F.count_if(F.size(F.array_distinct(tokens)) < F.size(tokens)).alias("repeats"),
    )
    both = expected.select(key).distinct().withColumn("want", F.lit(1)).join(per, key, "full")
    return both.agg(
        F.count_if(F.col("n").isNull() | F.col("want").isNull() | (F.col("n") > 1)).alias("bad_ids"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bad_length"),
        F.coalesce(F.sum("letters"), F.lit(0)).alias("bad_letters"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("bad_repeats"),
    )


def write_submission(submission: DataFrame, expected: DataFrame, path: str, key: str = "id") -> None:
    found = {k: v for k, v in submission_problems(submission, expected, key).first().asDict().items() if v}
    if found:
        raise ValueError(f"submission rejected: {found}")
    write_csv(submission.select(key, "prediction"), path)
