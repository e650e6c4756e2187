"""Judge retrieval without labelled passages: does the evidence hold the answer's own words?"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.questions import (
    distinctive_keywords,
    options_array,
    pooled_query,
    position_of,
    support_hit,
)
from gleanspark.functions.scores import ndcg_at, recall_at, reciprocal_rank
from gleanspark.functions.text import words
from gleanspark.operators import stats
from gleanspark.operators.bm25 import Bm25Index, search
from gleanspark.runtime import BROADCAST_ROWS, materialize

KS = (1, 5, 10, 20, 50, 100)
QueryBuilder = Callable[[Column, Column], Column]
Chunks = DataFrame | Callable[[DataFrame], DataFrame]


def question_keywords(questions: DataFrame, key: str = "qid") -> DataFrame:
    """``(key, wanted)``: the keywords of the right option that no other option has."""
    wanted = distinctive_keywords(options_array(), position_of("answer"))
    return questions.select(key, wanted.alias("wanted"))


def question_queries(
    questions: DataFrame, query: QueryBuilder = pooled_query, key: str = "qid"
) -> DataFrame:
    return questions.select(key, query(F.col("prompt"), options_array()).alias("query"))


def with_texts(ranked: DataFrame, chunks: Chunks, at_most: int | None = None) -> DataFrame:
    """Look chunk texts up by id.

    ``chunks`` is a table, or a function that gives at least the chunks of a table of ids: texts that are cut on
    the way are then cut for the ranked rows only, which are written once, since they are read twice.
    ``at_most`` is a known bound on the ranked rows, such as queries times k.
    Where it is small the texts stay in place and are not shuffled.
    """
    if callable(chunks):
        ranked = materialize(ranked, "ranked")
        chunks = chunks(ranked.select("chunk_id"))
    if at_most is not None and at_most <= BROADCAST_ROWS:
        ranked = F.broadcast(ranked)
    return chunks.select("chunk_id", "text").join(ranked, "chunk_id")


def first_hit_ranks(
    questions: DataFrame, ranked_texts: DataFrame, key: str = "qid"
) -> DataFrame:
    """``(key, hit_rank)``: rank of the first supporting chunk, 0 where none supports."""
    wanted = question_keywords(questions, key)
    hits = ranked_texts.join(wanted, key).where(support_hit("text", "wanted"))
    first = hits.groupBy(key).agg(F.min("rank").alias("__rank"))
    return questions.select(key).join(first, key, "left").select(
        key, F.coalesce("__rank", F.lit(0)).cast("long").alias("hit_rank")
    )


def retrieve_ranks(
    questions: DataFrame,
    index: Bm25Index,
    chunks: Chunks,
    max_k: int,
    query: QueryBuilder = pooled_query,
    key: str = "qid",
) -> DataFrame:
    ranked = search(index, question_queries(questions, query, key), max_k, [key])
    return first_hit_ranks(questions, with_texts(ranked, chunks, questions.count() * max_k), key)


def metric_rows(ranks: DataFrame, ks: Sequence[int] = KS, key: str = "qid") -> DataFrame:
    """``(key, metric, score)``: recall at each k, MRR and nDCG@10 of every question."""
    values = [F.struct(F.lit(f"recall@{k}").alias("metric"), recall_at("hit_rank", k).alias("score")) for k in ks]
    values.append(F.struct(F.lit("MRR").alias("metric"), reciprocal_rank("hit_rank").alias("score")))
    values.append(F.struct(F.lit("nDCG@10").alias("metric"), ndcg_at("hit_rank", 10).alias("score")))
    exploded = ranks.select(key, F.explode(F.array(*values)).alias("m"))
    return exploded.select(key, "m.metric", "m.score")


def evaluate_ranks(
    ranks: DataFrame,
    ks: Sequence[int] = KS,
    resamples: int = 10_000,
    seed: int = 0,
    key: str = "qid",
) -> DataFrame:
    """``(metric, n, mean, ci_lower, ci_upper)``."""
    return stats.bootstrap_ci(metric_rows(ranks, ks, key), "score", ["metric"], resamples, 0.95, seed)


def evaluate_retrieval(
    questions: DataFrame,
    index: Bm25Index,
    chunks: Chunks,
    ks: Sequence[int] = KS,
    resamples: int = 10_000,
    seed: int = 0,
    query: QueryBuilder = pooled_query,
    key: str = "qid",
) -> DataFrame:
    ranks = retrieve_ranks(questions, index, chunks, max(ks), query, key)
    return evaluate_ranks(ranks, ks, resamples, seed, key)


def join_contexts(
    questions: DataFrame, ranked_texts: DataFrame, key: str = "qid", out: str = "context"
) -> DataFrame:
    """Questions with their retrieved texts joined in rank order; '' where nothing was found.

    A question has at most k texts, so collecting them per question is bounded.
    """
    joined = ranked_texts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("__all")
    )
    texts = joined.select(
        key, F.array_join(F.transform("__all", lambda s: s["text"]), " ").alias("__context")
    )
    return (
        questions.join(texts, key, "left")
        .withColumn(out, F.coalesce("__context", F.lit("")))
        .drop("__context")
    )


def context_hits(rows: DataFrame, context: str = "context", key: str = "qid") -> DataFrame:
    """``(key, score)``: 1.0 where the whole context supports the answer."""
    wanted = distinctive_keywords(options_array(), position_of("answer"))
    hit = F.when(support_hit(context, wanted), 1.0).otherwise(0.0)
    return rows.select(key, hit.alias("score"))


def oracle_contexts(
    questions: DataFrame, ranked_texts: DataFrame, key: str = "qid"
) -> DataFrame:
    """The text of the first supporting chunk, or '' and ``oracle_available = false``."""
    wanted = question_keywords(questions, key)
    hits = ranked_texts.join(wanted, key).where(support_hit("text", "wanted"))
    first = hits.groupBy(key).agg(F.min_by("text", "rank").alias("__text"))
    return (
        questions.join(first, key, "left")
        .withColumn("oracle_context", F.coalesce("__text", F.lit("")))
        .withColumn("oracle_available", F.col("__text").isNotNull())
        .drop("__text")
    )


def alignment(stored: DataFrame, rebuilt: DataFrame, key: str = "qid", bound: float = 0.95) -> DataFrame:
    """One row: how many stored contexts equal the rebuilt ones, blanks at the ends aside."""
    both = stored.select(key, F.trim("context").alias("a")).join(
        rebuilt.select(key, F.trim("context").alias("b")), key
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("n_same"),
    ).withColumn("aligned", F.col("n_same") >= bound * F.col("n_rows"))


def kept_context(context: str, second: Column, budget: int) -> Column:
    """The leading words of the context left when both segments share a word budget."""
    room = F.greatest(F.lit(budget) - F.size(words(second)), F.lit(0))
    return F.array_join(F.slice(words(context), F.lit(1), room), " ")


def truncation(rows: DataFrame, context: str, second: Column, budget: int) -> DataFrame:
    """One row: words of context kept and given, and their share."""
    counted = rows.select(
        F.size(words(kept_context(context, second, budget))).cast("long").alias("kept"),
        F.size(words(context)).cast("long").alias("given"),
    )
    return counted.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("kept").alias("words_kept"),
        F.sum("given").alias("words_given"),
    ).withColumn("share", F.col("words_kept") / F.greatest("words_given", F.lit(1)))
