"""Reorder retrieved chunks by phrases, and the sentences of a context by pair score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.text import phrase_hits, phrases, sentences, tokens
from gleanspark.operators.selection import top_k

PairScorer = Callable[[Column, Column], Column]


def rerank_by_phrases(
    candidates: DataFrame, queries: DataFrame, k: int, key: str = "qid"
) -> DataFrame:
    """Candidates ``(key, rank, chunk_id, score, text)`` by phrase hits, then score, then rank.

    The phrases of a query are built once per query; candidates per query are few.
    """
    grams = queries.select(key, phrases("query").alias("grams"))
    counted = candidates.join(grams, key).withColumn("phrase_count", phrase_hits("grams", "text"))
    order = [F.col("phrase_count").desc(), F.round("score", 9).desc(), F.col("old_rank")]
    ranked = top_k(counted.withColumnRenamed("rank", "old_rank"), [key], order, k)
    return ranked.select(key, "rank", "chunk_id", "score", "phrase_count", "text")


def shared_tokens(query: Column, sentence: Column) -> Column:
    """A plain pair score: how many distinct query tokens the sentence has."""
    return F.size(F.array_intersect(tokens(query), tokens(sentence))).cast("double")


def rerank_sentences(
    rows: DataFrame,
    query: Column,
    scorer: PairScorer = shared_tokens,
    key: str = "qid",
    context: str = "context",
) -> DataFrame:
    """Rows with ``context_reranked``: the same sentences, best score first.

    ``scorer`` builds a Column from query and sentence; a pandas UDF around a
    model fits there and sees batches that mix rows. A context of at most one
    sentence is kept as it is. ``key`` must be unique.
    """
    split = rows.withColumn("__q", query).withColumn("__s", sentences(context))
    pairs = split.where(F.size("__s") > 1).select(key, "__q", F.posexplode("__s").alias("at", "sentence"))
    scored = pairs.select(key, "at", "sentence", scorer(F.col("__q"), F.col("sentence")).alias("pair"))
    # One context's sentences, put back in order inside their own row.
    ordered = scored.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.round("pair", 9)).alias("by"), "at", "sentence"))
        ).alias("all")
    )
    joined = ordered.select(
        key, F.array_join(F.transform("all", lambda s: s["sentence"]), " ").alias("__new")
    )
    return (
        split.join(joined, key, "left")
        .withColumn("n_sentences", F.size("__s").cast("long"))
        .withColumn("context_reranked", F.coalesce("__new", context))
        .drop("__q", "__s", "__new")
    )
