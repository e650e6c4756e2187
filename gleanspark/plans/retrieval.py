"""Retrieval jobs: contexts, fusion of lists and indexes, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.questions import option_query, pooled_query
from gleanspark.operators import stats
from gleanspark.operators.bm25 import Bm25Index, search
from gleanspark.operators.dense import nearest, nearest_within
from gleanspark.operators.fusion import RRF_K, fuse_ranks, fuse_scores, share_from_list, tagged_union
from gleanspark.operators.readers import option_rows
from gleanspark.operators.rerank import rerank_by_phrases
from gleanspark.operators.support import (
    Chunks,
    context_hits,
    first_hit_ranks,
    join_contexts,
    question_queries,
    with_texts,
)
from gleanspark.runtime import materialize

TOP_K = 5
RERANK_POOL = 50


def retrieve(
    questions: DataFrame, index: Bm25Index, chunks: Chunks, k: int = TOP_K, rerank: bool = False, key: str = "qid"
) -> DataFrame:
    """``(key, rank, chunk_id, score, text)``, reranked by phrases on demand."""
    queries = question_queries(questions, pooled_query, key)
    pool_k = max(RERANK_POOL, k) if rerank else k
    pool = with_texts(search(index, queries, pool_k, [key]), chunks, questions.count() * pool_k)
    if not rerank:
        return pool
    return rerank_by_phrases(pool, queries, k, key)


def attach_context(
    questions: DataFrame, index: Bm25Index, chunks: Chunks, k: int = TOP_K, rerank: bool = False, key: str = "qid"
) -> DataFrame:
    """Questions with the top-k texts as ``context``; a context they had is replaced."""
    return join_contexts(questions.drop("context"), retrieve(questions, index, chunks, k, rerank, key), key)


def search_per_option(
    questions: DataFrame, index: Bm25Index, per_query: int = 20, top: int = TOP_K, k: int = RRF_K, key: str = "qid"
) -> DataFrame:
    """One query per option, fused per question: ``(key, rank, chunk_id, fused)``."""
    rows = option_rows(questions, (key, "prompt")).withColumn(
        "query", option_query("prompt", F.coalesce("option", F.lit("")))
    )
    ranked = search(index, rows, per_query, [key, "option_no"])
    return fuse_ranks(ranked.withColumnRenamed("option_no", "list_no"), [key], "chunk_id", k, top)


def dual_index_lists(
    questions: DataFrame, legs: Sequence[tuple[Bm25Index, Chunks]], k: int = TOP_K, key: str = "qid"
) -> DataFrame:
    """The top-k texts of each index, as numbered lists. Written once, since several arms read them."""
    lists = tagged_union([retrieve(questions, index, chunks, k, False, key) for index, chunks in legs])
    return materialize(lists, "lists")


def fuse_indexes(lists: DataFrame, top: int = TOP_K, k: int = RRF_K, key: str = "qid") -> DataFrame:
    """Rank fusion on the text itself: two indexes share no ids."""
    return fuse_ranks(lists, [key], "text", k, top)


def pool_indexes(lists: DataFrame, top: int = TOP_K, key: str = "qid") -> DataFrame:
    return fuse_scores(lists, [key], top)


def new_share(lists: DataFrame, top: int = TOP_K, key: str = "qid", new_list: int = 1) -> DataFrame:
    """One row: mean share of the fused and of the pooled top places held by one list."""
    fused = share_from_list(fuse_indexes(lists, top, key=key), lists, [key], "text", new_list, top)
    pooled = pool_indexes(lists, top, key).groupBy(key).agg(
        (F.count_if(F.col("list_no") == new_list) / top).alias("pool_share")
    )
    return fused.join(pooled, key).agg(
        F.avg("share").alias("fused_share"), F.avg("pool_share").alias("pooled_share")
    )


def dual_index_arms(
    questions: DataFrame, lists: DataFrame, top: int = TOP_K, key: str = "qid"
) -> DataFrame:
    """``(arm, key, score)``: context hits of each list alone, pooled, and fused."""
    arms = {
        "a": lists.where(F.col("list_no") == 0),
        "b": lists.where(F.col("list_no") == 1),
        "pool": pool_indexes(lists, top, key),
        "rrf": fuse_indexes(lists, top, key=key),
    }
    scored = [
        context_hits(join_contexts(questions, ranked.select(key, "rank", "text"), key), "context", key).select(
            F.lit(name).alias("arm"), key, "score"
        )
        for name, ranked in arms.items()
    ]
    whole = scored[0]
    for part in scored[1:]:
        whole = whole.unionByName(part)
    return whole


def recall_scores(
    questions: DataFrame, ranked_texts: DataFrame, arm: str, k: int = TOP_K, key: str = "qid"
) -> DataFrame:
    """``(arm, key, score)``: was there a supporting chunk in the top k?"""
    ranks = first_hit_ranks(questions, ranked_texts, key)
    hit = F.when((F.col("hit_rank") > 0) & (F.col("hit_rank") <= k), 1.0).otherwise(0.0)
    return ranks.select(F.lit(arm).alias("arm"), key, hit.alias("score"))


def compare_recall(
    questions: DataFrame, baseline: DataFrame, variant: DataFrame, k: int = TOP_K, key: str = "qid", **options
) -> DataFrame:
    """Paired recall@k of two ranked lists over the same questions."""
    a = recall_scores(questions, baseline, "baseline", k, key)
    b = recall_scores(questions, variant, "variant", k, key)
    return stats.compare(a, b, key, "score", **options)


def index_sizes(indexes: Mapping[str, Bm25Index]) -> DataFrame:
    """``(arm, n_chunks)`` of named indexes, from what they have counted; the chunks are not cut again."""
    sizes = [index.totals.select(F.lit(arm).alias("arm"), "n_chunks") for arm, index in indexes.items()]
    whole = sizes[0]
    for part in sizes[1:]:
        whole = whole.unionByName(part)
    return whole


def coverage_growth(
    scores: DataFrame, sizes: DataFrame, key: str = "qid", **options
) -> DataFrame:
    """Smallest against largest index: growth of the corpus and paired change of the score.

    ``scores(arm, key, score)``, ``sizes(arm, n_chunks)``.
    """
    ends = sizes.agg(
        F.min_by("arm", F.struct("n_chunks", "arm")).alias("small"),
        F.max_by("arm", F.struct("n_chunks", "arm")).alias("big"),
        (F.max("n_chunks") / F.min("n_chunks")).alias("growth"),
    ).first()
    if ends["small"] == ends["big"]:
        raise ValueError("need two scored indexes")
    small = scores.where(F.col("arm") == ends["small"])
    big = scores.where(F.col("arm") == ends["big"])
    return stats.compare(small, big, key, "score", **options).withColumns(
        {"baseline": F.lit(ends["small"]), "variant": F.lit(ends["big"]), "growth": F.lit(ends["growth"])}
    )


def two_stage_dense(
    prompts: DataFrame,
    articles: DataFrame,
    sentences: DataFrame,
    questions: DataFrame,
    n_articles: int = 5,
    n_sentences: int = 20,
    key: str = "qid",
    document_key: str = "document_id",
    item_key: str = "sentence_id",
) -> DataFrame:
    """Articles nearest to the prompt, then within them the sentences nearest to the whole question.
    Gives ``(key, rank, item_key, score)``.

    ``prompts`` and ``questions`` hold ``(key, embedding)``; ``articles``
    ``(document_key, embedding)``; ``sentences`` both keys and ``embedding``.
    """
    found = nearest(prompts, articles, n_articles, key, document_key)
    return nearest_within(questions, found, sentences, n_sentences, key, document_key, item_key)
