"""From questions to a submission: evidence of two indexes, a reader's scores, the best three options."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.questions import layout_inference
from gleanspark.operators import stats
from gleanspark.operators.bm25 import Bm25Index
from gleanspark.operators.ordering import exact_quantiles
from gleanspark.operators.readers import option_rows, overlap_scores, precision_rows, predictions, with_fallback
from gleanspark.operators.support import join_contexts
from gleanspark.plans.retrieval import TOP_K, dual_index_lists, fuse_indexes
from gleanspark.runtime import materialize

# Takes (key, option_no, first, second) and gives (key, option_no, logit).
PairScorer = Callable[[DataFrame, Sequence[str]], DataFrame]

# Characters of context that a sweep compares; the first is what the others are paired with.
CLIP_SIZES = (1750, 2750, 4000, 5500)


def infer(
    questions: DataFrame,
    legs: Sequence[tuple[Bm25Index, DataFrame]],
    scorer: PairScorer = overlap_scores,
    k: int = TOP_K,
    best: int = 3,
    key: str = "qid",
) -> DataFrame:
    """``(key, prediction)`` of every question; ``legs`` are the indexes with their chunks.

    Contexts are fused by rank over both indexes. A question that no reader
    scored gets the fallback. ``scorer`` may run a model: see ``score_pairs``.
    """
    fused = fuse_indexes(dual_index_lists(questions, legs, k, key), k, key=key)
    with_context = join_contexts(questions.drop("context"), fused, key)
    pairs = option_rows(with_context, (key, "prompt", "context")).where(F.col("option").isNotNull())
    pairs = pairs.select(key, "option_no", *layout_inference("context", "prompt", "option"))
    return with_fallback(questions, predictions(scorer(pairs, (key, "option_no")), best, (key,)), key)


def context_sweep(
    questions: DataFrame, sizes: Sequence[int] = CLIP_SIZES, scorer: PairScorer = overlap_scores, best: int = 3, key: str = "qid"
) -> DataFrame:
    """``(chars, key, score)``: AP@best of every question with its ``context`` clipped to each size.

    All sizes are one job: a row per question, option and size goes to the scorer. Options that are
    null are not scored, and a question without any has no row.
    """
    pairs = option_rows(questions, (key, "prompt", "context")).where(F.col("option").isNotNull())
    clipped = [
        F.struct(F.lit(n).cast("long").alias("chars"), *layout_inference("context", "prompt", "option", n)) for n in sizes
    ]
    pairs = pairs.select(key, "option_no", F.explode(F.array(*clipped)).alias("x"))
    pairs = pairs.select("x.chars", key, "option_no", "x.first", "x.second")
    return precision_rows(scorer(pairs, ("chars", key, "option_no")), questions, best, ["chars", key], key)


def sweep_report(scores: DataFrame, base: int = CLIP_SIZES[0], key: str = "qid", **options) -> DataFrame:
    """``(chars, n, mean, ci_lower, ci_upper, delta, delta_lower, delta_upper, resolved)``: every size by itself and paired
    with ``base``, whose own delta is null. ``scores`` as :func:`context_sweep` gives them."""
    arms = scores.select(F.col("chars").cast("string").alias("arm"), key, "score")
    arms = materialize(arms, "sweep-scores")
    alone = stats.bootstrap_ci(arms, "score", ["arm"], **options)
    paired = stats.compare_arms(arms, str(base), key, **options).select(
        "arm", F.col("mean").alias("delta"), F.col("ci_lower").alias("delta_lower"), F.col("ci_upper").alias("delta_upper"), "resolved"
    )
    columns = ("n", "mean", "ci_lower", "ci_upper", "delta", "delta_lower", "delta_upper", "resolved")
    return alone.join(paired, "arm", "left").select(F.col("arm").cast("long").alias("chars"), *columns)


def context_lengths(questions: DataFrame, probs: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """``(prob, quantile)`` of the contexts' lengths in characters: which clip sizes can make a difference."""
    # Quantiles read their input more than once, and a context may be a whole search.
    lengths = materialize(questions.select(F.length("context").alias("chars")), "context-lengths")
    return exact_quantiles(lengths, "chars", probs)
