"""Score options, rank them, combine readers and pick between configurations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions.questions import letter_of, options_array, position_of, prediction_text
from gleanspark.functions.scores import average_precision

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def option_rows(questions: DataFrame, keep: Sequence[str] = ("qid",)) -> DataFrame:
    """One row per option: ``(keep…, option_no, option)``, option_no from 0."""
    return questions.select(*keep, F.posexplode(options_array()).alias("option_no", "option"))


def score_pairs(pairs: DataFrame, scorer: Scorer, keys: Sequence[str] = ("qid", "option_no")) -> DataFrame:
    """Run a model over ``(keys…, first, second)`` in Arrow batches: ``(keys…, logit)``.

    Rows carry their keys, so order and batch limits do not matter.
    """
    keys = list(keys)
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "logit double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = scorer(batch["first"], batch["second"])
            yield batch[keys].assign(logit=scored.astype("float64").to_numpy())

    return pairs.select(*keys, "first", "second").mapInPandas(run, schema)


def length_scorer(first: pd.Series, second: pd.Series) -> pd.Series:
    """Longer second segments score higher."""
    return second.str.len()


def overlap_scores(pairs: DataFrame, keys: Sequence[str] = ("qid", "option_no")) -> DataFrame:
    """``(keys…, logit)``: share of the second segment's distinct words that the first one has."""
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(c), r"\s+")), "")
    shared = F.size(F.array_intersect(words("first"), words("second")))
    share = shared / F.greatest(F.size(words("second")), F.lit(1))
    return pairs.select(*keys, F.coalesce(share, F.lit(0.0)).alias("logit"))


def _sortable(logit: Column) -> Column:
    """NaN ranks last, not first."""
    return F.when(F.isnan(logit), F.lit(float("-inf"))).otherwise(logit)


def option_ranks(logits: DataFrame, groups: Sequence[str] = ("qid",), first: int = 1) -> DataFrame:
    """Rank of every option within its question, best first; ties keep option order."""
    within = Window.partitionBy(*groups).orderBy(_sortable(F.col("logit")).desc(), "option_no")
    return logits.withColumn("rank", F.row_number().over(within) + (first - 1))


def ranked_letters(logits: DataFrame, groups: Sequence[str] = ("qid",)) -> DataFrame:
    """``(groups…, letters)``: all option letters, best first. Five options per group."""
    best = F.array_sort(
        F.collect_list(F.struct((-_sortable(F.col("logit"))).alias("by"), F.col("option_no")))
    )
    return logits.groupBy(*groups).agg(best.alias("__o")).select(
        *groups, F.transform("__o", lambda o: letter_of(o["option_no"])).alias("letters")
    )


def predictions(logits: DataFrame, k: int = 3, groups: Sequence[str] = ("qid",)) -> DataFrame:
    return ranked_letters(logits, groups).select(*groups, prediction_text("letters", k).alias("prediction"))


def with_fallback(questions: DataFrame, predicted: DataFrame, key: str = "qid", fallback: str = "A B C") -> DataFrame:
    """Every question gets a prediction; unscored ones the fallback."""
    return questions.select(key).join(predicted, key, "left").select(
        key, F.coalesce("prediction", F.lit(fallback)).alias("prediction")
    )


def precision_rows(
    logits: DataFrame, answers: DataFrame, k: int = 3, groups: Sequence[str] = ("qid",), key: str = "qid"
) -> DataFrame:
    """``(groups…, score)``: AP@k of the option order against ``answers(key, answer)``."""
    return ranked_letters(logits, groups).join(answers.select(key, "answer"), key).select(
        *groups, average_precision("answer", "letters", k).alias("score")
    )


def average_readers(logits: DataFrame) -> DataFrame:
    """Plain mean over the arms of ``logits(arm, qid, option_no, logit)``."""
    return logits.groupBy("qid", "option_no").agg(F.avg("logit").alias("logit"))


def normalized_logits(logits: DataFrame, epsilon: float | None = None) -> DataFrame:
    """z-scores within each question and arm, population deviation.

    A deviation of zero counts as one; with ``epsilon`` it is added instead.
    """
    within = Window.partitionBy("arm", "qid")
    sd = F.stddev_pop("logit").over(within)
    scale = F.when(sd == 0, 1.0).otherwise(sd) if epsilon is None else sd + epsilon
    return logits.withColumn("logit", (F.col("logit") - F.avg("logit").over(within)) / scale)


def weighted_readers(
    logits: DataFrame, first: str, second: str, weights: Sequence[float], digits: int = 12
) -> DataFrame:
    """``(weight, qid, option_no, logit)``: (1−w)·z(first) + w·z(second) for every weight."""
    z = normalized_logits(logits)
    both = z.groupBy("qid", "option_no").agg(
        F.max(F.when(F.col("arm") == first, F.col("logit"))).alias("a"),
        F.max(F.when(F.col("arm") == second, F.col("logit"))).alias("b"),
    )
    grid = both.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    mixed = (1 - F.col("weight")) * F.col("a") + F.col("weight") * F.col("b")
    return grid.select("weight", "qid", "option_no", F.round(mixed, digits).alias("logit"))


def fuse_readers(logits: DataFrame, k: int = 60) -> DataFrame:
    """Rank fusion over arms: sum of 1/(k + rank), rank from 1."""
    ranked = option_ranks(logits, ("arm", "qid"))
    fused = F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 12)
    return ranked.groupBy("qid", "option_no").agg(fused.alias("logit"))


def complementarity(logits: DataFrame, answers: DataFrame, first: str, second: str) -> DataFrame:
    """One row: how often two readers' top options differ, and who is right when they do."""
    top = option_ranks(logits, ("arm", "qid")).where(F.col("rank") == 1)
    sides = top.groupBy("qid").agg(
        F.max(F.when(F.col("arm") == first, F.col("option_no"))).alias("a"),
        F.max(F.when(F.col("arm") == second, F.col("option_no"))).alias("b"),
    )
    judged = sides.join(answers.select("qid", position_of("answer").alias("y")), "qid")
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    return judged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.when(a != b, 1.0).otherwise(0.0)).alias("disagreement"),
        F.count_if((a != y) & (b == y)).alias("n_rescued"),
        F.count_if((a == y) & (b != y)).alias("n_broken"),
    )


def logit_spread(logits: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean over questions of the best minus the worst logit."""
    per = logits.groupBy(*groups, "qid").agg((F.max("logit") - F.min("logit")).alias("s"))
    return per.groupBy(*groups).agg(F.avg("s").alias("spread"))


def select_config(report: DataFrame, name: str = "config", mean: str = "mean", order: str = "config_no") -> DataFrame:
    """The configuration with the best mean; the earlier one wins a tie."""
    return report.orderBy(F.round(mean, 12).desc(), order).limit(1).select(name, mean)


def length_logits(questions: DataFrame) -> DataFrame:
    """The options-only reader: longer options first."""
    return option_rows(questions).select(
        "qid", "option_no", F.length(F.coalesce("option", F.lit(""))).cast("double").alias("logit")
    )


def drift(scores: DataFrame, flag: str = "sampled", groups: Sequence[str] = ()) -> DataFrame:
    """One row: the mean on a sample, on the other rows and on all of them."""
    inside = F.avg(F.when(F.col(flag), F.col("score")))
    outside = F.avg(F.when(~F.col(flag), F.col("score")))
    return scores.groupBy(*groups).agg(
        F.count_if(F.col(flag)).alias("n_sampled"),
        F.count(F.lit(1)).alias("n_rows"),
        inside.alias("mean_sampled"),
        outside.alias("mean_rest"),
        F.avg("score").alias("mean_all"),
    )
