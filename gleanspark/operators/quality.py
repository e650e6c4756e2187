"""Audits of question sets. Each gives a small table of counts or shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.questions import options_array, position_of
from gleanspark.operators.joins import mark_overlap
from gleanspark.schemas import OPTION_COLUMNS, QUESTION_KEY


def null_options(rows: DataFrame, columns: Sequence[str] = OPTION_COLUMNS) -> DataFrame:
    """One row: rows, rows with a null option, share."""
    bad = F.exists(F.array(*[F.col(c) for c in columns]), lambda o: o.isNull())
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("n_null"),
        F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("null_rate"),
    )


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


def mix(rows: DataFrame, split: str, value: str) -> DataFrame:
    """Counts and shares of a value within each split."""
    counted = value_counts(rows, [split, value])
    totals = counted.groupBy(split).agg(F.sum("n_rows").alias("n_split"))
    return counted.join(totals, split).select(
        split, value, "n_rows", (F.col("n_rows") / F.col("n_split")).alias("share")
    )


def repeated_values(rows: DataFrame, column: str) -> DataFrame:
    """One row: rows, distinct values and the surplus. Counts copies before counting values."""
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        (F.sum("n") - F.count(F.lit(1))).alias("n_repeated"),
    )


def repeated_options(rows: DataFrame) -> DataFrame:
    """One row: rows in which two options have the same text."""
    options = F.filter(options_array(), lambda o: o.isNotNull())
    bad = F.size(F.array_distinct(options)) < F.size(options)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("n_repeated"),
        F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("share"),
    )


def overlap(rows: DataFrame, others: DataFrame, keys: Sequence[str] = ("prompt",)) -> DataFrame:
    """One row: rows, and distinct keys, that also occur in ``others``."""
    marked = mark_overlap(rows, others, keys, "hit").where("hit")
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
    )


def shared_rows(left: DataFrame, right: DataFrame, keys: Sequence[str] = QUESTION_KEY) -> DataFrame:
    """One row: distinct whole rows both sides hold; zero when nothing leaked."""
    both = left.select(*keys).intersect(right.select(*keys))
    return both.agg(F.count(F.lit(1)).alias("n_shared"))


def subset_check(rows: DataFrame, others: DataFrame, keys: Sequence[str] = ("prompt",)) -> DataFrame:
    """One row: distinct keys missing from ``others`` and whether there are none."""
    marked = mark_overlap(rows.select(*keys).distinct(), others, keys, "hit")
    return marked.agg(F.count_if(~F.col("hit")).alias("n_missing")).withColumn(
        "is_subset", F.col("n_missing") == 0
    )


def longest_is_answer(rows: DataFrame) -> DataFrame:
    """One row: how often the first longest option is the right one."""
    lengths = F.transform(options_array(), lambda o: F.length(F.coalesce(o, F.lit(""))))
    first_longest = F.array_position(lengths, F.array_max(lengths)) - 1
    same = first_longest == position_of("answer")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(same).alias("n_longest"),
        F.avg(F.when(same, 1.0).otherwise(0.0)).alias("rate"),
    )


def answer_profile(rows: DataFrame) -> DataFrame:
    """Per answer letter: rows, mean length of the right option and of the others."""
    options = options_array()
    lengths = F.transform(options, lambda o: F.length(F.coalesce(o, F.lit(""))).cast("double"))
    right = F.get(lengths, position_of("answer"))
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("answer").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(right).alias("right_length"),
        F.avg((total - right) / (F.size(lengths) - 1)).alias("wrong_length"),
    )


def ambiguous_prompts(rows: DataFrame) -> DataFrame:
    """Prompts that come with different options or answers.

    Whole rows are made distinct first, so a heavily copied row counts once.
    """
    distinct = rows.select(*QUESTION_KEY).distinct()
    return (
        distinct.groupBy("prompt")
        .agg(F.count(F.lit(1)).alias("n_versions"))
        .where(F.col("n_versions") > 1)
    )


def contamination(dev: DataFrame, training: DataFrame, group: str = "source") -> DataFrame:
    """Per training source: how many distinct dev prompts it holds, and their share."""
    prompts = dev.select("prompt").distinct()
    total = prompts.count()
    held = training.select(group, "prompt").distinct()
    marked = mark_overlap(held, prompts, ["prompt"], "hit")
    return marked.groupBy(group).agg(F.count_if(F.col("hit")).alias("n_shared")).withColumn(
        "share", F.col("n_shared") / F.lit(float(max(total, 1)))
    )
