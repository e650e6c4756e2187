"""Evaluation tiers: dev (T1), gold (T2), out of distribution (T3), and the training pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.questions import LETTERS, letter_of, padded_option
from gleanspark.operators.joins import without
from gleanspark.operators.neardup import drop_near_duplicates
from gleanspark.operators.selection import keep_first, sample_first, sample_per_group, split_by_draw
from gleanspark.runtime import materialize
from gleanspark.schemas import OPTION_COLUMNS

# The STEM subjects of the MMLU grouping.
STEM_SUBJECTS = [
    "abstract_algebra",
    "anatomy",
    "astronomy",
    "college_biology",
    "college_chemistry",
    "college_computer_science",
    "college_mathematics",
    "college_physics",
    "computer_security",
    "conceptual_physics",
    "electrical_engineering",
    "elementary_mathematics",
    "high_school_biology",
    "high_school_chemistry",
    "high_school_computer_science",
    "high_school_mathematics",
    "high_school_physics",
    "high_school_statistics",
    "machine_learning",
]


def tag(rows: DataFrame, tier: str) -> DataFrame:
    return rows.withColumn("tier", F.lit(tier))


def drop_null_options(rows: DataFrame, columns: Sequence[str] = OPTION_COLUMNS) -> DataFrame:
    return rows.dropna(subset=list(columns))


def fill_options(rows: DataFrame, columns: Sequence[str] = OPTION_COLUMNS) -> DataFrame:
    return rows.fillna("", subset=list(columns))


def apply_null_policy(rows: DataFrame, policy: str, columns: Sequence[str] = OPTION_COLUMNS) -> DataFrame:
    """'drop' leaves rows with a null option out, 'empty' turns the null into ''."""
    if policy == "drop":
        return drop_null_options(rows, columns)
    if policy == "empty":
        return fill_options(rows, columns)
    raise ValueError(f"unknown null policy {policy!r}")


def only_subjects(rows: DataFrame, subjects: Sequence[str] = STEM_SUBJECTS) -> DataFrame:
    return rows.where(F.col("subject").isin(list(subjects)))


def normalize_arc(rows: DataFrame) -> DataFrame:
    """Answer letter by the position of the key among the row's own labels; unknown keys drop out."""
    at = F.array_position("choices.label", F.col("answerKey"))
    return rows.where(at > 0).select(
        F.col("id").cast("string").alias("id"),
        F.lit("arc_challenge").alias("source"),
        F.lit(None).cast("string").alias("subject"),
        "question",
        F.col("choices.text").alias("options"),
        letter_of(at - 1).alias("answer"),
    )


def normalize_mmlu(rows: DataFrame, subjects: Sequence[str] | None = None, row_no: str = "row_no") -> DataFrame:
    rows = rows if subjects is None else only_subjects(rows, subjects)
    return rows.select(
        F.concat(F.lit("mmlu_"), F.col(row_no).cast("string")).alias("id"),
        F.lit("mmlu").alias("source"),
        "subject",
        "question",
        F.col("choices").alias("options"),
        letter_of(F.col("answer")).alias("answer"),
    )


def widen_options(rows: DataFrame, options: str = "options") -> DataFrame:
    """A–E columns from an option array, '' where the array is shorter."""
    return rows.withColumns(
        {letter: padded_option(options, i) for i, letter in enumerate(OPTION_COLUMNS)}
    )


def build_t1(pool: DataFrame, gold: DataFrame, order: str, n: int = 1500, seed: int = 42) -> DataFrame:
    """Exactly n pool rows, no two with one prompt, none close to a gold prompt."""
    clean = drop_near_duplicates(pool, gold, "prompt")
    # Written, since its rows are counted.
    sampled = materialize(tag(sample_first(clean, "prompt", order, n, seed), "T1"), "tier")
    found = sampled.count()
    if found < n:
        raise ValueError(f"only {found} clean pool rows available, need {n}")
    return sampled


def build_t3(arc: DataFrame, mmlu: DataFrame, order: str = "id", n_each: int = 500, seed: int = 42) -> DataFrame:
    """Up to n_each distinct questions of each source."""
    both = arc.unionByName(mmlu)
    clean = keep_first(both, ["source", "question"], [order])
    return tag(sample_per_group(clean, "source", "question", n_each, seed), "T3")


def build_train_pool(pool: DataFrame, gold: DataFrame, dev: DataFrame) -> DataFrame:
    """Pool rows that are neither dev prompts nor close to gold."""
    return without(drop_near_duplicates(pool, gold, "prompt"), dev, ["prompt"])


def split_train_monitor(
    pool: DataFrame, dev: DataFrame, gold: DataFrame, order: str, n_monitor: int, n_train: int, seed: int = 42
) -> DataFrame:
    """Monitor and train rows of one seeded draw, free of dev and gold prompts and of repeats."""
    clean = without(without(pool, dev, ["prompt"]), gold, ["prompt"])
    unique = keep_first(clean, ["prompt"], [order])
    return split_by_draw(unique, "prompt", {"monitor": n_monitor, "train": n_train}, seed)


def split_violations(parts: DataFrame, dev: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of counts that all have to be zero."""
    seen = dev.select("prompt").distinct().withColumn("dev", F.lit(1)).join(
        gold.select("prompt").distinct().withColumn("gold", F.lit(1)), "prompt", "full"
    )
    per_prompt = parts.groupBy("prompt").agg(
        F.count_if(F.col("part") == "train").alias("train"),
        F.count_if(F.col("part") == "monitor").alias("monitor"),
        F.count_if(~F.col("answer").isin(list(LETTERS))).alias("bad"),
    )
    joined = per_prompt.join(seen, "prompt", "left")
    return joined.agg(
        F.count_if((F.col("train") > 0) & F.col("dev").isNotNull()).alias("train_in_dev"),
        F.count_if((F.col("monitor") > 0) & F.col("dev").isNotNull()).alias("monitor_in_dev"),
        F.count_if((F.col("train") > 0) & F.col("gold").isNotNull()).alias("train_in_gold"),
        F.count_if((F.col("train") > 0) & (F.col("monitor") > 0)).alias("train_in_monitor"),
        F.sum("bad").alias("bad_answers"),
    )


def require_clean(violations: DataFrame) -> None:
    """Raise when any count of a violation row is above zero."""
    found = {k: v for k, v in violations.first().asDict().items() if v}
    if found:
        raise ValueError(f"split is not clean: {found}")


def require_answers(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    bad = rows.where(~F.coalesce(F.col("answer").isin(list(letters)), F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rows with an answer outside {letters}")
    return rows
