"""Where the points are lost: reader or retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.operators import stats


def failure_table(reader: DataFrame, retrieval: DataFrame, key: str = "qid") -> DataFrame:
    """Counts and percentages of reader right/wrong against evidence found/missing.

    ``reader(key, reader_correct)`` and ``retrieval(key, gold_retrieved)`` hold 0/1.
    """
    both = reader.join(retrieval, key)
    counted = both.groupBy("reader_correct").agg(
        F.count_if(F.col("gold_retrieved") == 0).alias("n_missing"),
        F.count_if(F.col("gold_retrieved") == 1).alias("n_found"),
        F.count(F.lit(1)).alias("__n"),
    )
    # A window over the counts, which are a row for each value of reader_correct.
    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    return counted.withColumns(
        {"pct_missing": 100.0 * F.col("n_missing") / total, "pct_found": 100.0 * F.col("n_found") / total}
    ).drop("__n")


def oracle_gap(actual: DataFrame, oracle: DataFrame, key: str = "qid") -> DataFrame:
    """One row: what the oracle's evidence adds.

    ``gap`` compares both arms on the rows the oracle has; ``gap_mixed`` takes
    the actual mean over all rows instead, which is not the same question.
    """
    both = actual.select(key, F.col("score").alias("a")).join(
        oracle.select(key, F.col("score").alias("o")), key, "left"
    )
    same = F.avg(F.when(F.col("o").isNotNull(), F.col("a")))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("o").alias("n_oracle"),
        F.avg("o").alias("oracle_mean"),
        F.avg("a").alias("actual_mean"),
        same.alias("actual_mean_same_rows"),
    ).withColumns(
        {
            "gap": F.col("oracle_mean") - F.col("actual_mean_same_rows"),
            "gap_mixed": F.col("oracle_mean") - F.col("actual_mean"),
        }
    )


def reader_loss(own: DataFrame, ceiling: DataFrame, key: str = "qid", **options) -> DataFrame:
    """Own reader against a known good one on the same rows."""
    report = stats.compare(own, ceiling, key, "score", **options)
    return report.select(
        "n",
        F.col("variant_mean").alias("ceiling_mean"),
        F.col("baseline_mean").alias("own_mean"),
        F.col("delta_mean").alias("loss"),
        F.col("delta_ci_lower").alias("loss_lower"),
        F.col("delta_ci_upper").alias("loss_upper"),
        F.col("rows_changed").alias("disagreement"),
        "mde",
        "resolved",
    )
