"""Run logs: append-only rows, harvested summaries, predictions against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.schemas import EXPERIMENT_LOG, LOG_FIELDS, OUTCOME_LOG
from gleanspark.sources.readers import read_csv

# How summaries spell a mean with its interval.
INTERVAL_PATTERN = r"^([\d.]+)\s*\[([\d.]+),([\d.]+)\]"


def log_rows(rows: DataFrame) -> DataFrame:
    """The fixed log columns as text; what is not given is '', and the date is today's."""
    unknown = set(rows.columns) - set(LOG_FIELDS)
    if unknown:
        raise ValueError(f"unknown log fields {sorted(unknown)}")
    given = set(rows.columns)

    def field(name: str) -> Column:
        default = F.date_format(F.current_date(), "yyyy-MM-dd") if name == "date" else F.lit("")
        return F.coalesce(F.col(name).cast("string"), default) if name in given else default

    return rows.select(*[field(c).alias(c) for c in LOG_FIELDS])


def append_log(rows: DataFrame, path: str) -> None:
    log_rows(rows).write.mode("append").csv(path, header=True, quote='"', escape='"', emptyValue="")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, EXPERIMENT_LOG).fillna("")


def summary_fields(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep…, field, content)`` from 'field: content' lines; only the first colon splits."""
    parts = F.split(value, ":", 2)
    return lines.where(F.contains(F.col(value), F.lit(":"))).select(
        *keep, F.trim(parts[0]).alias("field"), F.trim(parts[1]).alias("content")
    )


def parse_interval(fields: DataFrame, column: str = "content") -> DataFrame:
    """Add mean, ci_lower and ci_upper where the text reads 'm [lo,hi]'; null elsewhere."""
    def part(i: int):
        found = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), INTERVAL_PATTERN, i)
        return F.when(found != "", found.try_cast("double"))

    return fields.withColumns({"mean": part(1), "ci_lower": part(2), "ci_upper": part(3)})


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return parse_interval(summary_fields(lines, "value", ("file",)))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, OUTCOME_LOG)


def calibration(outcomes: DataFrame) -> DataFrame:
    """Outcome log with the predicted number, and how far the outcome fell from it."""
    number = F.regexp_extract("predicted", r"(\d+\.\d+)", 1).try_cast("double")
    return outcomes.withColumn("predicted_value", number).withColumns(
        {
            "public_miss": F.col("public") - F.col("predicted_value"),
            "private_miss": F.col("private") - F.col("predicted_value"),
        }
    )
