"""Exact joins used to build leak-free data sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanspark.operators.selection import keep_first, short_key
from gleanspark.runtime import broadcast_if_small, materialize
from gleanspark.schemas import QUESTION_KEY


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys],
    )


def without(rows: DataFrame, others: DataFrame, keys: Sequence[str] = QUESTION_KEY) -> DataFrame:
    """Rows whose keys do not occur in ``others``; null matches null.

    ``others`` is reduced to distinct keys first, long texts to digests, so that neither copies nor texts are shuffled.
    """
    short = lambda df, k: short_key(k) if df.schema[k].dataType == StringType() else F.col(k)
    right = others.select(*[short(others, k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    same = [short(rows, k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(broadcast_if_small(materialize(right, "keys-without")), reduce(lambda a, b: a & b, same), "left_anti")


def within(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys occur in ``others``; null matches null."""
    right = others.select(*keys).distinct()
    return rows.alias("l").join(right.alias("r"), _same("l", "r", keys), "left_semi")


def attach(
    rows: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Left join on every key, null matching null."""
    right = source.select(*keys, *columns)
    joined = rows.alias("l").join(right.alias("r"), _same("l", "r", keys), "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in rows.columns], *[F.col(f"r.{c}") for c in columns]
    )


def attach_first(
    rows: DataFrame, source: DataFrame, key: str, columns: Sequence[str], order: str
) -> DataFrame:
    """Left join to the first source row per key, so no row is multiplied."""
    wanted = within(source, rows, [key])
    return attach(rows, keep_first(wanted, [key], [order]), [key], columns)


def check_attached(joined: DataFrame, key: str, column: str) -> DataFrame:
    """One row: rows, rows with nothing attached, and surplus rows per key."""
    per_key = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("missing")
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.sum("missing").alias("n_missing"),
        F.sum(F.col("n") - 1).alias("n_surplus"),
    )


def require_attached(joined: DataFrame, key: str, column: str) -> DataFrame:
    """The same rows, or an error when a row is missing or matched twice."""
    found = check_attached(joined, key, column).first()
    if found["n_missing"] or found["n_surplus"]:
        raise ValueError(
            f"{found['n_missing']} rows without {column}, {found['n_surplus']} surplus rows"
        )
    return joined


def mark_overlap(rows: DataFrame, others: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Flag the rows whose keys occur in ``others``; never multiplies rows."""
    right = others.select(*keys).distinct().withColumn("__hit", F.lit(True))
    joined = rows.alias("l").join(right.alias("r"), _same("l", "r", keys), "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in rows.columns],
        F.coalesce(F.col("r.__hit"), F.lit(False)).alias(out),
    )


def changed_rows(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """One row: how many keys have another value in ``column`` on the two sides."""
    both = left.select(key, F.col(column).alias("a")).join(
        right.select(key, F.col(column).alias("b")), key
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"),
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows either side has that the other lacks, copies counted."""
    columns = left.columns
    counted = (
        left.select(*columns, F.lit(1).alias("__n"))
        .unionByName(right.select(*columns, F.lit(-1).alias("__n")))
        .groupBy(*columns)
        .agg(F.sum("__n").alias("__n"))
    )
    return counted.agg(
        F.coalesce(F.sum(F.greatest("__n", F.lit(0))), F.lit(0)).alias("n_only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("__n"), F.lit(0))), F.lit(0)).alias("n_only_right"),
    )
