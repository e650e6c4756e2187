"""Split hot join keys into several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 1_000_000
MAX_HOT_KEYS = 100_000


def spread_hot_keys(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    rows_per_split: int = ROWS_PER_SPLIT,
    salt: str = "salt",
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt`` to join on as well.

    A key with more than ``rows_per_split`` rows on a side is cut into as many
    pieces there as it needs, and each piece meets every piece of the other
    side: a grid, in which no cell has more than that many rows of either side.
    The list of such keys is at most ``2 * MAX_HOT_KEYS`` long by construction,
    so it is broadcast. Both sides are read twice: hand over written tables.
    """
    limit = max(rows_per_split, left.count() // MAX_HOT_KEYS, right.count() // MAX_HOT_KEYS)

    def crowded(side: DataFrame, name: str) -> DataFrame:
        sizes = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
        return sizes.select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias(name))

    hot = crowded(left, "__rows").join(crowded(right, "__columns"), list(keys), "full")
    hot = F.broadcast(
        hot.select(*keys, F.coalesce("__rows", F.lit(1)).alias("__rows"), F.coalesce("__columns", F.lit(1)).alias("__columns"))
    )

    def placed(side: DataFrame, own: str, other: str, cell) -> DataFrame:
        mine, theirs = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        piece = F.pmod(F.xxhash64(*[F.col(c) for c in side.columns]), mine).cast("int")
        rows = side.join(hot, list(keys), "left").withColumn("__piece", piece)
        rows = rows.withColumn("__each", F.explode(F.sequence(F.lit(0), theirs - 1)))
        return rows.withColumn(salt, cell()).drop("__rows", "__columns", "__piece", "__each")

    columns = F.coalesce("__columns", F.lit(1))
    return (
        placed(left, "__rows", "__columns", lambda: F.col("__piece") * columns + F.col("__each")),
        placed(right, "__columns", "__rows", lambda: F.col("__each") * columns + F.col("__piece")),
    )
