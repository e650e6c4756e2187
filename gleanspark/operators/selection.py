"""Top-k, keep-first, seeded sampling and splits.

None of these sends a whole group to one task: Spark's window group limit (or an
explicit salted round for large k) trims each group on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.operators.ordering import running_total
from gleanspark.runtime import broadcast_if_small, materialize

# Spark trims groups before the shuffle for limits up to this (its default threshold).
GROUP_LIMIT = 1_000
SALTS = 64
# Rows of a prefix that one task merges; more are cut by ranges.
ONE_TASK = 100_000


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group in the given total order, ranked from 1."""
    if k > GROUP_LIMIT:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)))
        part = Window.partitionBy(*group, "__salt").orderBy(*order)
        df = (
            salted.withColumn("__r", F.row_number().over(part))
            .where(F.col("__r") <= k)
            .drop("__r", "__salt")
        )
    within = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the earliest in the given order; nulls count as equal."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return top_k(df, keys, order, 1, "__first").drop("__first")


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Every row with its place in its group, from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order, for any n.

    Up to ``ONE_TASK`` rows are merged by one task, as Spark does it. More are
    dealt into ranges of the order, written in order with their number in the range, and ranges are
    counted: a row's place is the number of rows in the ranges before plus its own, so no task has more than its range.
    """
    if n <= ONE_TASK:
        return df.orderBy(*order).limit(n)
    names = df.columns
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism * 4, *order).sortWithinPartitions(*order)
    # The id has the partition in its upper bits and counts the partition's rows below.
    ranged = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))  # a row per range
    placed = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.where(F.col("__start") + at < n).select(*names)


def longest(df: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """The n rows with the longest text."""
    return first_rows(df, [F.length(text).desc(), F.col(key)], n)


def draw_key(key: Column | str, seed: int) -> Column:
    """A seeded order that depends on the row's key alone."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("\u0000"))))


def short_key(key: Column | str) -> Column:
    """A string key itself, or for a long one its digest, one byte longer than any short key; null for null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.octet_length(key) <= 64, key).otherwise(F.concat(F.lit("#"), F.sha2(key.cast("binary"), 256)))


def _number(digest: Column) -> Column:
    """The first 52 bits of a hex digest as a number, in the same order as the digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def draw_position(df: DataFrame, key: str, seed: int, out: str = "draw") -> DataFrame:
    """0-based position of every row in the seeded order, for any number of rows."""
    digest = draw_key(key, seed)
    return running_total(
        df.withColumn("__d", digest).withColumn("__n", _number(digest)), "__n", None, out, ["__d", key]
    ).drop("__d", "__n")


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run and at every size.

    Keys are drawn, with as many places as they have rows; a null key is a key
    like any other. The one key that straddles the end gives its rows in order
    of a hash of all their columns. Rows stay where they are: only keys are
    ordered, and joined back.
    """
    names = df.columns
    keys = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__c"))
    digest = draw_key("__key", seed)
    placed = running_total(
        keys.withColumn("__d", digest).withColumn("__n", _number(digest)), "__n", F.col("__c"), "__at", ["__d", "__key"]
    )
    chosen = placed.where(F.col("__at") < n).select("__key", "__c", F.least("__c", n - F.col("__at")).alias("__take"))
    rows = df.join(broadcast_if_small(chosen), F.col(key).eqNullSafe(F.col("__key")))
    whole = rows.where("__take = __c").select(*names)
    part = rows.where("__take < __c").withColumn("__n", F.xxhash64(*names).cast("double"))
    part = running_total(part, "__n", None, "__at").where("__at < __take").select(*names)
    return whole.unionByName(part)


def sample_first(df: DataFrame, key: str, order: str, n: int, seed: int = 42) -> DataFrame:
    """``sample_exact`` of ``keep_first``: of the first rows of the string key's values, ``n`` drawn by the value.

    Digests are drawn; rows stay where they are, and only those of values drawn are compared by ``order``.
    """
    values = df.select(short_key(key).alias("__key"), draw_key(key, seed).alias("__d")).distinct()
    values = materialize(values.withColumn("__n", _number(F.col("__d"))), "values")
    placed = running_total(values, "__n", None, "__at", ["__d", "__key"]).where(F.col("__at") < n).select("__key")
    chosen = broadcast_if_small(materialize(placed, "values-drawn"))
    rows = df.join(chosen, short_key(key).eqNullSafe(F.col("__key")), "left_semi")
    return keep_first(rows, [key], [order])


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    return top_k(df, [group], [draw_key(key, seed), F.col(key)], n, "__r").drop("__r")


def sample_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Each row kept with the given probability, decided by its key, in one pass."""
    return df.where(_number(draw_key(key, seed)) < share * float(16**13))


def split_by_draw(df: DataFrame, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """Disjoint named parts cut from one seeded order, in the order given. ``key`` must be unique and not null.

    Only keys are ordered; the rows are joined with their places.
    """
    placed = draw_position(df.select(key), key, seed)
    label, start = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        here = (F.col("draw") >= start) & (F.col("draw") < start + size)
        label, start = F.when(here, name).otherwise(label), start + size
    drawn = placed.where(F.col("draw") < start).withColumn("part", label)
    return df.join(broadcast_if_small(drawn), key)


def mark_sample(df: DataFrame, key: str, n: int, seed: int = 42, out: str = "sampled") -> DataFrame:
    """Flag the rows a seeded sample of size ``n`` would hold."""
    return draw_position(df, key, seed).withColumn(out, F.col("draw") < n).drop("draw")
