"""Global order without a one-partition window: dense ids, running totals, exact quantiles.

Rows are cut into buckets of the order key. The boundaries are a few thousand
numbers read once, so each row's bucket is a fixed function of its key: a lost
task recomputes to the same answer. Totals per bucket give each bucket its
start, and only rows of one bucket are sorted together.

Boundaries are quantiles, so buckets hold about equally many rows however the
keys are spread; one key value that fills a bucket alone is ordered by ``ties``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 20_000
# Below this many distinct values the built-in exact percentile holds them all.
PERCENTILE_VALUES = 100_000


def _boundaries(df: DataFrame, key: str, rows_per_bucket: int) -> list[float]:
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Small inputs still give every core a bucket, as long as it is worth a task.
    buckets = min(MAX_BUCKETS, max(1, -(-rows // rows_per_bucket), min(cores, rows // 1_000)))
    if buckets == 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.stat.approxQuantile(key, probs, 1 / (4 * buckets))))


def running_total(
    df: DataFrame,
    key: str,
    weight: Column | None = None,
    out: str = "offset",
    ties: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows that come earlier.

    ``key`` is a numeric column; ``ties`` completes the order where keys repeat.
    With no weight this is the 0-based dense position.
    """
    weight = F.lit(1) if weight is None else weight
    weighed = df.withColumn("__w", weight.cast("long"))
    cuts = _boundaries(df.select(F.col(key).cast("double").alias("k")), "k", rows_per_bucket)
    if cuts:
        weighed = Bucketizer(
            splits=[float("-inf"), *cuts, float("inf")], inputCol="__k", outputCol="__b"
        ).transform(weighed.withColumn("__k", F.col(key).cast("double")))
    else:
        weighed = weighed.withColumn("__k", F.lit(0.0)).withColumn("__b", F.lit(0.0))
    totals = weighed.groupBy("__b").agg(F.sum("__w").alias("__t"))
    # At most MAX_BUCKETS rows, so one window over all of them is safe.
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    inside = (
        Window.partitionBy("__b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        weighed.join(F.broadcast(starts), "__b")
        .withColumn(out, F.col("__s") + F.coalesce(F.sum("__w").over(inside), F.lit(0)))
        .drop("__w", "__k", "__b", "__s")
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """``(prob, quantile)``: exact, linearly interpolated quantiles of one numeric column; null without a value.

    Equal values are counted first. A modest number of distinct values goes to
    the built-in ``percentile``; more are ranked by :func:`running_total`.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    asked = F.array(*[F.lit(float(p)) for p in probs])
    if counted.limit(PERCENTILE_VALUES + 1).count() <= PERCENTILE_VALUES:
        found = counted.agg(F.percentile("v", asked, F.col("c")).alias("q"))
    else:
        placed = running_total(counted, "v", F.col("c"), "at")
        total = counted.agg(F.sum("c").alias("total"))
        spots = placed.crossJoin(F.broadcast(total))  # one row
        exact = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]

        def at(spot: Column) -> Column:
            spot = F.least(spot, F.col("total") - 1)
            return F.max(F.when((F.col("at") <= spot) & (F.col("at") + F.col("c") > spot), F.col("v")))

        ends = [at(F.floor(e)).alias(f"lo{i}") for i, e in enumerate(exact)]
        ends += [at(F.floor(e) + 1).alias(f"hi{i}") for i, e in enumerate(exact)]
        row = spots.agg(F.max("total").alias("total"), *ends)
        values = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (e - F.floor(e)) for i, e in enumerate(exact)]
        found = row.select(F.array(*values).alias("q"))
    q = F.coalesce("q", F.array_repeat(F.lit(None).cast("double"), len(probs)))
    pairs = F.explode(F.arrays_zip(asked.alias("prob"), q.alias("quantile")))
    return found.select(pairs.alias("x")).select(F.col("x.prob").alias("prob"), F.col("x.quantile").alias("quantile"))
