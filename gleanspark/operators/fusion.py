"""Rank fusion of retrieval lists and of readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.operators.selection import top_k

RRF_K = 60
FUSED_DIGITS = 12


def fuse_ranks(
    ranked: DataFrame,
    group: Sequence[str],
    item: str | Sequence[str],
    k: int = RRF_K,
    top: int | None = None,
) -> DataFrame:
    """Reciprocal rank fusion of ``ranked(group…, list_no, rank, item…)``.

    Every appearance adds ``1 / (k + rank)``; scores of the lists do not count.
    Ties go to the item met first: lower list, then lower rank.
    """
    items = [item] if isinstance(item, str) else list(item)
    fused = ranked.groupBy(*group, *items).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"),
        F.min(F.struct("list_no", "rank")).alias("met"),
    )
    order = [F.round("fused", FUSED_DIGITS).desc(), F.col("met")]
    if top is None:
        within = Window.partitionBy(*group).orderBy(*order)
        placed = fused.withColumn("rank", F.row_number().over(within))
    else:
        placed = top_k(fused, group, order, top)
    return placed.select(*group, "rank", *items, "fused")


def fuse_scores(
    ranked: DataFrame, group: Sequence[str], top: int, score: str = "score"
) -> DataFrame:
    """Pool several lists and keep the best raw scores; ties go to the lower list, then rank."""
    order: list[Column] = [F.round(score, 9).desc(), F.col("list_no"), F.col("list_rank")]
    pooled = ranked.withColumnRenamed("rank", "list_rank")
    return top_k(pooled, group, order, top)


def share_from_list(
    selected: DataFrame, ranked: DataFrame, group: Sequence[str], item: str, list_no: int, top: int
) -> DataFrame:
    """Per group: the share of the ``top`` places whose item the given list holds."""
    held = (
        ranked.where(F.col("list_no") == list_no)
        .select(*group, item)
        .distinct()
        .withColumn("held", F.lit(1))
    )
    return (
        selected.join(held, [*group, item], "left")
        .groupBy(*group)
        .agg((F.coalesce(F.sum("held"), F.lit(0)) / top).alias("share"))
    )


def tagged_union(legs: Sequence[DataFrame]) -> DataFrame:
    """Stack ranked lists, numbering them in the order given."""
    tagged = [leg.withColumn("list_no", F.lit(i)) for i, leg in enumerate(legs)]
    whole = tagged[0]
    for leg in tagged[1:]:
        whole = whole.unionByName(leg)
    return whole
