"""Per-row score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.functions.text import _column


def average_precision(actual: Column | str, predicted: Column | str, k: int = 3) -> Column:
    """1/rank of the first right label within the top k, else 0."""
    at = F.array_position(F.slice(_column(predicted), 1, k), _column(actual))
    return F.when(at > 0, F.lit(1.0) / at).otherwise(F.lit(0.0))


def precision_sum(actual: Column | str, predicted: Column | str, k: int = 3) -> Column:
    """The other AP@k in use: precision at each hit, summed, so a repeated label scores again."""
    top = F.slice(_column(predicted), 1, k)
    hits = F.transform(top, lambda p: F.when(p == _column(actual), 1.0).otherwise(0.0))
    scored = F.transform(
        hits,
        lambda h, i: h
        * F.aggregate(F.slice(hits, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x)
        / (i + 1),
    )
    return F.aggregate(scored, F.lit(0.0), lambda a, x: a + x)


def recall_at(rank: Column | str, k: int) -> Column:
    rank = _column(rank)
    return F.when((rank > 0) & (rank <= k), 1.0).otherwise(0.0)


def reciprocal_rank(rank: Column | str) -> Column:
    rank = _column(rank)
    return F.when(rank > 0, F.lit(1.0) / rank).otherwise(0.0)


def ndcg_at(rank: Column | str, k: int = 10) -> Column:
    """nDCG with a single relevant item."""
    rank = _column(rank)
    return F.when((rank > 0) & (rank <= k), F.lit(1.0) / F.log2(rank + F.lit(1.0))).otherwise(0.0)


def random_baseline(options: int = 5, k: int = 3) -> Column:
    """Expected AP@k of a random order."""
    return F.lit(sum(1.0 / r for r in range(1, k + 1)) / options)


def resolved(lower: Column | str, upper: Column | str) -> Column:
    """True when the interval leaves out zero."""
    return (_column(lower) > 0) | (_column(upper) < 0)


def dot(left: Column | str, right: Column | str) -> Column:
    pairs = F.zip_with(
        _column(left), _column(right), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
