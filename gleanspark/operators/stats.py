"""Means with bootstrap intervals, paired comparisons and detectable effects.

A resample mean depends only on how often each score value occurs. So scores
are counted once in Spark and the resampling works on the counts, at a cost that
does not grow with the rows.

A resample is a multinomial draw over the counted values, split up one binomial
draw after another: of the rows that are left, how many fall on the next value, given its
share of what is left. Each draw is a quantile of the binomial distribution at a
number that md5 makes of seed, resample and place in the order of values, so a resample
is a function of these alone: the same on any partitioning, and in any engine
with md5 (``binomial_quantile``). Where a group has more than ``VALUE_BLOCKS`` values they are dealt
into as many blocks by a hash; rows are first drawn for the blocks and then, in a
task of each block, for its values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions.scores import resolved
from gleanspark.runtime import materialize

# Z for the tabulated confidence levels.
Z_BY_LEVEL = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}

# Values of a group that are drawn one by one; with more of them, blocks of values.
VALUE_BLOCKS = 256
# Resamples that one task draws at a time.
CHUNK = 1_000
# Up to this mean the binomial quantile is summed up, beyond it the normal one with a term for skewness is taken.
EXACT_MEAN, EXACT_STEPS = 30, 100
# Coefficients of a rational approximation to the normal quantile (relative error under 1.2e-9).
NORMAL_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
NORMAL_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
NORMAL_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
NORMAL_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
NORMAL_TAIL = 0.02425


def _horner(coefficients: Sequence[float], x: np.ndarray) -> np.ndarray:
    total = np.zeros_like(x)
    for c in coefficients:
        total = total * x + c
    return total


def normal_quantile(u: np.ndarray) -> np.ndarray:
    tail = np.minimum(u, 1 - u) < NORMAL_TAIL
    t = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    outer = _horner(NORMAL_C, t) / _horner((*NORMAL_D, 1.0), t)
    q = u - 0.5
    inner = q * _horner(NORMAL_A, q * q) / _horner((*NORMAL_B, 1.0), q * q)
    return np.where(tail, np.where(q < 0, outer, -outer), inner)


def binomial_quantile(n: np.ndarray, share: float, u: np.ndarray) -> np.ndarray:
    """How many of ``n`` fall on something of this share, at the point ``u`` of the distribution."""
    if share > 0.5:
        return n - binomial_quantile(n, 1 - share, 1 - u)
    n = n.astype(np.float64)
    mean, few = n * share, n * share <= EXACT_MEAN
    odds = share / (1 - share)
    # Summed up: how many k have a distribution function below u.
    with np.errstate(under="ignore"):
        part = np.exp(n * np.log(1 - share))
    total, exact = part.copy(), np.zeros_like(n)
    for k in range(EXACT_STEPS if few.any() else 0):
        exact += u > total
        part = part * (n - k) / (k + 1) * odds
        total = total + part
    z = normal_quantile(u)
    wide = np.floor(mean + np.sqrt(mean * (1 - share)) * z + (1 - 2 * share) * (z * z - 1) / 6 + 0.5)
    return np.clip(np.where(few, exact, wide), 0, n).astype(np.int64)


def uniform(seed: int, resample: int, node: str) -> float:
    digest = hashlib.md5(f"{seed}|{resample}|{node}".encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / 2.0**52


def _split(rows: np.ndarray, counts: np.ndarray, resamples: np.ndarray, seed: int, name) -> np.ndarray:
    """How many of each resample's ``rows`` fall on each of the counted things, in their order."""
    left, drawn = counts.sum(), np.zeros((len(counts), len(rows)), np.int64)
    for at, count in enumerate(counts):
        u = np.array([uniform(seed, b, name(at)) for b in resamples.tolist()])
        drawn[at] = binomial_quantile(rows, count / left, u)
        rows, left = rows - drawn[at], left - count
    return drawn


def _draw(groups: list[str], seed: int):
    """Of a group's blocks and some resamples: the sum over single values, and the rows of each other block."""

    def draw(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        first = int(blocks["chunk"].iloc[0]) * CHUNK
        numbers = np.arange(first, first + int(blocks["size"].iloc[0]))
        counts = blocks["c"].to_numpy(np.int64)
        names = blocks["block"].to_numpy()
        taken = _split(np.full(len(numbers), counts.sum()), counts, numbers, seed, lambda i: str(names[i]))
        single = blocks["v"].notna().to_numpy()
        parts = [pd.DataFrame({"b": numbers, "block": -1, "m": 0, "t": blocks["v"].to_numpy(np.float64)[single] @ taken[single]})]
        for at in np.flatnonzero(~single):
            parts.append(pd.DataFrame({"b": numbers, "block": names[at], "m": taken[at], "t": 0.0}))
        found = pd.concat(parts)
        for name in groups:
            found[name] = blocks[name].iloc[0]
        return found[[*groups, "b", "block", "m", "t"]]

    return draw


def _draw_inside(groups: list[str], seed: int):
    """Sum of the values that each resample draws from a block of several."""

    def draw(values: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        values, rows = values.sort_values("v"), rows.sort_values("b")
        block = values["block"].iloc[0] if len(values) else 0
        taken = _split(rows["m"].to_numpy(np.int64), values["c"].to_numpy(np.int64), rows["b"].to_numpy(), seed, lambda i: f"{block}.{i}")
        found = pd.DataFrame({"b": rows["b"].to_numpy(), "block": block, "t": values["v"].to_numpy(np.float64) @ taken})
        for name in groups:
            found[name] = values[name].iloc[0]
        return found[[*groups, "b", "block", "t"]]

    return draw


def count_values(scores: DataFrame, value: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """``(groups…, v, c)``: how often each score occurs. All the resampling needs."""
    return (
        scores.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def resample_means(
    counted: DataFrame, groups: Sequence[str] = (), resamples: int = 10_000, seed: int = 0
) -> DataFrame:
    """``(groups…, b, m)``: the mean of each bootstrap resample of ``counted(groups…, v, c)``."""
    groups = list(groups)
    kinds = dict(counted.dtypes)
    named = "".join(f"`{g}` {kinds[g]}, " for g in groups)
    marked = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups]
    counted = counted.withColumn("__g", F.md5(F.concat_ws("\u0001", F.lit(""), *marked)))
    sizes = counted.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    several = materialize(counted.join(sizes, "__g"), "values")
    # At most VALUE_BLOCKS rows a group.
    few = several.where(F.col("n") <= VALUE_BLOCKS)
    few = few.withColumn("block", F.row_number().over(Window.partitionBy("__g").orderBy("v")) - 1)
    many = several.where(F.col("n") > VALUE_BLOCKS).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(VALUE_BLOCKS)).cast("int"))
    dealt = few.unionByName(many).drop("n")
    single = F.when(F.count(F.lit(1)) == 1, F.min("v"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // CHUNK) - 1)))
    blocks = dealt.groupBy(*groups, "__g", "block").agg(F.sum("c").alias("c"), single.alias("v")).withColumn("chunk", chunks)
    blocks = blocks.withColumn("size", F.least(F.lit(CHUNK), resamples - CHUNK * F.col("chunk")))
    drawn = blocks.groupBy("__g", "chunk").applyInPandas(_draw(groups + ["__g"], seed), f"{named}__g string, b bigint, block int, m bigint, t double")
    if several.where(F.col("n") > VALUE_BLOCKS).isEmpty():
        total = counted.groupBy("__g").agg(F.sum("c").alias("n"))
        return drawn.join(total, "__g").select(*groups, "b", (F.col("t") / F.col("n")).alias("m"))
    drawn = materialize(drawn, "drawn")
    inside = many.select(*groups, "__g", "block", "v", "c").groupBy("__g", "block")
    inside = inside.cogroup(drawn.where("block >= 0").groupBy("__g", "block")).applyInPandas(
        _draw_inside(groups + ["__g"], seed), f"{named}__g string, b bigint, block int, t double"
    )
    # A block of one value has no rows to draw inside; sums are made in one order so that the last digit is always the same.
    parts = drawn.where("block = -1").select(*groups, "__g", "b", "block", "t").unionByName(inside)
    parts = parts.groupBy(*groups, "__g", "b").agg(F.array_sort(F.collect_list(F.struct("block", "t"))).alias("parts"))
    total = counted.groupBy("__g").agg(F.sum("c").alias("n"))
    summed = F.aggregate(F.transform("parts", lambda x: x["t"]), F.lit(0.0), lambda acc, t: acc + t)
    return parts.join(total, "__g").select(*groups, "b", (summed / F.col("n")).alias("m"))


def hashed_resample_means(
    scores: DataFrame,
    key: str,
    value: str = "score",
    groups: Sequence[str] = (),
    resamples: int = 200,
    seed: int = 0,
) -> DataFrame:
    """Poisson bootstrap whose weights come from hashing ``seed|resample|key``.

    Built-in functions only, and any engine with md5 can repeat it. Partial sums
    keep the shuffle at one row per resample and task. An approximation: no row
    is drawn more than eight times, which happens once in a million draws. For
    checks; :func:`resample_means` is the method for large tables.
    """
    numbered = scores.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col(key).cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(16**8)
    # The Poisson(1) distribution function, up to eight draws.
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]
    weight = sum((F.when(u >= F.lit(s), 1).otherwise(0) for s in steps[1:]), F.when(u >= F.lit(steps[0]), 1).otherwise(0))
    weighed = numbered.withColumn("w", weight)
    return (
        weighed.groupBy(*groups, "b")
        .agg(F.sum(F.col("w") * F.col(value)).alias("t"), F.sum("w").alias("w"))
        .where(F.col("w") > 0)
        .select(*groups, "b", (F.col("t") / F.col("w")).alias("m"))
    )


def interval(means: DataFrame, groups: Sequence[str] = (), ci: float = 0.95) -> DataFrame:
    """Percentile interval of resample means."""
    alpha = (1 - ci) / 2
    cut = F.percentile("m", F.array(F.lit(alpha), F.lit(1 - alpha)))
    return means.groupBy(*groups).agg(cut.alias("__q")).select(
        *groups,
        F.col("__q")[0].alias("ci_lower"),
        F.col("__q")[1].alias("ci_upper"),
    )


def _with_mean(counted: DataFrame, groups: list[str], bounds: DataFrame) -> DataFrame:
    mean = (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")
    means = counted.groupBy(*groups).agg(F.sum("c").alias("n"), mean)
    if groups:
        return means.join(bounds, groups).select(*groups, "n", "mean", "ci_lower", "ci_upper")
    # One row on each side.
    one = F.lit(1).alias("__k")
    return means.select("*", one).join(bounds.select("*", one), "__k").drop("__k")


def bootstrap_ci(
    scores: DataFrame,
    value: str = "score",
    groups: Sequence[str] = (),
    resamples: int = 10_000,
    ci: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """``(groups…, n, mean, ci_lower, ci_upper)``; no rows at all is an error.

    The scores are computed once: the counts are written and everything else
    reads those.
    """
    groups = list(groups)
    counted = materialize(count_values(scores, value, groups), "counts")
    if counted.isEmpty():
        raise ValueError("there are no scores to resample: give at least one row with a score")
    bounds = interval(resample_means(counted, groups, resamples, seed), groups, ci)
    return _with_mean(counted, groups, bounds)


def hashed_bootstrap_ci(
    scores: DataFrame,
    key: str = "qid",
    value: str = "score",
    groups: Sequence[str] = (),
    resamples: int = 200,
    ci: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    groups = list(groups)
    scores = materialize(scores.select(*groups, key, value), "scores")
    bounds = interval(hashed_resample_means(scores, key, value, groups, resamples, seed), groups, ci)
    return _with_mean(count_values(scores, value, groups), groups, bounds)


def paired(baseline: DataFrame, variant: DataFrame, key: str = "qid", value: str = "score") -> DataFrame:
    """``(key, a, b, difference)`` with difference = variant − baseline.

    A key that one side lacks, or gives twice, is an error. Each side is
    computed once: the pairs are written, checked and then read.
    """
    def side(scores: DataFrame, name: str) -> DataFrame:
        return scores.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{name}"), F.first(value).alias(name))

    both = materialize(side(baseline, "a").join(side(variant, "b"), key, "full"), "pairs")
    bad = F.coalesce((F.col("na") != 1) | (F.col("nb") != 1), F.lit(True))
    if not both.where(bad).isEmpty():
        raise ValueError("paired scores need the same keys on both sides, each once")
    return both.select(key, "a", "b", (F.col("b") - F.col("a")).alias("difference"))


def paired_bootstrap(
    baseline: DataFrame,
    variant: DataFrame,
    key: str = "qid",
    value: str = "score",
    resamples: int = 10_000,
    ci: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Interval of mean(variant − baseline) over the same rows."""
    pairs = paired(baseline, variant, key, value)
    return bootstrap_ci(pairs, "difference", (), resamples, ci, seed)


def detectable_effect(difference: Column | str, ci: float = 0.95) -> Column:
    """Smallest mean difference the rows could resolve: z · sd / √n, as an aggregate."""
    if ci not in Z_BY_LEVEL:
        raise ValueError(f"give ci as one of {sorted(Z_BY_LEVEL)}, not {ci}")
    difference = F.col(difference) if isinstance(difference, str) else difference
    return F.lit(Z_BY_LEVEL[ci]) * F.stddev_samp(difference) / F.sqrt(F.count(difference))


def compare(
    baseline: DataFrame,
    variant: DataFrame,
    key: str = "qid",
    value: str = "score",
    resamples: int = 10_000,
    ci: float = 0.95,
    seed: int = 0,
    hashed: bool = False,
) -> DataFrame:
    """One row: both means with intervals, paired difference, detectable effect, changed share, verdict."""
    pairs = paired(baseline, variant, key, value)
    roles = F.explode(
        F.array(
            F.struct(F.lit("baseline").alias("role"), F.col("a").alias("x")),
            F.struct(F.lit("variant").alias("role"), F.col("b").alias("x")),
            F.struct(F.lit("delta").alias("role"), F.col("difference").alias("x")),
        )
    ).alias("r")
    long = pairs.select(key, roles).select(key, "r.role", "r.x")
    if hashed:
        report = hashed_bootstrap_ci(long, key, "x", ["role"], resamples, ci, seed)
    else:
        report = bootstrap_ci(long, "x", ["role"], resamples, ci, seed)
    picked = [
        F.max(F.when(F.col("role") == role, F.col(col))).alias(f"{role}_{col}")
        for role in ("baseline", "variant", "delta")
        for col in ("mean", "ci_lower", "ci_upper")
    ]
    wide = report.agg(F.max("n").alias("n"), *picked).withColumn("__k", F.lit(1))
    extra = pairs.agg(
        F.avg(F.when(F.col("a") != F.col("b"), 1.0).otherwise(0.0)).alias("rows_changed"),
        detectable_effect("difference", ci).alias("mde"),
    ).withColumn("__k", F.lit(1))
    return (
        wide.join(extra, "__k")
        .drop("__k")
        .withColumn("resolved", resolved("delta_ci_lower", "delta_ci_upper"))
    )


def compare_arms(
    scores: DataFrame,
    baseline: str,
    key: str = "qid",
    resamples: int = 10_000,
    ci: float = 0.95,
    seed: int = 0,
    hashed: bool = False,
) -> DataFrame:
    """Every arm of ``scores(arm, key, score)`` against one of them, paired on the key."""
    # One row per arm and key, so a key's window is a handful of rows.
    own = F.max(F.when(F.col("arm") == baseline, F.col("score"))).over(Window.partitionBy(key))
    diffs = (
        scores.withColumn("__base", own)
        .where((F.col("arm") != baseline) & F.col("__base").isNotNull())
        .select("arm", key, (F.col("score") - F.col("__base")).alias("difference"))
    )
    if hashed:
        report = hashed_bootstrap_ci(diffs, key, "difference", ["arm"], resamples, ci, seed)
    else:
        report = bootstrap_ci(diffs, "difference", ["arm"], resamples, ci, seed)
    return report.withColumn("resolved", resolved("ci_lower", "ci_upper"))


def ship(report: DataFrame) -> DataFrame:
    """The arm with the largest mean among those better than the baseline beyond doubt; maybe no row."""
    better = report.where((F.col("mean") > 0) & (F.col("ci_lower") > 0))
    return better.orderBy(F.col("mean").desc(), "arm").limit(1)
