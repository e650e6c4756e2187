"""Exact nearest neighbours over supplied embeddings.

Items lie in blocks of like vector length. The product with a query is at most the
product of both lengths, so once a query has its k-th score from the block of the longest vectors,
blocks whose bound stays under it are not read for this query. Where all vectors are equally long every block is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.scores import dot
from gleanspark.operators.selection import top_k
from gleanspark.runtime import broadcast_if_small, materialize

# Queries and items of one block: a task multiplies one block of each.
QUERY_BLOCK = 2_000
ITEM_BLOCK = 20_000
#: Products a task holds at a time.
CELLS = 2_000_000
SCORE_DIGITS = 9


def _best_columns(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values per row; equal values keep the lower column."""
    k = min(k, sims.shape[1])
    chosen = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    floor = np.take_along_axis(sims, chosen, axis=1).min(axis=1, keepdims=True)
    crowded = (sims >= floor).sum(axis=1) > k
    if crowded.any():
        chosen[crowded] = np.argsort(-sims[crowded], axis=1, kind="stable")[:, :k]
    return chosen


def _scored(k: int):
    """k best items of one block for each query of another; items of a query's own part where there are parts."""

    def best(asked: pd.DataFrame, stored: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # Ascending keys, so that equal scores keep the lower one.
        stored = stored.sort_values("item", kind="stable")
        items, queries = stored["item"].to_numpy(), asked["query"].to_numpy()
        vectors = np.stack(stored["embedding"].to_numpy()).astype(np.float64).T
        step = max(1, CELLS // len(items))
        for at in range(0, len(queries), step):
            some = slice(at, at + step)
            matrix = np.stack(asked["embedding"].to_numpy()[some]).astype(np.float64)
            sims = np.round(matrix @ vectors, SCORE_DIGITS)
            columns = _best_columns(sims, k)
            row = np.repeat(np.arange(len(matrix)), columns.shape[1])
            yield pd.DataFrame(
                {"query": queries[some][row], "item": items[columns.ravel()], "score": sims[row, columns.ravel()]}
            )

    def score(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "item": [], "score": []})
        if asked.empty or stored.empty:
            return none
        if "part" not in asked:
            return pd.concat(list(best(asked, stored)))
        parts = dict(list(asked.groupby("part")))
        found = [rows for part, own in stored.groupby("part") if part in parts for rows in best(parts[part], own)]
        return pd.concat(found) if found else none

    return score


def _length() -> Column:
    return F.sqrt(dot("embedding", "embedding"))


def _placed(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``items`` with ``length`` and ``block``, and ``(block, n, bound)``: blocks of about ``size`` items of like
    length; 0 has the longest. Equally long items are dealt by a hash of their key."""
    items = materialize(items.withColumn("length", _length()), "items")
    number = max(1, -(-items.count() // size))
    cuts = F.percentile_approx("length", [1 - k / number for k in range(1, number)], 10_000) if number > 1 else F.array().cast("array<double>")
    # One row of at most as many numbers as there are blocks.
    classed = items.crossJoin(F.broadcast(items.agg(cuts.alias("cuts"))))
    classed = classed.withColumn("class", F.size(F.filter("cuts", lambda x: x > F.col("length")))).drop("cuts")
    parts = classed.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    placed = classed.join(F.broadcast(parts), "class")  # a row per class
    placed = placed.withColumn("block", F.struct("class", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part")))
    placed = placed.drop("class", "parts")
    return placed, materialize(placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("bound")), "item-blocks")


def _searched(asks: DataFrame, placed: DataFrame, k: int, size: int, kinds: str) -> DataFrame:
    """``(query, item, score)``: k best items of each block for the queries that ask for it, ``(query, embedding, block)``."""
    groups = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("groups"))
    groups = broadcast_if_small(materialize(groups, "query-groups"))
    # Python takes the products of a slice of queries at a time.
    left = asks.join(groups, "block").withColumn("g", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).drop("groups")
    right = placed.drop("length").join(groups, "block").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    return left.groupBy("block", "g").cogroup(right.groupBy("block", "g")).applyInPandas(_scored(k), kinds)


def open_blocks(asked: DataFrame, first: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``(query, embedding, block)``: blocks behind the first that a query's k-th score does not rule out."""
    bars = first.groupBy("query").agg(F.count(F.lit(1)).alias("__n"), F.min("score").alias("bar")).where(F.col("__n") == k)
    bars = broadcast_if_small(bars.select("query", "bar"))
    listed = F.broadcast(blocks.agg(F.sort_array(F.collect_list(F.struct("block", "bound"))).alias("blocks")))  # one row
    rows = asked.withColumn("length", _length()).join(bars, "query", "left").crossJoin(listed)
    slack = 10.0**-SCORE_DIGITS
    able = lambda x: F.col("bar").isNull() | (F.col("length") * x["bound"] * (1 + 1e-12) + slack >= F.col("bar"))
    later = F.slice("blocks", 2, F.greatest(F.size("blocks"), F.lit(1)))
    return rows.select("query", "embedding", F.explode(F.filter(later, able)).alias("x")).select("query", "embedding", "x.block")


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_key: str = "qid",
    item_key: str = "vec_id",
    block: int = QUERY_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """``(query_key, rank, item_key, score)``: top-k by inner product over the whole corpus.

    Each query meets the block of the longest items, and then the blocks that may
    hold better ones. A block and the queries that ask for it are groups of bounded size on the
    executors that hand on k rows per query. No vector passes the driver.
    """
    asked = queries.select(F.col(query_key).alias("query"), "embedding")
    placed, blocks = _placed(corpus.select(F.col(item_key).alias("item"), "embedding"), item_block)
    kinds = f"query {dict(asked.dtypes)['query']}, item {dict(placed.dtypes)['item']}, score double"
    head = F.broadcast(blocks.agg(F.min("block").alias("block")))  # one row
    first = materialize(_searched(asked.crossJoin(head).where("block is not null"), placed, k, block, kinds), "first-block")
    asks = materialize(open_blocks(asked, first, blocks, k), "open-blocks")
    found = first.unionByName(_searched(asks, placed, k, block, kinds))
    best = top_k(found, ["query"], [F.col("score").desc(), F.col("item")], k)
    return best.select(F.col("query").alias(query_key), "rank", F.col("item").alias(item_key), "score")


def nearest_within(
    queries: DataFrame,
    allowed: DataFrame,
    sentences: DataFrame,
    k: int,
    query_key: str = "qid",
    document_key: str = "document_id",
    item_key: str = "sentence_id",
    query_block: int = QUERY_BLOCK,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """Top-k sentences per query among the documents ``allowed(query_key, document_key)``.

    Documents are cut or put together into blocks of about ``item_block`` sentences, and a block meets the queries that
    may see its documents in groups of bounded size, as in :func:`nearest`.
    """
    pairs = allowed.select(F.col(query_key).alias("query"), F.col(document_key).alias("part")).distinct()
    asked = queries.select(F.col(query_key).alias("query"), "embedding")
    stored = sentences.select(F.col(document_key).alias("part"), F.col(item_key).alias("item"), "embedding")
    stored = stored.where("part is not null")
    pairs = materialize(pairs.join(asked, "query"), "document-queries")
    whole = F.col("embedding").isNotNull()
    kinds = f"query {dict(asked.dtypes)['query']}, item {dict(stored.dtypes)['item']}, score double"
    # A document with many sentences is several blocks, small documents share one.
    sizes = stored.where(whole).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // item_block))
    sizes = sizes.select(
        "part",
        F.when(F.col("n") <= item_block, F.pmod(F.xxhash64("part"), F.lit(buckets))).otherwise(F.xxhash64("part")).alias("bucket"),
        F.ceil(F.col("n") / item_block).cast("int").alias("pieces"),
    )
    sizes = broadcast_if_small(materialize(sizes, "document-sizes"))
    piece = F.pmod(F.xxhash64("item"), F.col("pieces")).cast("int")
    block = lambda at: F.struct("bucket", F.col("pieces").alias("of"), at.alias("piece")).alias("block")
    placed = stored.where(whole).join(sizes, "part").select("part", "item", "embedding", block(piece))
    asks = pairs.where(whole).join(sizes, "part").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asks = asks.select("query", "part", "embedding", block(F.col("at")))
    found = _searched(asks, placed, k, query_block, kinds)
    # What has no vector has no score, and comes last.
    no_item = stored.where(~whole).join(pairs.select("query", "part"), "part")
    no_query = stored.where(whole).join(pairs.where(~whole).select("query", "part"), "part")
    unscored = no_item.unionByName(no_query).select("query", "item", F.lit(None).cast("double").alias("score"))
    best = top_k(found.unionByName(unscored), ["query"], [F.col("score").desc(), F.col("item")], k)
    return best.select(F.col("query").alias(query_key), "rank", F.col("item").alias(item_key), "score")


def normalized(embedding: str = "embedding") -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    length = F.sqrt(dot(embedding, embedding))
    return F.when(
        length > 0, F.transform(F.col(embedding), lambda x: x.cast("double") / length)
    ).otherwise(F.transform(F.col(embedding), lambda x: x.cast("double")))
