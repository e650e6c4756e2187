"""Exact top-k by inner product with sorted lists only: no-random-access aggregation.

Candidates are dealt into blocks, and queries too; each pair of blocks is one
task group of bounded size. In a block every dimension is a list of the
candidates sorted by that component. A query reads the lists in order, from the
end that its sign makes best, ``STEP`` entries of each and then twice as many each time. Every
entry is read once and added to its candidate's sum, for all queries of a block together. What has been read gives a candidate a
lower bound (unread components count as the list's worst value) and an upper
bound (unread components count as the value last read). Reading stops when no
candidate outside the k best lower bounds can qualify, or when so few are left that
their final scores settle the rest. Ties go to the smaller id. Only k rows a query and
block leave the task.

Components are doubles times the factor, rounded down. Scores are exact: sums of
doubles while they stay below 2 ** 53, whole numbers of any size beyond that. A
score that does not fit into a long is given as the nearest long, and ranked by its value
as a double.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part. Vectors meet only vectors of the same length. Identical rows are
candidates as often as they stand in the table and ask once as a query; a row
with the query's own id is never its candidate. A null id takes no part. Fewer
than k candidates give all of them; no queries or no rows, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.runtime import materialize

FACTOR = 256
#: Candidates and queries of one block.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024
QUERIES_AT_ONCE = 256
#: Entries of each list that are read before bounds are compared for the first time.
STEP = 512
EXACT = 2**53
LONGS = -(2**63), 2**63 - 1


def usable(vectors: DataFrame, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """(vec_id, v array<double>, times): the rows that take part, identical ones once with their number."""
    double = F.transform(vector_column, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), double.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))


class Lists:
    """The candidates of a block, by component: values from the largest on, and each candidate's place in each list."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        order = np.argsort(-rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, order, axis=0)
        self.place = np.empty(rows.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(rows), dtype=np.int32)[:, None], axis=0)
        self.read = 0

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (row, score) of the rows that may be among the k best, without those marked as its ``own``."""
        (n, dims), place = self.rows.shape, self.place
        back = n - 1 - place
        # Where a query's component is negative its list is read from the small end.
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        total = np.zeros((len(queries), n))
        answers: list = [None] * len(queries)
        active, depth = np.arange(len(queries)), 0

        def added(front: np.ndarray, rear: np.ndarray, top, low) -> np.ndarray:
            """Sums of ``top`` where ``front`` holds and of ``low`` where ``rear`` does, for the queries that still read."""
            return up[active] @ np.where(front, top, 0).T + down[active] @ np.where(rear, low, 0).T

        while len(active):
            before, depth = depth, min(n, depth * 2 if depth else max(STEP, k + 1))
            total[active] += added((place >= before) & (place < depth), (back >= before) & (back < depth), self.rows, self.rows)
            self.read += len(active) * dims * (depth - before)
            # A lower bound adds the lists' last values for what is unread, an upper bound the values last read.
            front, rear = place >= depth, back >= depth
            low = total[active] + added(front, rear, self.values[-1], self.values[0])
            high = total[active] + added(front, rear, self.values[depth - 1], self.values[n - depth])
            low[own[active]], high[own[active]] = -np.inf, -np.inf
            bar = np.partition(low, n - k, axis=1)[:, [n - k]] if n > k else -np.inf
            able = (high >= bar) & (high > -np.inf)
            done = (able.sum(axis=1) <= 4 * k) | (depth == n)
            for at in np.flatnonzero(done):
                found = np.flatnonzero(able[at])
                answers[active[at]] = found, (self.rows[found] * queries[active[at]]).sum(axis=1)
            active = active[~done]
        return answers


def _whole(rows: np.ndarray) -> np.ndarray:
    """Components as whole numbers of any size."""
    return np.array([[math.floor(x * FACTOR) if abs(x) < 2.0**52 else int(x) * FACTOR for x in r] for r in rows.tolist()], object)


def block_top(queries, query_ids, rows, row_ids, times, k: int) -> tuple[list[tuple[int, int, int, float]], int]:
    """(query id, id, score, score as a double) of each query's k best rows of this block, and the entries read."""
    with np.errstate(over="ignore"):
        fast = [np.floor(x * FACTOR) for x in (queries, rows)]
    largest = np.prod([max(1.0, np.abs(x).max(initial=0)) for x in fast]) * max(1, rows.shape[1])
    out: list[tuple[int, int, int, float]] = []
    if largest < EXACT and rows.shape[1]:
        lists = Lists(fast[1])
        starts = range(0, len(query_ids), QUERIES_AT_ONCE)
        answers = (x for a in starts for x in lists.best(*_some(fast[0], query_ids, row_ids, a), k))
    else:
        lists, whole = None, _whole(rows)
        others = (np.flatnonzero(row_ids != i) for i in query_ids)
        answers = ((c, (whole[c] * q).sum(axis=1)) for c, q in zip(others, _whole(queries)))
    for query, (found, scores) in zip(query_ids.tolist(), answers):
        ranked = sorted(zip((-scores).tolist(), row_ids[found].tolist(), times[found].tolist()))
        left = k
        for score, row, n in ranked:
            score = -int(score)
            out += [(query, row, min(max(score, LONGS[0]), LONGS[1]), _double(score))] * min(n, left)
            left -= min(n, left)
            if not left:
                break
    return out, lists.read if lists else 0


def _some(queries, query_ids, row_ids, start: int):
    """Some of the queries, and which rows are their own."""
    part = slice(start, start + QUERIES_AT_ONCE)
    return queries[part], query_ids[part][:, None] == row_ids[None, :]


def _double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(rows: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows. ``rows``: as ``usable`` gives them."""
    rows = materialize(rows, "vectors")
    queries = rows.where(is_query)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    grid = ["length", "query_block", "block"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"length": F.size("v"), "block": deal(blocks)}).withColumn("query_block", every(query_blocks))
    right = queries.withColumns({"length": F.size("v"), "query_block": deal(query_blocks)}).withColumn("block", every(blocks))

    def best(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and asked.num_rows:
            ids = [x.column("vec_id").to_numpy().astype(np.int64) for x in (asked, candidates)]
            vectors = [_matrix(x.column("v")) for x in (asked, candidates)]
            times = candidates.column("times").to_numpy()
            found, _ = block_top(vectors[0], ids[0], vectors[1], ids[1], times, k)
        columns = list(zip(*found)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=["query_id", "vec_id", "score", "value"])

    found = (
        left.groupBy(*grid)
        .cogroup(right.groupBy(*grid))
        .applyInArrow(best, "query_id long, vec_id long, score long, value double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("value"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
