"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

A vector's code has a bit for the sign of each coordinate after a rotation. The
rotations are learned on a sample of ``SAMPLE`` vectors by iterative quantization,
each from another start, until the code has ``BITS`` bits or more. Codes are cut
into substrings of eight bits, and each substring is indexed: for every key, the
bit set of the rows that have it. By the pigeonhole principle a code within a
distance R of the query's has a substring within R // m errors, m being the number
of substrings; probing unites the sets of all keys with so few errors, so every
code within the radius is retrieved.

Candidates are dealt into blocks of like length of vector (within a factor of
2 ** 0.25), and a block's index answers a block of queries. The radius follows
from what has been found: a row that could still enter the ``k`` best has at
least the cosine of the k-th score by the longest vector of the block; its
code is within ``radius`` with a probability that ``DEVIATIONS`` standard
deviations of a binomial give. Queries begin with exact substrings and go on to
the errors that this radius asks for. What is within it is ranked by the floats,
and k rows per query and block leave the task.

Equal vectors are one row with their k + 1 smallest ids; others of them cannot be
among the k best. Scores are sums in double precision, equal for equal vectors.

Where neighbours are hardly nearer than other rows, the radius is near half of
the bits: then probing reaches most rows of a block and the full codes decide.

Defined results: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do rows with a null id. Vectors meet only vectors of
the same length. Identical rows count once; a row with the query's own id is
never its candidate. A sum that overflows is infinite; one that is no number
comes last. Fewer than k candidates give all; no rows or no queries, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.runtime import broadcast_if_small, materialize

#: Vectors that rotations are learned on.
SAMPLE = 10_000
BITS = 256
ROUNDS = 15
#: Rows and queries of one block, and queries handled at a time.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024
SLICE = 128
DEVIATIONS = 1.5

_ERRORS = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]).astype(np.uint8)


def rotations(sample: np.ndarray, dims: int, bits: int = BITS, seed: int = 3) -> np.ndarray:
    """Projections (dims, a multiple of 8 of ``bits`` or more), orthogonal in blocks and fitted to the sample's signs."""
    rng = np.random.default_rng([seed, dims])
    blocks = []
    while len(blocks) * dims < bits or len(blocks) * dims % 8:
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(ROUNDS if len(sample) > dims else 0):
            u, _, v = np.linalg.svd(sample.T @ np.sign(sample @ turn))
            turn = u @ v
        blocks.append(turn)
    return np.hstack(blocks)


def radius(cosine: np.ndarray, bits: int) -> np.ndarray:
    """Distance that codes of vectors with this cosine seldom exceed."""
    share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return np.ceil(bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share))).astype(np.int64)


class Index:
    """The rows of a block: codes, and per substring and key the rows that have it."""

    def __init__(self, rows: np.ndarray, turn: np.ndarray):
        self.turn, self.unit = turn, _unit(rows)
        sizes = _norms(rows)
        self.weight = sizes / sizes.max()  # no longer than the longest
        self.codes, self.words = self._encoded(self.unit)
        self.keys = [np.packbits(np.arange(256)[:, None] == self.codes[:, j], axis=1) for j in range(self.codes.shape[1])]
        self.balls: dict[int, list[np.ndarray]] = {0: self.keys}

    def _encoded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.packbits(unit @ self.turn > 0, axis=1)
        padded = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))
        return codes, np.ascontiguousarray(padded).view(np.uint64)

    def _ball(self, errors: int) -> list[np.ndarray]:
        """Per substring and key: the rows with a key of at most so many errors."""
        if errors not in self.balls:
            near = [np.flatnonzero(_ERRORS[key] <= errors) for key in range(256)]
            self.balls[errors] = [np.stack([np.bitwise_or.reduce(sets[x], axis=0) for x in near]) for sets in self.keys]
        return self.balls[errors]

    def near(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all that is within each query's radius."""
        unit = _unit(queries)
        codes, words = self._encoded(unit)
        substrings, bits, n = codes.shape[1], 8 * codes.shape[1], len(self.unit)
        errors = np.zeros(len(queries), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(9):
            open_ = np.flatnonzero(errors == level)
            for at in range(0, len(open_), SLICE):
                asked = open_[at : at + SLICE]
                sets = self._ball(level)
                held = np.zeros((len(asked), sets[0].shape[1]), np.uint8)
                for j in range(substrings):
                    held |= sets[j][codes[asked, j]]
                distance = np.zeros((len(asked), n), np.int64)
                for w in range(words.shape[1]):
                    distance += np.bitwise_count(words[asked, w][:, None] ^ self.words[None, :, w])
                distance[np.unpackbits(held, axis=1, count=n) == 0] = bits + 1
                # The k-th score among the nearest codes says which radius is needed.
                few = min(n, 4 * (k + 1))
                first = np.argpartition(distance, few - 1, axis=1)[:, :few]
                scores = np.einsum("qd,qcd->qc", unit[asked], self.unit[first]) * self.weight[first]
                scores[np.take_along_axis(distance, first, axis=1) > bits] = -np.inf
                enough = few > k
                bar = np.sort(scores, axis=1)[:, -(k + 1)] if enough else np.full(len(asked), -np.inf)
                needed = np.where(np.isfinite(bar), radius(np.where(np.isfinite(bar), bar, 0), bits), bits)
                settled = (needed < substrings * (level + 1)) | (level == 8)
                q, c = np.nonzero((distance <= needed[:, None]) & settled[:, None])
                found.append((asked[q], c))
                errors[asked[~settled]] = np.minimum(8, needed[~settled] // substrings)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _norms(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1)
    return largest * np.sqrt(((rows / largest[:, None]) ** 2).sum(axis=1))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1)[:, None]
    return scaled / np.sqrt((scaled**2).sum(axis=1))[:, None]


def block_top(queries, query_ids, rows, ids, offsets, k: int, turn: np.ndarray):
    """(query id, id, score) of each query's k best ids of this block; row r has the ids between its offsets."""
    q, c = Index(rows, turn).near(queries, k)
    with np.errstate(over="ignore", invalid="ignore"):
        parts = [(queries[q[a : a + 50_000]] * rows[c[a : a + 50_000]]).sum(axis=1) for a in range(0, len(q), 50_000)]
    scores = np.concatenate(parts) if parts else np.zeros(0)
    times = np.diff(offsets)[c]
    each = np.repeat(offsets[c] - np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64), times) + np.arange(times.sum())
    q, scores, found = np.repeat(q, times), np.repeat(scores, times), ids[each]
    other = query_ids[q] != found
    q, scores, found = q[other], scores[other], found[other]
    order = np.lexsort((found, -np.where(np.isnan(scores), -np.inf, scores), q))
    q, scores, found = q[order], scores[order], found[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return query_ids[q[rank < k]], found[rank < k], scores[rank < k]


def usable(vectors: DataFrame, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part, identical ones once."""
    double = F.transform(vector_column, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), double.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(finite & F.exists("v", lambda x: x != 0)).distinct()


def _sampled(rows: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Unit vectors of each length among the ``size`` rows with the least hashes."""
    picked = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(size).collect()
    by_length: dict[int, list] = {}
    for row in picked:
        by_length.setdefault(len(row.v), []).append(row.v)
    return {n: _unit(np.array(x)) for n, x in by_length.items()}


def _size_class(v):
    """Vectors of one class are alike in length within a factor of 2 ** 0.25."""
    largest = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x / largest) * (x / largest))
    return F.floor(4 * (F.log2(largest) + F.log2(squares) / 2)).cast("int")


def search(rows: DataFrame, is_query, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found. ``rows``: vec_id long, v array<double>."""
    rows = materialize(rows, "vectors")
    learned = {n: rotations(x, n) for n, x in _sampled(rows, sample).items()}
    least = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    folded = rows.withColumn("place", least).where(F.col("place") <= k + 1)
    folded = folded.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    folded = materialize(folded.withColumns({"length": F.size("v"), "size": _size_class(F.col("v"))}), "distinct-vectors")
    sizes = folded.groupBy("length", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = broadcast_if_small(materialize(sizes, "size-classes"))
    queries = rows.where(is_query)
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), n).cast("int")
    grid = ["length", "size", "block", "query_block"]
    left = folded.join(sizes, ["length", "size"]).withColumn("block", deal(F.col("blocks"), "v"))
    left = left.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select(*grid, "v", "ids")
    right = queries.withColumns({"length": F.size("v"), "query_block": deal(F.lit(query_blocks), "vec_id", "v")})
    right = right.join(sizes, "length").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select(*grid, "v", "vec_id")

    def best(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not candidates.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        matrix, questions = _matrix(candidates.column("v")), _matrix(asked.column("v"))
        turn = learned.get(matrix.shape[1])
        turn = rotations(matrix[:0], matrix.shape[1]) if turn is None else turn
        lists = candidates.column("ids").combine_chunks()
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        ids = lists.flatten().to_numpy()
        return pa.table(block_top(questions, asked.column("vec_id").to_numpy(), matrix, ids, offsets, k, turn), names=names)

    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(best, "query_id long, vec_id long, score double")
    value = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(value.desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)
