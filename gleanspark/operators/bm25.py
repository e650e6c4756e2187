"""BM25 over chunks as joins and aggregations, with bounds for blocks of chunks.

Building an index reads and tokenizes the chunks once and writes a row per
chunk with its terms; document frequencies and corpus totals come from that.

``BLOCK_CHUNKS`` neighbouring chunk ids are a block, and for each block and term
the index knows the largest count and the shortest chunk: together more than
any chunk of the block can gain from the term. A search sums up these bounds by
query and block first. The blocks with the highest bounds are scored, which
gives every query a k-th score to beat, and of the others only those blocks whose
bound reaches it. All other chunks are never scored; results are exact, ties
included. An index that was just built still has its token rows: with few enough query terms a search
scans them instead, without bounds or shuffles (``bm25_scan``). The bounds hold for any average length, so indexes of several batches
of chunks are put together by adding what they count (``merge_indexes``).

A saved index has its chunks' tokens in folders by a hash of the block and its bounds in folders by a
hash of the term. A search for terms with few postings reads the folders it needs; one that would meet more
than ``BLOCK_MATCHES`` of them scans the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions.text import ENGLISH_STOPWORDS, tokens
from gleanspark.operators import bm25_scan
from gleanspark.operators.selection import top_k
from gleanspark.operators.skew import spread_hot_keys
from gleanspark.runtime import broadcast_if_small, fits, materialize

SCORE_DIGITS = 9
#: Neighbouring chunk ids that share their bounds.
BLOCK_CHUNKS = 64
#: Blocks that are scored for each query before others are compared with the k-th score.
SEED_BLOCKS = 4
#: Postings of the query terms up to which a search of a saved index goes by blocks.
BLOCK_MATCHES = 2_000_000
# Bounds that a task holds at a time, besides those of one batch; blocks that share a row of a saved term.
HELD_BOUNDS = 3_000_000
PART_BLOCKS = 1 << 18
# Files that the tasks of a saved index write at most without a shuffle by folder.
FILES = 20_000
# Sums are compared with bounds up to this share, since their order of summation differs.
SLACK = 1e-9


@dataclass(frozen=True)
class Bm25Parameters:
    """Lucene-style BM25. ``query_tf``: a term given twice in the query counts twice."""

    k1: float = 1.5
    b: float = 0.75
    stopwords: list[str] = field(default_factory=lambda: list(ENGLISH_STOPWORDS))
    query_tf: bool = True


@dataclass(frozen=True)
class Bm25Index:
    """``postings(chunk_id, term, tf, dl)``, ``terms(term, df)`` and ``totals(n_chunks, total_dl, avg_dl)``."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    parameters: Bm25Parameters
    # Folders of a saved index; none for one that lies by block.
    folders: int | None = None
    saved_bounds: DataFrame | None = None
    # Token rows ``(chunk_id, dl, t)``, the tokens joined by blanks; none for an index that was merged.
    tokens: DataFrame | None = None

    @cached_property
    def counted(self) -> Row:
        """The one row of ``totals``."""
        return self.totals.first()

    @cached_property
    def bounds(self) -> DataFrame:
        """``(block, term, tf, dl)``: the largest count of the term and the least length in a block of chunks."""
        if self.saved_bounds is not None:
            return self.saved_bounds
        return materialize(block_bounds(self.postings.withColumn("block", block_of("chunk_id"))), "block-bounds")


def block_of(chunk_id: str) -> Column:
    return F.floor(F.col(chunk_id) / BLOCK_CHUNKS).cast("long")


def block_bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block", "term").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))


def with_term_counts(rows: DataFrame, found: str) -> DataFrame:
    """``rows`` with ``x``: a struct ``(term, tf)`` for each distinct token of the sorted array ``found``.

    Runs of equal tokens; no shuffle, one pass over the tokens.
    """
    starts = F.filter(
        F.transform(found, lambda t, i: F.when((i == 0) | (t != F.get(found, i - 1)), i)), lambda i: i.isNotNull()
    )
    count = lambda at, j: F.coalesce(F.get("starts", j + 1), F.size(found)) - at
    runs = F.transform(
        "starts",
        lambda at, j: F.struct(F.get(found, at).alias("term"), count(at, j).cast("long").alias("tf")),
    )
    # The starts are a column of their own: inside the lambda they would be worked out again for each token.
    return rows.withColumn("starts", starts).withColumn("x", F.explode(runs)).drop("starts")


def build_index(
    chunks: DataFrame, parameters: Bm25Parameters | None = None, text: str = "text"
) -> Bm25Index:
    """The index of ``chunks(chunk_id, text)``, written to the shared folder in one pass over the chunks."""
    parameters = parameters or Bm25Parameters()
    rows = chunks.select("chunk_id", tokens(text, parameters.stopwords).alias("t"))
    rows = rows.select("chunk_id", F.size("t").cast("long").alias("dl"), F.array_join("t", " ").alias("t"))
    joined = materialize(rows, "chunk-tokens")
    # No token has a blank. The sorted tokens are a column of their own, so that their runs do not split again.
    rows = joined.withColumn("t", F.when(F.col("dl") > 0, F.sort_array(F.split("t", " "))).otherwise(F.array().cast("array<string>")))
    by_block = with_term_counts(rows.repartition(block_of("chunk_id")), "t")
    postings = by_block.select("chunk_id", F.col("x.term").alias("term"), F.col("x.tf").alias("tf"), "dl")
    terms = rows.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = _totals(rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("total_dl")))
    return Bm25Index(postings, terms, totals, parameters, tokens=joined)


def _totals(counted: DataFrame) -> DataFrame:
    return counted.select("n_chunks", "total_dl", (F.col("total_dl") / F.col("n_chunks")).alias("avg_dl"))


def merge_indexes(*indexes: Bm25Index) -> Bm25Index:
    """One index of the chunks of several, which share no chunk: postings side by side, counts added up."""
    first, *others = indexes
    if any(i.parameters != first.parameters for i in others):
        raise ValueError("indexes of different parameters count different terms")

    def united(part) -> DataFrame:
        found = part(first)
        for other in others:
            found = found.unionByName(part(other))
        return found

    terms = united(lambda i: i.terms).groupBy("term").agg(F.sum("df").alias("df"))
    counted = united(lambda i: i.totals.select("n_chunks", "total_dl"))
    counted = counted.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("total_dl").alias("total_dl"))
    postings = united(lambda i: i.postings.select("chunk_id", "term", "tf", "dl"))
    bounds = block_bounds(united(lambda i: i.bounds.select("block", "term", "tf", "dl")))
    return Bm25Index(postings, terms, _totals(counted), first.parameters, saved_bounds=bounds)


def _folder(folders: int, key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def _in_folders(rows: DataFrame, folders: int | None, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` of the folders that ``wanted`` keys lie in."""
    if not folders:
        return rows
    # At most as many numbers as there are folders.
    asked = wanted.select(_folder(folders, key).alias("folder")).distinct().collect()
    return rows.where(F.col("folder").isin([r["folder"] for r in asked])).drop("folder")


def query_terms(
    queries: DataFrame, parameters: Bm25Parameters, keys: list[str], query: str = "query"
) -> DataFrame:
    """``(keys…, term, qtf)`` of every query."""
    found = queries.select(*keys, F.explode(tokens(query, parameters.stopwords)).alias("term"))
    counted = found.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf"))
    return counted if parameters.query_tf else counted.withColumn("qtf", F.lit(1))


def _weighed(index: Bm25Index, queries: DataFrame, keys: list[str], query: str) -> tuple[DataFrame, bool]:
    """``(keys…, term, weight)`` of the query terms that the index knows, and whether they are few enough to broadcast."""
    wanted = query_terms(queries, index.parameters, keys, query)
    n = F.lit(float(index.counted["n_chunks"]))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    small = fits(wanted)
    vocabulary = wanted.select("term").distinct()
    known = index.terms.join(F.broadcast(vocabulary) if small else vocabulary, "term", "left_semi")
    weighed = wanted.join(known, "term").select(*keys, "term", (F.col("qtf") * idf).alias("weight"))
    return materialize(weighed, "weights"), small


def _gain(index: Bm25Index) -> Column:
    """What a term of this weight, with ``tf`` of ``dl`` tokens, adds to a score."""
    p = index.parameters
    avg_dl = F.lit(float(index.counted["avg_dl"] or 0.0))
    norm = p.k1 * (1 - p.b + p.b * F.col("dl") / avg_dl)
    return F.col("weight") * F.col("tf") / (F.col("tf") + norm)


def _by_term(rows: DataFrame, weighed: DataFrame, small: bool) -> DataFrame:
    """``rows`` with the queries of their term."""
    if small:
        # No larger than the counted query terms.
        return rows.join(F.broadcast(weighed), "term")
    # Too many to hold everywhere: shuffle by term, hot terms in pieces.
    left, right = spread_hot_keys(rows, weighed, ["term"])
    return left.join(right, ["term", "salt"]).drop("salt")


def score_chunks(
    index: Bm25Index, queries: DataFrame, keys: list[str] | None = None, query: str = "query"
) -> DataFrame:
    """``(keys…, chunk_id, score)`` of every chunk that shares a term with the query."""
    keys = keys or ["qid"]
    weighed, small = _weighed(index, queries, keys, query)
    postings = index.postings.select("chunk_id", "term", "tf", "dl")
    postings = postings if small else materialize(postings, "postings")
    return _by_term(postings, weighed, small).groupBy(*keys, "chunk_id").agg(F.sum(_gain(index)).alias("score"))


def _score_blocks(index: Bm25Index, picked: DataFrame, weighed: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys…, chunk_id, score)`` of the chunks of the blocks that were picked for a query."""
    wanted = broadcast_if_small(picked.select(*keys, "block").join(weighed, keys))
    postings = _in_folders(index.postings, index.folders, "block", picked)
    if "block" not in postings.columns:
        postings = postings.withColumn("block", block_of("chunk_id"))
    matched = postings.join(wanted, ["block", "term"])
    return matched.groupBy(*keys, "chunk_id").agg(F.sum(_gain(index)).alias("score"))


def candidates(
    index: Bm25Index, queries: DataFrame, k: int, keys: list[str] | None = None, query: str = "query"
) -> DataFrame:
    """``(keys…, chunk_id, score)`` of the chunks that had to be scored: the best ``k`` of every query are among them."""
    keys = keys or ["qid"]
    weighed, small = _weighed(index, queries, keys, query)
    bounds = _in_folders(index.bounds, index.folders, "term", weighed)
    tops = _by_term(bounds, weighed, small).groupBy(*keys, "block").agg(F.sum(_gain(index)).alias("bound"))
    tops = materialize(tops, "query-blocks")
    seeds = top_k(tops, keys, [F.desc("bound"), F.col("block")], SEED_BLOCKS + -(-k // BLOCK_CHUNKS), "__seed")
    seeds = materialize(seeds.select(*keys, "block"), "seed-blocks")
    first = top_k(_score_blocks(index, seeds, weighed, keys), keys, _order(), k)
    first = materialize(first.select(*keys, "chunk_id", "score"), "seed-chunks")
    bars = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("score").alias("__bar")).where(F.col("__n") == k)
    bars = broadcast_if_small(bars.select(*keys, "__bar"))
    able = F.col("bound") * (1 + SLACK) + SLACK >= F.coalesce("__bar", F.lit(0.0))
    rest = tops.join(bars, keys, "left").where(able).select(*keys, "block")
    rest = materialize(rest.join(broadcast_if_small(seeds), [*keys, "block"], "left_anti"), "blocks-left")
    return first.unionByName(_score_blocks(index, rest, weighed, keys))


def _order() -> list[Column]:
    return [F.round("score", SCORE_DIGITS).desc(), F.col("chunk_id")]


def _scanned(index: Bm25Index, queries: DataFrame, k: int, keys: list[str], query: str) -> DataFrame | None:
    """The best chunks by a scan of the token rows; none for an index without them or too many query terms."""
    if index.tokens is None:
        return None
    p = index.parameters
    wanted = query_terms(queries, p, keys, query)
    asked = wanted.limit(bm25_scan.MOST_TERMS + 1).collect()
    if len(asked) > bm25_scan.MOST_TERMS:
        return None
    schema = wanted.select(*keys).schema
    return bm25_scan.best_chunks(index.tokens, asked, keys, schema, index.counted, p.k1, p.b, k, SCORE_DIGITS)


def search(
    index: Bm25Index,
    queries: DataFrame,
    k: int,
    keys: list[str] | None = None,
    query: str = "query",
) -> DataFrame:
    """``(keys…, rank, chunk_id, score)``: the best ``k`` chunks of every query.

    Chunks sharing no term with a query are not listed for it. Equal scores are
    ordered by ``chunk_id``.
    """
    keys = keys or ["qid"]
    by_blocks = index.folders is not None and _postings_met(index, queries, keys, query) <= BLOCK_MATCHES
    scored = None if by_blocks else _scanned(index, queries, k, keys, query)
    if scored is None:
        scored = candidates(index, queries, k, keys, query)
    return top_k(scored, keys, _order(), k).select(*keys, "rank", "chunk_id", "score")


def _postings_met(index: Bm25Index, queries: DataFrame, keys: list[str], query: str) -> int:
    """Postings of all query terms, each as often as queries ask for it."""
    asked = query_terms(queries, index.parameters, keys, query).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(index.terms, "term").agg(F.sum(F.col("n") * F.col("df")).alias("n")).first()["n"] or 0


def _token_rows(index: Bm25Index) -> DataFrame:
    if index.tokens is not None:
        return index.tokens.where("dl > 0")
    found = F.array_sort(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))))
    return index.postings.groupBy("chunk_id").agg(F.first("dl").alias("dl"), F.array_join(found, " ").alias("t"))


def _merged(term: np.ndarray, block: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bounds by term and block, with the largest count and the least length of each."""
    order = np.lexsort((block, term))
    term, block = term[order], block[order]
    at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))[: len(order)]
    if not len(at):
        return term, block, tf, dl
    return term[at], block[at], np.maximum.reduceat(tf[order], at), np.minimum.reduceat(dl[order], at)


def _block_lists(block_chunks: int, part_blocks: int, most: int):
    """Bounds of token rows ``(chunk_id, dl, t)``: a row ``(term, part, bounds)`` for a term and ``part_blocks`` blocks.

    One array has the blocks' places in their part, then the counts, then the lengths: short rows are mostly what a row takes.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = pa.chunked_array([h[0] for h in held]).dictionary_encode().combine_chunks()
            if isinstance(names, pa.ChunkedArray):
                names = names.chunk(0)
            term, block, tf, dl = _merged(names.indices.to_numpy(), *(np.concatenate([h[c] for h in held]) for c in (1, 2, 3)))
            part = block // part_blocks
            at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1])))
            # A batch for so many rows, for the lists of frequent terms are long.
            for first in range(0, len(at), 10_000):
                some = at[first : first + 10_000]
                end = at[first + 10_000] if first + 10_000 < len(at) else len(term)
                n = np.diff(np.append(some, end))
                data = np.empty(3 * n.sum(), np.int32)
                at_row = np.repeat(2 * (some - some[0]), n) + np.arange(n.sum())
                for k, values in enumerate((block[some[0] : end] % part_blocks, tf[some[0] : end], dl[some[0] : end])):
                    data[at_row + k * np.repeat(n, n)] = values
                bounds = pa.ListArray.from_arrays(pa.array(np.append(0, 3 * np.cumsum(n)), pa.int32()), pa.array(data))
                columns = [names.dictionary.take(pa.array(term[some])), pa.array(part[some], pa.int64()), bounds]
                yield pa.RecordBatch.from_arrays(columns, ["term", "part", "bounds"])

        for batch in batches:
            found = pc.split_pattern(batch.column(2), " ")
            names = pc.list_flatten(found).dictionary_encode()
            rows = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            pairs, tf = np.unique(rows * len(names.dictionary) + names.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(pairs, max(1, len(names.dictionary)))
            block = batch.column(0).to_numpy() // block_chunks
            code, block, tf, dl = _merged(code, block[row], tf, batch.column(1).to_numpy()[row])
            held.append((names.dictionary.take(pa.array(code)), block, tf, dl))
            size += len(code)
            if size >= most:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return lists


def _joined_lists(part_blocks: int):
    """Of rows ``(folder, term, part, bounds)`` by term and part one for each ``(folder, term, blocks, tfs, dls)``; a block comes once."""

    def joined(rows: pa.Table, change: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        packed = rows.column("bounds").chunk(0)
        n = pc.list_value_length(packed).to_numpy(zero_copy_only=False) // 3
        at, data = np.repeat(2 * (np.cumsum(n) - n), n) + np.arange(n.sum()), packed.flatten().to_numpy()
        block, tf, dl = (data[at + k * np.repeat(n, n)] for k in range(3))
        block = block + np.repeat(rows.column("part").to_numpy() * part_blocks, n)
        run, block, tf, dl = _merged(np.repeat(np.cumsum(change) - 1, n), block, tf, dl)
        first = rows.take(pa.array(np.flatnonzero(change)))
        ends = pa.array(np.append(np.searchsorted(run, np.arange(change.sum())), len(run)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in ((block, pa.int64()), (tf, pa.int32()), (dl, pa.int32()))]
        columns = [first.column("folder").combine_chunks(), first.column("term").combine_chunks(), *lists]
        return pa.RecordBatch.from_arrays(columns, ["folder", "term", "blocks", "tfs", "dls"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([rest, rows]) if rest is not None else rows).combine_chunks()
            if not len(rows):
                continue
            term, part = rows.column("term").chunk(0), rows.column("part").to_numpy()
            other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
            change = np.append(True, other | (part[1:] != part[:-1]))
            last = int(np.flatnonzero(change)[-1])
            if last:
                yield joined(rows.slice(0, last), change[:last])
            rest = rows.slice(last)  # the next batch may go on with it
        if rest is not None and len(rest):
            yield joined(rest, np.append(True, np.zeros(len(rest) - 1, bool)))

    return join


def save_index(index: Bm25Index, path: str, folders: int = 200) -> None:
    """Write the index: chunks with their tokens in ``folders`` folders by a hash of the block, bounds by a hash of the term.

    Chunks are written where they lie, as long as that makes no more than ``FILES`` files. Bounds leave a task as lists,
    a row for a term and ``PART_BLOCKS`` blocks, so that a term in very many blocks does not make one task.
    """
    rows = _token_rows(index).select("chunk_id", "dl", "t")
    placed = rows.withColumn("block", block_of("chunk_id")).withColumn("folder", _folder(folders, "block"))
    if rows.rdd.getNumPartitions() * folders > FILES:
        placed = placed.repartition("folder")
    placed.sortWithinPartitions("folder", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    found = rows.mapInArrow(_block_lists(BLOCK_CHUNKS, PART_BLOCKS, HELD_BOUNDS), "term string, part long, bounds array<int>")
    found = found.select(_folder(folders, "term").alias("folder"), "term", "part", "bounds")
    found = found.repartition("folder", "part").sortWithinPartitions("folder", "term", "part")
    lists = "folder int, term string, blocks array<long>, tfs array<int>, dls array<int>"
    found.mapInArrow(_joined_lists(PART_BLOCKS), lists).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/bounds")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    p = index.parameters
    index.totals.select(
        "n_chunks",
        "total_dl",
        "avg_dl",
        F.lit(p.k1).alias("k1"),
        F.lit(p.b).alias("b"),
        F.lit(p.query_tf).alias("query_tf"),
        F.array(*[F.lit(w) for w in p.stopwords]).cast("array<string>").alias("stopwords"),
        F.lit(folders).alias("folders"),
    ).write.mode("overwrite").parquet(f"{path}/totals")


def load_index(spark: SparkSession, path: str) -> Bm25Index:
    """Open a saved index."""
    totals = spark.read.parquet(f"{path}/totals")
    row = totals.first()
    parameters = Bm25Parameters(row["k1"], row["b"], list(row["stopwords"]), row["query_tf"])
    rows = spark.read.schema("chunk_id long, dl long, t string, block long, folder int").parquet(f"{path}/postings")
    counted = with_term_counts(rows.withColumn("t", F.sort_array(F.split("t", " "))), "t")
    lists = spark.read.schema("term string, blocks array<long>, tfs array<int>, dls array<int>, folder int").parquet(f"{path}/bounds")
    bounds = lists.select("term", "folder", F.explode(F.arrays_zip("blocks", "tfs", "dls")).alias("x"))
    long = lambda c: F.col(f"x.{c}s").cast("long").alias(c)
    return Bm25Index(
        counted.select("chunk_id", F.col("x.term").alias("term"), F.col("x.tf").alias("tf"), "dl", "block", "folder"),
        spark.read.parquet(f"{path}/terms"),
        totals.select("n_chunks", "total_dl", "avg_dl"),
        parameters,
        folders=row["folders"],
        saved_bounds=bounds.select(long("block"), "term", long("tf"), long("dl"), "folder"),
        tokens=rows.select("chunk_id", "dl", "t"),
    )
