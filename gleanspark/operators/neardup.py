"""Near-duplicate texts: exact Jaccard on character shingles as a similarity join.

The answer is the one a nested loop would give:

* a text becomes its number of shingles and a parity bit set of them: every shingle turns one bit over, so two sets differ
  in as many shingles at least as in bits. Only these signatures are shuffled and written, one for all copies of a text;
* candidates of like size lie in blocks of bounded size, each in one task, and the references of a like size stream past
  them. Matrix products of shortened bit sets rule most pairs out, the whole bit sets most of the others;
* texts are read again for the pairs left, which are checked on the full shingle sets.

The question is only whether *any* reference is close enough. Candidates are first compared with the nearest reference
of each slice of the stream, the ones settled there leave, and the rest are compared with all that are near enough: nothing is capped.
Meeting in the blocks is quadratic in the number of texts of a size, at some 50 nanoseconds a pair; each reference goes to
every block of its size and the two beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.text import collapse, shingles
from gleanspark.runtime import broadcast_if_small, materialize

# References of each slice of a block that a candidate is compared with in the first round.
FIRST_ROUND = 1
# Bits of a bit set for each shingle, about, and for any text.
SPARE = 1.5
LEAST_BITS = 1024
# Shortened bit sets have so many bits for each shingle at least: half of them tell strangers from texts near enough.
COARSE = 0.6
# Candidates of one block, the bytes of its bit sets, and the numbers that a task's products may take.
BLOCK_TEXTS = 32_000
BLOCK_BYTES = 32_000_000
CELLS = 4_000_000
# Characters whose shingles are hashed at a time, besides those of one text.
CHARS = 250_000
# Shingles by which hashes may be wrong about a text; pairs so close to the threshold are compared letter by letter.
DOUBT = 2


def jaccard(left: Column | str, right: Column | str, n: int = 5) -> Column:
    """Jaccard similarity of two texts' shingle sets."""
    a, b = shingles(left, n), shingles(right, n)
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def text_id(flat: Column | str) -> Column:
    """Sixteen bytes of a SHA-256: short enough to shuffle, safe enough to stand for the text."""
    return F.unhex(F.substring(F.sha2(flat, 256), 1, 32))


def _hashed(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every text's distinct shingles of n characters, by row.

    Row and hash share 64 bits; a text alone has all of them for its hashes.
    """
    sizes = np.array([max(len(t), n) for t in texts])  # a shorter text is its own shingle, with zeros behind
    letters = "".join(t if len(t) >= n else t.ljust(n, "\0") for t in texts)
    letters = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    whole = np.ones(len(letters) - n + 1, bool)
    for at in range(1, n):  # windows over the end of a text
        whole[ends[:-1] - at] = False
    total = letters[: len(whole)] + np.uint64(1)
    for at in range(1, n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += letters[at : at + len(whole)] + np.uint64(1)
    total = total[whole]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        total ^= total >> np.uint64(shift)
        total *= np.uint64(by)
    left = np.uint64(64 - (len(texts) - 1).bit_length())
    if len(texts) > 1:
        rest = (np.uint64(1) << left) - np.uint64(1)
        total = (np.repeat(np.arange(len(texts), dtype=np.uint64), sizes - n + 1) << left) | (total & rest)
    total.sort()
    total = total[np.append(True, total[1:] != total[:-1])]
    if len(texts) == 1:
        return np.zeros(len(total), np.int64), total
    return (total >> left).astype(np.int64), total & rest


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have ``CHARS`` characters together, besides those of one row."""
    first, letters = 0, 0
    for at, size in enumerate(sizes):
        if at > first and letters + size > CHARS:
            yield first, at
            first, letters = at, 0
        letters += size
    if first < len(sizes):
        yield first, len(sizes)


def _flat(texts: DataFrame, column: str) -> DataFrame:
    """``(tid, flat)``: the collapsed text of every row that has one, and its key."""
    flat = texts.where(F.col(column).isNotNull()).select(collapse(column).alias("flat"))
    return flat.select(text_id("flat").alias("tid"), "flat")


def _folded(texts: DataFrame, column: str, n: int) -> DataFrame:
    """Distinct collapsed texts ``(tid, size, bits)``: number of shingles and their parity bit set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes, bits = batch.column("flat").to_pylist(), [], []
            for first, end in _pieces([len(t) for t in flat]):
                row, hashed = _hashed(flat[first:end], n)
                size = np.bincount(row, minlength=end - first)
                width = 1 << np.rint(np.log2(np.maximum(SPARE * size, LEAST_BITS))).astype(np.int64)
                ends = np.cumsum(width)
                cell = (ends - width)[row] + (hashed & (width[row] - 1).astype(np.uint64)).astype(np.int64)
                packed = np.packbits((np.bincount(cell, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
                sizes += size.tolist()
                bits += [packed[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), width.tolist())]
            columns = [batch.column("tid"), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tid", "size", "bits"])

    return _flat(texts, column).mapInArrow(sign, "tid binary, size int, bits binary").dropDuplicates(["tid"])


def _size_class(size: Column, threshold: float) -> Column:
    step = math.log(1 / min(threshold, 0.99))
    return F.floor(F.log(size.cast("double")) / step + 1e-9).cast("int")


def _prefixes(cand: DataFrame, refs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(class, i, tid, size, bits)`` of candidates, in blocks of each class of like sizes, and of references.

    A reference goes to every block of its own class and of the ones beside it.
    """
    classed = lambda rows: rows.select(_size_class(F.col("size"), threshold).alias("class"), "tid", "size", "bits")
    left, right = classed(cand), classed(refs)
    right = right.withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    needed = F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum(F.octet_length("bits")) / BLOCK_BYTES)
    grid = materialize(left.groupBy("class").agg(F.ceil(needed).cast("int").alias("blocks")), "grid")  # a row per class
    left = left.join(F.broadcast(grid), "class").withColumn("i", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    right = right.join(F.broadcast(grid), "class").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["class", "i", "tid", "size", "bits"]
    return left.select(*columns), right.select(*columns)


def _words(bits: pa.BinaryArray, width: int | None = None) -> np.ndarray:
    """Rows of 64-bit words; bit sets longer than the shortest one, or than ``width``, are folded."""
    ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
    held, sizes = np.frombuffer(bits.buffers()[2], np.uint8), np.diff(ends)
    width = min(int(sizes.min()), (width or 8 * int(sizes.min())) // 8)
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
    parts = [held[ends[a] : ends[b]].view(np.uint64).reshape(b - a, -1) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([_shortened(p, 8 * width) for p in parts])


def _shortened(words: np.ndarray, width: int) -> np.ndarray:
    """Bit sets of ``width`` bits, longer ones folded."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width // 64), axis=1)


def _signs(words: np.ndarray) -> np.ndarray:
    return 1 - 2 * np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def _near(n: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, threshold: float, coarse: int) -> tuple[np.ndarray, ...]:
    """``(i, j, apart)`` of the pairs whose sizes and bit sets allow the threshold."""
    # Differing shingles that the threshold allows to the pair with the most; hashes may be wrong about both sizes.
    rate = (1 - threshold) / (1 + threshold)
    bar = coarse - 2 * (rate * (n + m.max()) + 2 * DOUBT + 0.5)
    i, j = np.nonzero(_signs(_shortened(a, coarse)) @ _signs(_shortened(b, coarse)).T >= bar.astype(np.float32)[:, None])
    able = np.minimum(n[i], m[j]) >= threshold * np.maximum(n[i], m[j]) - 2 * DOUBT
    i, j = i[able], j[able]
    part = max(1, CELLS // a.shape[1])
    apart = [np.bitwise_count(a[i[k : k + part]] ^ b[j[k : k + part]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), part)]
    apart = np.concatenate([np.empty(0, np.int64), *apart])
    able = apart <= rate * (n[i] + m[j]) + 2 * DOUBT
    return i[able], j[able], apart[able]


def _compared(threshold: float, nearest: int | None):
    """Pairs of the references that stream past each block; only the nearest ones on demand.

    Batches hold ``(class, i, side, tid, size, bits)`` in this order, sizes rising, candidates before references.
    """

    def met(block: tuple, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tids, n, a = block
        m, rids = batch.column("size").to_numpy(), batch.column("tid")
        at = 0
        while at < len(m):
            widest = min(2_000, max(1, CELLS // (64 * a.shape[1])))
            b = _words(batch.column("bits").slice(at, widest), 64 * a.shape[1])
            some = m[at : at + widest]
            # Candidates of a size that any of the references can be close to.
            lo = np.searchsorted(n, threshold * some[0] - 2 * DOUBT)
            hi = np.searchsorted(n, (some[-1] + 2 * DOUBT) / threshold, "right")
            for first in range(lo, hi, widest):
                coarse = 64 * b.shape[1]
                x, y = n[first : min(hi, first + widest)], _shortened(a[first : min(hi, first + widest)], coarse)
                while coarse > 64 and coarse // 2 >= COARSE * max(x[-1], some[-1]):
                    coarse //= 2
                i, j, apart = _near(x, y, some, b, threshold, coarse)
                if nearest is not None:
                    order = np.lexsort((j, apart, i))
                    i, j = i[order], j[order]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) < nearest
                    i, j = i[kept], j[kept]
                if len(i):
                    yield pa.RecordBatch.from_arrays([tids.take(pa.array(first + i)), rids.take(pa.array(at + j))], ["tid", "rid"])
            at += widest

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("class", "i", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for first, end in zip(cuts, cuts[1:]):
                rows, key = batch.slice(first, end - first), tuple(keys[first])
                if key[:2] != cell:
                    cell, held, block = key[:2], [], None
                if key[2] == 0:
                    held.append(rows)
                elif held:
                    if block is None:
                        column = lambda c: pa.concat_arrays([r.column(c) for r in held])
                        block = column("tid"), column("size").to_numpy(), _words(column("bits"))
                    yield from met(block, rows)

    return compare


def possible_pairs(left: DataFrame, right: DataFrame, threshold: float, nearest: int | None = None) -> DataFrame:
    """Pairs ``(tid, rid)`` that have to be compared in full; ``nearest``: at most so many of each slice of a stream for a candidate."""
    per_cell = left.groupBy("class", "i").agg(F.count(F.lit(1)).alias("n"))
    cells, texts = per_cell.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    side = lambda rows, at: rows.withColumn("side", F.lit(at)).select("class", "i", "side", "tid", "size", "bits")
    both = side(left, 0).unionByName(side(right, 1))
    # More partitions than cells, so that few tasks get two; a few texts are no task of their own.
    cores = left.sparkSession.sparkContext.defaultParallelism
    dealt = both.repartition(max(1, min(4 * cells, 10_000, cores + texts // 200)), "class", "i").sortWithinPartitions("class", "i", "side", "size")
    return dealt.mapInArrow(_compared(threshold, nearest), "tid binary, rid binary")


def _texts(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``(tid, flat)`` of the wanted keys, once each."""
    return _flat(rows, column).join(broadcast_if_small(wanted.distinct()), "tid", "left_semi").dropDuplicates(["tid"])


def _close(threshold: float, n: int):
    """Of rows ``(tid, flat, rflat)`` the keys of those at or above the threshold."""

    def grams(text: str) -> set[str]:
        return {text[i : i + n] for i in range(len(text) - n + 1)} or {text}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, close = batch.column("flat").to_pylist(), batch.column("rflat").to_pylist(), []
            for first, end in _pieces([len(x) + len(y) for x, y in zip(left, right)]):
                pairs = end - first
                row, hashed = _hashed(left[first:end] + right[first:end], n)
                both = np.bincount(row % pairs, minlength=pairs)
                order = np.lexsort((hashed, row % pairs))
                row, hashed = row[order] % pairs, hashed[order]
                common = np.bincount(row[1:][(row[1:] == row[:-1]) & (hashed[1:] == hashed[:-1])], minlength=pairs)
                needed = threshold / (1 + threshold) * both
                found = common >= needed
                for k in np.flatnonzero(np.abs(common - needed) <= 2 * DOUBT).tolist():
                    x, y = grams(left[first + k]), grams(right[first + k])
                    found[k] = len(x & y) / len(x | y) >= threshold
                close += found.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("tid").filter(pa.array(close, pa.bool_()))], ["tid"])

    return verify


def _matches(pairs: DataFrame, asked: DataFrame, references: DataFrame, column: str, threshold: float, n: int) -> DataFrame:
    """Keys ``tid`` with a pair at or above the threshold; ``asked(tid, flat)`` has the candidates' texts."""
    refs = _texts(references, column, pairs.select(F.col("rid").alias("tid")))
    met = pairs.join(asked, "tid").join(refs.select(F.col("tid").alias("rid"), F.col("flat").alias("rflat")), "rid")
    return met.select("tid", "flat", "rflat").mapInArrow(_close(threshold, n), "tid binary").distinct()


def near_duplicate_keys(
    candidates: DataFrame,
    references: DataFrame,
    column: str = "prompt",
    threshold: float = 0.8,
    n: int = 5,
) -> DataFrame:
    """Collapsed-text keys ``tid`` of the candidates that have a close reference."""
    cand = materialize(_folded(candidates, column, n), "candidates")
    refs = materialize(_folded(references, column, n), "references")
    nearest = materialize(possible_pairs(*_prefixes(cand, refs, threshold), threshold, FIRST_ROUND), "nearest-pairs")
    asked = materialize(_texts(candidates, column, nearest.select("tid")), "texts-asked")
    settled = materialize(_matches(nearest, asked, references, column, threshold, n), "settled")
    # A candidate without a near enough reference is settled as well.
    unsure = materialize(nearest.select("tid").distinct().join(broadcast_if_small(settled), "tid", "left_anti"), "unsure")
    rest = cand.join(broadcast_if_small(unsure), "tid", "left_semi")
    left = materialize(possible_pairs(*_prefixes(rest, refs, threshold), threshold), "pairs-left")
    second = materialize(_matches(left, asked, references, column, threshold, n), "settled-later")
    return settled.unionByName(second)


def mark_near_duplicates(
    candidates: DataFrame,
    references: DataFrame,
    column: str = "prompt",
    threshold: float = 0.8,
    n: int = 5,
    out: str = "near_duplicate",
) -> DataFrame:
    """Add a flag: some reference is at least ``threshold`` similar. Rows are never multiplied."""
    found = near_duplicate_keys(candidates, references, column, threshold, n)
    keyed = candidates.withColumn("tid", text_id(collapse(column)))
    hits = found.withColumn("__hit", F.lit(True))
    return (
        keyed.join(broadcast_if_small(hits), "tid", "left")
        .withColumn(out, F.coalesce("__hit", F.lit(False)))
        .drop("tid", "__hit")
    )


def drop_near_duplicates(
    candidates: DataFrame,
    references: DataFrame,
    column: str = "prompt",
    threshold: float = 0.8,
    n: int = 5,
) -> DataFrame:
    """Only the rows with no close reference."""
    marked = mark_near_duplicates(candidates, references, column, threshold, n)
    return marked.where(~F.col("near_duplicate")).drop("near_duplicate")
