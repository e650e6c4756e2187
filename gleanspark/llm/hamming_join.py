"""Near duplicates by a multi-index Hamming join of b-bit minwise signatures.

A document's set of word shingles has a signature of ``SLOTS`` slots of ``BITS``
bits. Two sets of Jaccard similarity J differ in each slot with probability
about 1 - J. The first ``4 * n`` slots are indexed, in n chunks of four: pairs
that differ in at most 2 n - 1 of them are all found, since by the pigeonhole
principle they differ in at most one slot of one chunk, and each chunk is
entered once for every slot that may be wrong, with that slot left out. n is
the least number for which a pair at the asked similarity exceeds that distance
with a probability under ``MISS`` (``thresholds``).

Candidates meet in the buckets of these keys. Links are confirmed on the full
sets. Only components are asked for, so a bucket need not give all its pairs:

1. Copies (equal sets) are one node from the start.
2. In some rounds every node is compared with its bucket's centre, the best one
   of those that are in another component yet; links contract components.
3. Buckets that still hold several components are put together by their centre,
   dealt into blocks of ``BLOCK`` nodes, and every pair of blocks is one task
   group of bounded size that has the full sets: it compares all its pairs that
   are apart, unless sizes or the whole signature exclude a link, and gives only
   the links that join components.

Step 3 leaves no candidate out, so no link is lost; steps 1 and 2 keep it small
where a bucket is one large group of copies.

Defined results: null and empty texts, and texts without a word, have an empty
set and are linked with nothing. Rows with a null id are linked with nothing,
have no component and are kept. Rows that repeat an id are answered by their
own text. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.arrow import map_columns
from gleanspark.llm.components import components
from gleanspark.runtime import broadcast_if_small, materialize

BITS = 14
LANE = BITS + 1  # one free bit per slot, for comparing slots inside a long
PER_LONG = 4
SLOTS = 128
# Probability that a pair at the asked similarity is beyond a signature distance.
MISS = 1e-5
ROUNDS = 2
# Nodes of a block in the last step.
BLOCK = 256
BROADCAST_ROWS = 1_000_000

_M1, _M2, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_LOW = sum(((1 << BITS) - 1) << (LANE * k) for k in range(PER_LONG))
_HIGH = sum((1 << BITS) << (LANE * k) for k in range(PER_LONG))


def ordered_shingles(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the word shingles in order; A-Z in lower case. Fewer than ``size`` words are one shingle."""
    words = (text or "").encode().lower().split()  # bytes split at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _M1 + hashes[k : k + n] * _M2
    mixed ^= mixed >> np.uint64(29)
    mixed *= _M4
    return mixed ^ (mixed >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(ordered_shingles(text, size))


class Signer:
    def __init__(self, slots: int = SLOTS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.factors = (rng.integers(0, 2**32, slots, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.offsets = rng.integers(0, 2**32, slots, dtype=np.uint64).astype(np.uint32)
        self.shifts = np.arange(PER_LONG, dtype=np.int64) * LANE

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """Signature as longs with ``PER_LONG`` slots each."""
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(values), 512):
            block = self.factors[:, None] * values[None, k : k + 512]
            block += self.offsets[:, None]
            np.minimum(least, block.min(axis=1), out=least)
        slots = (least & np.uint32((1 << BITS) - 1)).astype(np.int64).reshape(-1, PER_LONG)
        return (slots << self.shifts).sum(axis=1)


def signatures(documents: DataFrame, size: int, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, n_shingles, set_key binary, signature array<long>) of every row."""

    def make():
        signer = Signer()

        def step(keys, texts):
            counts, names, signed = [], [], []
            for text in texts.to_pylist():
                shingles = shingle_set(text, size)
                counts.append(len(shingles))
                names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                signed.append(signer.sign(shingles))
            flat = np.concatenate(signed) if signed else np.zeros(0, np.int64)
            offsets = np.arange(len(signed) + 1, dtype=np.int32) * (SLOTS // PER_LONG)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            return [keys, counts, names, lists]

        return step

    schema = f"`{id_column}` long, n_shingles long, set_key binary, signature array<long>"
    return map_columns(documents, [id_column, text_column], schema, make)


def _sets(documents: DataFrame, wanted: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(node, n, shingles array<long>) of the documents whose id is a node of ``wanted``."""
    rows = documents.join(
        broadcast_if_small(wanted.select(F.col("node").alias(id_column)).distinct(), BROADCAST_ROWS), id_column, "left_semi"
    )

    def make():
        def step(keys, texts):
            sets = [shingle_set(t, size).view(np.int64) for t in texts.to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            return [keys, [len(s) for s in sets], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

        return step

    return map_columns(rows, [id_column, text_column], "node long, n long, shingles array<long>", make)


def thresholds(share: int) -> tuple[int, int]:
    """(chunks, errors): chunks of the index, and slots of the whole signature that may differ."""
    differ = 1 - share / 100

    def beyond(slots: int, errors: int) -> float:
        chances = (comb(slots, k) * differ**k * (1 - differ) ** (slots - k) for k in range(errors + 1, slots + 1))
        return sum(chances)

    chunks = next((n for n in range(1, SLOTS // PER_LONG) if beyond(PER_LONG * n, 2 * n - 1) < MISS), None)
    if chunks is None:
        raise ValueError("the signature is too short for so low a similarity")
    return chunks, next(e for e in range(SLOTS + 1) if beyond(SLOTS, e) < MISS)


def _keys(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, node): each chunk of the indexed slots, once for every slot that is left out."""
    each = []
    for chunk in range(chunks):
        value = F.col("signature")[chunk]
        for slot in range(PER_LONG):
            keep = ((1 << 63) - 1) & ~(((1 << LANE) - 1) << (LANE * slot))
            each.append(F.xxhash64(F.lit(chunk * PER_LONG + slot), value.bitwiseAND(F.lit(keep))))
    return nodes.select("node", F.explode(F.array(*each)).alias("key"))


def _equal_slots(a: Column, b: Column, first: int, last: int) -> Column:
    """How many slots of the longs ``first`` … ``last`` - 1 are equal."""
    differ = [
        F.bit_count((a[k].bitwiseXOR(b[k]) + F.lit(_LOW)).bitwiseAND(F.lit(_HIGH))) for k in range(first, last)
    ]
    return F.lit(PER_LONG * (last - first)) - reduce(lambda x, y: x + y, differ)


def _may_link(a: str, b: str, share: int) -> Column:
    """Sizes and signatures do not exclude a link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    x, y = F.col(f"{a}.signature"), F.col(f"{b}.signature")
    sizes = 100 * F.least(n, m) >= share * F.greatest(n, m)
    chunks, errors = thresholds(share)
    index = _equal_slots(x, y, 0, chunks) >= PER_LONG * chunks - (2 * chunks - 1)
    return sizes & index & (_equal_slots(x, y, 0, SLOTS // PER_LONG) >= SLOTS - errors)


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= share * union."""
    pairs = materialize(pairs, "candidate-pairs")
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    left = left.join(broadcast_if_small(pairs, BROADCAST_ROWS), "a")
    right = right.join(broadcast_if_small(pairs.select("b").distinct(), BROADCAST_ROWS), "b", "left_semi")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        left.join(right, "b")
        .where(100 * shared >= share * (F.col("na") + F.col("nb") - shared))
        .select("a", "b")
    )


def _last_links(rows: DataFrame, known: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b): links between the components that meet in a bucket. ``rows``: key, node, component."""
    keys = rows.groupBy("key").agg(
        F.min("node").alias("centre"), F.min("component").alias("l"), F.max("component").alias("h")
    )
    keys = keys.where("l < h").select("key", "centre")
    groups = materialize(rows.join(keys, "key").select("centre", "node", "component").distinct(), "open-groups")
    sizes = groups.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = broadcast_if_small(materialize(sizes, "group-sizes"), BROADCAST_ROWS)
    cells = groups.join(sizes, "centre").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "centre", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    wanted = broadcast_if_small(groups.select("node").distinct(), BROADCAST_ROWS)
    full = sets.join(wanted, "node", "left_semi").join(known.select("node", "signature"), "node")
    least = SLOTS - thresholds(share)[1]

    def compare(table: pa.Table) -> pa.Table:
        own, first = table.column("own").to_pylist(), table.column("i")[0].as_py()
        nodes, roots = table.column("node").to_pylist(), table.column("component").to_pylist()
        shingles = [x.values.to_numpy() for x in table.column("shingles")]
        signed = np.stack([x.values.to_numpy() for x in table.column("signature")])
        slots = np.stack([(signed >> (LANE * k)) & ((1 << BITS) - 1) for k in range(PER_LONG)], axis=2)
        slots = slots.reshape(len(nodes), -1).astype(np.uint16)
        sizes = np.array([len(x) for x in shingles])
        root = np.unique(roots, return_inverse=True)[1]
        left = [k for k, o in enumerate(own) if o == first]
        right = left if first == table.column("j")[0].as_py() else [k for k, o in enumerate(own) if o != first]
        right = np.array(right, np.int64)
        out = []
        for a in left:
            small, large = np.minimum(sizes[a], sizes[right]), np.maximum(sizes[a], sizes[right])
            able = right[(root[right] != root[a]) & (100 * small >= share * large)]
            able = able[(slots[able] == slots[a]).sum(axis=1) >= least]
            for b in able.tolist():
                if root[a] == root[b]:
                    continue  # a link found here has joined them
                shared = len(np.intersect1d(shingles[a], shingles[b], assume_unique=True))
                if 100 * shared >= share * (sizes[a] + sizes[b] - shared):
                    out.append((nodes[a], nodes[b]))
                    root[root == root[b]] = root[a]
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    grid = ["centre", "i", "j"]
    return cells.join(full, "node").groupBy(*grid).applyInArrow(compare, "a long, b long")


def _contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` between nodes."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    merged = components(links.join(of("a"), "a").join(of("b"), "b").select("ca", "cb"))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return (
        labels.join(broadcast_if_small(merged, BROADCAST_ROWS), "component", "left")
        .select("node", F.coalesce("root", "component").alias("component"))
    )


def near_duplicates(
    documents: DataFrame, size: int = 5, share: int = 80, id_column="doc_id", text_column="text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; links have ``share`` percent of similarity or more.

    The default is for five words and 80 percent; other shares change the index (``thresholds``).
    """
    documents = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = materialize(signatures(documents, size), "signatures")
    nodes = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    )
    nodes = materialize(nodes, "nodes")
    keys = _keys(nodes, thresholds(share)[0])
    shared = keys.groupBy("key").agg(F.min("node").alias("l"), F.max("node").alias("h")).where("l < h").select("key")
    members = materialize(keys.join(shared, "key"), "buckets")
    known = nodes.select("node", "n", "signature").join(
        broadcast_if_small(members.select("node").distinct(), BROADCAST_ROWS), "node", "left_semi"
    )
    known = materialize(known, "bucket-nodes")
    sets = materialize(_sets(documents, known, size, "doc_id", "text"), "shingle-sets")
    labels = known.select("node", F.col("node").alias("component")).distinct()

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(labels, BROADCAST_ROWS), "node")

    for turn in range(ROUNDS):
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        rows = labelled(members)
        centre = rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("c"))
        centre = centre.select("key", F.col("c.node").alias("b"), F.col("c.component").alias("cb"))
        pairs = rows.join(centre, "key").where("component <> cb").select(F.col("node").alias("a"), "b").distinct()
        left = known.select(F.col("node").alias("a"), F.struct("n", "signature").alias("x"))
        right = known.select(F.col("node").alias("b"), F.struct("n", "signature").alias("y"))
        near = pairs.join(left, "a").join(right, "b").where(_may_link("x", "y", share))
        like = _equal_slots(F.col("x.signature"), F.col("y.signature"), 0, SLOTS // PER_LONG)
        best = near.groupBy("a").agg(F.min(F.struct((-like).alias("d"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        links = materialize(_confirmed(best, sets, share), "links-found")
        labels = materialize(_contract(labels, links), "labels")

    links = _last_links(labelled(members), known, sets, share)
    labels = materialize(_contract(labels, links), "labels")

    own = nodes.select("set_key", "node").join(labels, "node", "left")
    own = own.select("set_key", F.coalesce("component", "node").alias("component_id"))
    linked = signed.where("n_shingles > 0 and doc_id is not null").join(own, "set_key")
    linked = linked.select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
