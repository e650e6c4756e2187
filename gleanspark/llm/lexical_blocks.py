"""Ranked lexical search with per-term geometric blocks and exact bounds.

A document becomes a sparse vector: for each term its impact, a whole number that
grows with the term's count and falls with the document's length. An item's score
of a document is the sum of its terms' weights times impacts.

A task reads documents as a stream and indexes ``CHUNK`` of them at a time. The
posting list of a term is clustered by the similarity of its documents: sketches
of their vectors (random projections) meet some of the list's own documents as
centres, so that a block of about ``BLOCK`` documents is alike. A block's summary
is the coordinatewise maximum of its vectors. Weights times summary is the most
that any document of the block can score; this and the k-th score so far decide
what is read:

* A list's own maximum bounds what its term can add. Terms whose maxima together
  stay below the k-th score need no reading of their lists: a document that holds
  no other terms of the item cannot be among the k best.
* Of the other lists, a block is skipped if its summary's bound is below the k-th
  score. Equal bounds are read, since a smaller id wins a tie.

Everything that is read gets its exact score. The k-th score is carried on over
the chunks of a task, so its first chunk is read most. A task hands on k rows an
item, and those of all tasks are ranked at the end.

Documents are tokenized once, into vectors over the items' terms, which are written
to the shared folder; counts over the corpus come from there. Items go to the
tasks in groups of ``GROUP_TERMS`` terms at most, one pass over the vectors each.

Defined results: a null text has no terms. A document without an id counts in
the statistics and is not ranked; rows that share an id are ranked each. Items
with a null id or without terms give no rows; identical items are one, different
texts of one item id are ranked each by itself. Documents without a common term
have score 0 and are not listed. Empty tables give no rows; other columns do not
matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.arrow import map_columns, slices
from gleanspark.runtime import broadcast_if_small, materialize

CHUNK = 4_096
BLOCK = 48
SKETCH = 24
GROUP_TERMS = 100_000

# Runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z in lower case.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _counted(rows: DataFrame, schema: str, columns: list[str], wanted: frozenset | None = None) -> DataFrame:
    """``columns`` (the last is the text) with n, terms and counts; only terms ``wanted``, if given."""

    def make():
        def step(*given):
            sizes, names, counts, ends = [], [], [], [0]
            for text in given[-1].to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                held = Counter(words)
                for term in held if wanted is None else held.keys() & wanted:
                    names.append(term.decode())
                    counts.append(held[term])
                ends.append(len(names))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((names, pa.string()), (counts, pa.int64()))]
            return [*given[:-1], sizes, *lists]

        return step

    return map_columns(rows, columns, schema, make)


def impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What one occurrence of a term in an item is worth, before the term's weight."""
    m = 25 + 75 * sizes * documents // total
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class Items:
    """The items of a group: term numbers and weights, in one run per item."""

    def __init__(self, keys: list, terms: list[list[str]], weights: list[list[int]]):
        self.keys = keys
        names = sorted({t for x in terms for t in x})
        self.number = {t: i for i, t in enumerate(names)}
        self.terms = [np.array([self.number[t] for t in x], np.int64) for x in terms]
        self.weights = [np.array(x, np.int64) for x in weights]


class Lists:
    """The posting lists of a chunk of documents and the blocks of the lists that were asked for."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, sketches: np.ndarray):
        self.starts, self.terms, self.values, self.width = starts, terms, values, width
        of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.docs = of[order]
        self.edges = np.searchsorted(terms[order], np.arange(width + 1))
        self.most = np.zeros(width, np.int64)
        np.maximum.at(self.most, terms, values)
        drawn = np.zeros((len(starts) - 1, sketches.shape[1]))
        np.add.at(drawn, of, values[:, None] * sketches[terms])
        self.sketch = drawn / np.maximum(np.sqrt((drawn**2).sum(axis=1)), 1e-9)[:, None]
        self.made: dict[int, tuple] = {}

    def postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``docs``, place) of all their entries."""
        counts = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(counts)
        return np.repeat(np.arange(len(docs)), counts), np.arange(ends[-1]) + np.repeat(self.starts[docs] - ends + counts, counts)

    def blocks(self, term: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Documents of each block; the summaries as sorted (block, term) keys with the largest impacts."""
        if term not in self.made:
            docs = self.docs[self.edges[term] : self.edges[term + 1]]
            number = max(1, len(docs) // BLOCK)
            centres = docs[np.arange(number) * len(docs) // number]
            nearest = np.argmax(self.sketch[docs] @ self.sketch[centres].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            new = np.flatnonzero(np.concatenate([[True], nearest[1:] != nearest[:-1]]))
            block = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(docs))))
            at, place = self.postings(docs)
            keys = block[at] * self.width + self.terms[place]
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], self.values[place][order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.made[term] = np.split(docs, new[1:]), keys[first], np.maximum.reduceat(values, first)
        return self.made[term]

    def search(self, terms: np.ndarray, weights: np.ndarray, bar: int, read: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that may score ``bar`` or more, for an item's terms."""
        alive = self.most[terms] > 0
        terms, weights = terms[alive], weights[alive]
        add = weights * self.most[terms]
        order = np.argsort(add, kind="stable")
        needed = order[np.cumsum(add[order]) >= max(bar, 1)]
        read["lists"] += len(order)
        read["lists skipped"] += len(order) - len(needed)
        picked = []
        for at in needed:
            members, keys, tops = self.blocks(int(terms[at]))
            asked = (np.arange(len(members)) * self.width)[:, None] + terms[None, :]
            found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            bounds = (np.where(keys[found] == asked, tops[found], 0) * weights).sum(axis=1)
            good = np.flatnonzero(bounds >= bar)
            read["blocks"] += len(members)
            read["blocks skipped"] += len(members) - len(good)
            picked += [members[b] for b in good]
        if not picked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs = np.unique(np.concatenate(picked))
        read["documents"] += len(docs)
        weight = np.zeros(self.width, np.int64)
        weight[terms] = weights
        at, place = self.postings(docs)
        products = weight[self.terms[place]] * self.values[place]
        scores = np.add.reduceat(products, np.searchsorted(at, np.arange(len(docs))))
        keep = scores >= max(bar, 1)
        return docs[keep], scores[keep]


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.ids = k, [np.zeros(0, np.int64)] * items
        self.scores = list(self.ids)
        self.bars = [0] * items

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[item], ids]), np.concatenate([self.scores[item], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[item], self.scores[item] = ids[order], scores[order]
        if len(order) == self.k:
            self.bars[item] = int(scores[order[-1]])


def search_chunk(items: Items, best: Best, ids, starts, terms, values, read: Counter) -> None:
    width = len(items.number)
    sketches = np.random.default_rng(7).normal(size=(width, SKETCH))
    lists = Lists(starts, terms, values, width, sketches)
    for item in range(len(items.keys)):
        docs, scores = lists.search(items.terms[item], items.weights[item], best.bars[item], read)
        if len(docs):
            best.add(item, ids[docs], scores)


def _ranked(vectors: DataFrame, items: Items, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of each item of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, read, held, size = Best(len(items.keys), k), Counter(), [], 0

        def settle() -> None:
            ids, lengths, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
            terms, times = (np.concatenate([x[i] for x in held]) for i in (3, 4))
            of = np.repeat(np.arange(len(ids)), counts)
            known = terms >= 0
            of, terms, times = of[known], terms[known], times[known]
            starts = np.searchsorted(of, np.arange(len(ids) + 1))
            search_chunk(items, best, ids, starts, terms, impacts(times, lengths[of], documents, total), read)

        for batch in batches:
            for part in slices(batch):
                lists = part.column("terms")
                names = lists.flatten().dictionary_encode()
                number = np.array([items.number.get(x, -1) for x in names.dictionary.to_pylist()], np.int64)
                terms = number[names.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
                counts = part.column("counts").flatten().to_numpy()
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                held.append([part.column("doc_id").to_numpy(), part.column("n").to_numpy(), sizes, terms, counts])
                size += part.num_rows
                if size >= CHUNK:
                    settle()
                    held, size = [], 0
        if size:
            settle()
        rows = [(items.keys[i], d, s) for i in range(len(items.keys)) for d, s in zip(best.ids[i].tolist(), best.scores[i].tolist())]
        if rows:
            arrays = [pa.array(x, pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def search(
    documents: DataFrame, items: DataFrame, k: int = 10, id_column="doc_id", text_column="text",
    item_column="item_id", item_text_column="text",
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents; equal scores by id."""
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).alias("text"))
    asked = asked.where("item_id is not null and text is not null").distinct()
    asked = _counted(asked, "item_id long, n long, terms array<string>, counts array<long>", ["item_id", "text"])
    asked = asked.where("n > 0").withColumn("item", F.xxhash64("item_id", "terms", "counts")).dropDuplicates(["item"])
    asked = materialize(asked, "items")
    pairs = asked.select("item", F.posexplode("terms").alias("at", "term"), "counts")
    pairs = pairs.select("item", "term", F.get("counts", F.col("at")).alias("times"))
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    groups = max(1, -(-pairs.count() // GROUP_TERMS))
    wanted = None
    if groups == 1:
        wanted = frozenset(r.term.encode() for r in pairs.select("term").distinct().collect())  # GROUP_TERMS at most
    schema = "doc_id long, n long, terms array<string>, counts array<long>"
    vectors = materialize(_counted(rows, schema, ["doc_id", "text"], wanted), "vectors")
    corpus = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
    if not corpus.documents:
        return vectors.select(F.col("doc_id").alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.col("n").alias("score")).limit(0)
    held = vectors.select(F.explode("terms").alias("term"))
    terms = pairs.select("term").distinct()
    held = held.join(broadcast_if_small(materialize(terms, "item-terms")), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(corpus.documents) + 2) / (2 * F.col("df") + 1)))
    weighted = pairs.join(broadcast_if_small(materialize(held, "frequencies")), "term")
    weighted = weighted.select("item", "term", (weight * F.col("times")).alias("weight"))
    weighted = weighted.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)))
    weighted = materialize(weighted, "weights")
    ranked = vectors.where("doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "counts")
    found = None
    for part in range(groups):
        lines = weighted.where(F.col("part") == part).groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("x")).collect()
        lines.sort(key=lambda r: r.item)
        group = Items([r.item for r in lines], [[y.term for y in r.x] for r in lines], [[y.weight for y in r.x] for r in lines])
        top = materialize(_ranked(ranked, group, corpus.documents, corpus.total, k), "best-of-tasks") if lines else None
        found = top if found is None else found.unionByName(top) if top is not None else found
    if found is None:
        found = vectors.select(F.col("n").alias("item"), "doc_id", F.col("n").alias("score")).limit(0)
    found = found.join(F.broadcast(asked.select("item", "item_id")) if groups == 1 else asked.select("item", "item_id"), "item")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    )
