"""Exact repeated byte strings by a logarithmic family of sparse suffix arrays.

Every byte covered by a ``SPAN``-byte string that also starts earlier (in a
smaller id, or before in the same document) is removed.

A full suffix array of a corpus takes many times its size in shuffles, so the
arrays are sparse: they hold the suffixes that begin at *anchors*. The anchor
of a ``SPAN``-byte string is the start of its smallest ``GRAM``-byte hash, the
leftmost on ties; equal strings have equal anchors at equal places. The starts
that share an anchor form a block, and the block's bytes from the first start
to the end of the last string are known by a second hash. Equal (anchor, block)
hashes mean that all strings of both blocks are equal.

Inside a task each batch of documents gets its sorted array. It is merge-scanned
against the levels before it, which settles the suffixes that are there already;
what is new becomes a level, and levels of like size merge, so that there are
logarithmically many. A task hands on only the first of each, so a passage in a
third of all documents leaves one record per task. Across tasks the records
meet by anchor, in order: later ones of equal blocks are settled as well.

Anchors whose blocks differ hold strings that are partly equal: the edges of
matches. The first block of each kind comes back with its ``SPAN``-byte strings
one by one, and these meet in the same way. So every string is compared with all
others, and nothing is capped.

Hashes have 64 bits each; the anchor and the block hash together have 128.

Defined results: a null text counts as empty. Texts under ``SPAN`` bytes have no
such string. A document is an id with a text: identical rows are one document,
each answered alike; different texts of one id are documents of their own, in
order of a 63-bit digest of the text. Rows with a null id come behind all others,
each text a document. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.arrow import slices
from gleanspark.runtime import broadcast_if_small, materialize

SPAN = 100
GRAM = 40
#: Records a task holds before it hands its levels on.
HELD_RECORDS = 2_000_000
# Rows with an array each.
BROADCAST_DOCS = 300_000
NO_ID = 2**63 - 1
RECORD = "k long, b long, doc long, dig long, pack long, settled boolean"

RECORD_NAMES = ["k", "b", "doc", "dig", "pack", "settled"]

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_VALUES = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 2**64))


def gram_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` values from every place on, put together from hashes of powers of two."""
    done, done_size, part, size, left = None, 0, values, 1, length
    while left:
        if left & 1:
            if done is None:
                done, done_size = part, size
            else:
                n = max(0, min(len(done), len(part) - done_size))
                done = done[:n] * _power(size) + part[done_size : done_size + n]
                done_size += size
        left >>= 1
        if left:
            n = max(0, len(part) - size)
            part = part[:n] * _power(size) + part[size : size + n]
            size *= 2
    return _mix(done)


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of the ``width`` values from every place on; the leftmost of equal ones."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        a, b = values[:-step] if step else values, values[step:]
        at = np.where(a <= b, at[:-step], at[step:])
        values = np.minimum(a, b)
        size += step
    return at


class Bytes:
    """Documents laid end to end, with hashes of any stretch."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        self.values = _VALUES[self.data]
        powers = np.full(n + 1, np.uint64(_BASE))
        powers[0] = 1
        inverse = np.full(n + 1, np.uint64(_INVERSE))
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values * np.cumprod(powers, dtype=np.uint64)[:-1], dtype=np.uint64, out=sums[1:])
        self.sums = sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def blocks(self, span: int, gram: int):
        """(document, first start, last start, anchor, anchor hash, block hash); places within the document."""
        empty = np.zeros(0, np.int64)
        if len(self.data) < span:
            return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        grams = gram_hashes(self.values, gram)
        anchor = window_argmin(grams, span - gram + 1)
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)[: len(anchor)]
        start = np.flatnonzero(np.arange(len(anchor)) + span <= self.ends[document])
        if not len(start):
            return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        anchor, document = anchor[start].astype(np.int64), document[start]
        fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])])
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        lo, hi, at, document = start[first], start[last], anchor[first], document[first]
        shape = ((at - lo) * 256 + (at - hi)).astype(np.uint64)
        block = _mix(self.hashes(lo, hi + span) + shape * np.uint64(0x165667B19E3779F9))
        base = self.starts[document]
        return document, lo - base, hi - base, at - base, grams[at], block


def pack(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """First and last start in one number, in the order of the first."""
    return lo << 8 | (hi - lo)


def _later(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Where ``a`` comes behind ``b``, column by column."""
    behind, equal = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
    for x, y in zip(a, b):
        behind |= equal & (x > y)
        equal &= x == y
    return behind


class Levels:
    """Sorted arrays of records, each at least twice as long as the next; a record is
    (key, k, b, doc, places …), and of records with one key the levels hold the earliest."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.columns = 4

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def add(self, k, b, doc, *places) -> list[np.ndarray]:
        """Index a batch; gives (k, b, doc, places …) of the records that are later than another one.
        Records come in order of the document and then of ``places``, column by column."""
        self.columns = 3 + len(places)
        key = _mix(k.view(np.uint64) * np.uint64(_BASE) + b.view(np.uint64))
        order = np.lexsort((*places[::-1], doc, key))
        batch = [x[order] for x in (key, k, b, doc, *places)]
        settled = []
        if len(key):
            head = np.concatenate([[True], batch[0][1:] != batch[0][:-1]])
            of = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            later = _later(batch[3:], [x[of] for x in batch[3:]])
            settled.append([x[later] for x in batch[1:]])
            batch = [x[head] for x in batch]
        for level in self.levels:
            if not len(batch[0]):
                break
            at = np.minimum(np.searchsorted(level[0], batch[0]), len(level[0]) - 1)
            met = level[0][at] == batch[0]
            old, new = at[met], [x[met] for x in batch]
            held = [x[old] for x in level[3:]]
            newer, older = _later(new[3:], held), _later(held, new[3:])
            settled.append([x[newer] for x in new[1:]])
            settled.append([x[old[older]] for x in level[1:]])
            for column, x in zip(level, new):
                column[old[older]] = x[older]
            batch = [x[~met] for x in batch]
        if len(batch[0]):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            small, large = self.levels.pop(), self.levels.pop()
            at = np.searchsorted(large[0], small[0])
            self.levels.append([np.insert(x, at, y) for x, y in zip(large, small)])
        return [np.concatenate(x) for x in zip(*settled)] if settled else [np.zeros(0, np.int64)] * self.columns

    def drain(self) -> list[np.ndarray]:
        """(k, b, doc, places …) of all records; the levels are empty then."""
        found = [np.concatenate(x) for x in zip(*self.levels)][1:] if self.levels else [np.zeros(0, np.int64)] * self.columns
        self.levels = []
        return found


def _records(columns: list[np.ndarray], settled: bool) -> Iterator[pa.RecordBatch]:
    k, b, doc, dig, place = columns if len(columns) == 5 else [np.zeros(0, np.int64)] * 5
    if settled and len(k):
        # Nothing is asked of them any more: they are spread by their place.
        k = _mix((doc ^ dig).view(np.uint64) * np.uint64(_BASE) + place.view(np.uint64)).view(np.int64)
    for at in range(0, len(k), 100_000):
        part = [x[at : at + 100_000] for x in (k, b, doc, dig, place)]
        flags = np.full(len(part[0]), settled)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*part, flags)], names=RECORD_NAMES)


def _named(documents: DataFrame) -> DataFrame:
    """``documents`` with ``doc`` and ``dig``, which name a document: id and digest of the text, null ids last."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    # Negative with an id and not without, so that the largest id is none.
    digest = F.when(F.col("doc_id").isNull(), digest.bitwiseAND(F.lit(2**63 - 1))).otherwise(digest.bitwiseOR(F.lit(-(2**63))))
    return documents.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "dig": digest})


def _bytes(column) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def _indexed(rows: DataFrame, make_records) -> DataFrame:
    """Records of ``make_records(batch)``, with all but the first of each settled as far as the task can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()
        for batch in batches:
            for part in slices(batch, 2_000_000):
                yield from _records(levels.add(*make_records(part)), True)
                if len(levels) > HELD_RECORDS:
                    yield from _records(levels.drain(), False)
        yield from _records(levels.drain(), False)

    return rows.mapInArrow(run, RECORD)


class _Reader:
    """Settles records that come in order of (k, b, doc, dig, pack); ``ask`` also gives the first
    record of each b where a k has several. What is carried on to the next batch is one record."""

    def __init__(self, ask: bool):
        self.ask = ask
        self.carried = None  # k, b, doc, dig, pack of the last head
        self.waiting = False  # it is the only head of its k so far

    def read(self, k, b, doc, dig, place):
        """(doc, dig, pack) settled, and (doc, dig, pack) asked for."""
        if self.carried is not None:
            k, b, doc, dig, place = (np.concatenate([[c], x]) for c, x in zip(self.carried, (k, b, doc, dig, place)))
        new_k = np.concatenate([[True], k[1:] != k[:-1]])
        head = new_k | np.concatenate([[True], b[1:] != b[:-1]])
        of = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
        later = (doc != doc[of]) | (dig != dig[of]) | (place != place[of])
        heads = np.flatnonzero(head)
        run = np.cumsum(new_k)[heads] - 1
        counts = np.bincount(run)
        several = counts[run] > 1
        if self.carried is not None and not self.waiting:
            several[run == 0] = True  # its k had several before
        known = self.carried is not None and not self.waiting
        asked = heads[several][1 if known else 0 :] if self.ask else heads[:0]
        self.waiting = not several[-1]
        self.carried = [int(x[heads[-1]]) for x in (k, b, doc, dig, place)]
        return tuple(x[later] for x in (doc, dig, place)), tuple(x[asked] for x in (doc, dig, place))


def _met(records: DataFrame, ask: bool) -> DataFrame:
    """(asked boolean, doc, dig, pack): settled records, and the ones asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(ask)
        for batch in batches:
            flags = batch.column("settled").to_numpy(zero_copy_only=False)
            k, b, doc, dig, place = (batch.column(c).to_numpy() for c in RECORD_NAMES[:5])
            found = [(doc[flags], dig[flags], place[flags], False)]
            if not flags.all():
                later, asked = reader.read(*(x[~flags] for x in (k, b, doc, dig, place)))
                found += [(*later, False), (*asked, True)]
            for d, g, p, is_asked in found:
                if len(d):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(d), is_asked)), pa.array(d), pa.array(g), pa.array(p)],
                        names=["asked", "doc", "dig", "pack"],
                    )

    ordered = records.repartition("k").sortWithinPartitions("k", "b", "doc", "dig", "pack")
    return ordered.mapInArrow(run, "asked boolean, doc long, dig long, pack long")


def repeated(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc, dig, starts array<long>, ends array<long>): merged byte spans to remove, of documents that have some.

    ``documents``: doc_id long, text string.
    """
    documents = _named(documents).select("doc", "dig", "text")

    def names_of(batch):
        return (batch.column(c).to_numpy() for c in ("doc", "dig"))

    def block_records(batch):
        ids, digests = names_of(batch)
        document, lo, hi, _, grams, block = Bytes(_bytes(batch.column("text"))).blocks(span, gram)
        return grams.view(np.int64), block.view(np.int64), ids[document], digests[document], pack(lo, hi)

    first = materialize(_met(_indexed(documents, block_records), True), "blocks")
    asked = first.where("asked").groupBy("doc", "dig").agg(F.collect_set("pack").alias("packs"))
    asked = broadcast_if_small(materialize(asked, "asked-blocks"), BROADCAST_DOCS)
    again = documents.join(asked, ["doc", "dig"]).select("doc", "dig", "text", "packs")

    def string_records(batch):
        (ids, digests), texts = names_of(batch), _bytes(batch.column("text"))
        body = Bytes(texts)
        document, lo, n = [], [], []
        for i, packs in enumerate(batch.column("packs").to_pylist()):
            for x in packs:
                document.append(i)
                lo.append(x >> 8)
                n.append((x & 255) + 1)
        n = np.array(n, np.int64)
        document = np.repeat(np.array(document, np.int64), n)
        within = np.arange(len(document)) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.array(lo, np.int64), n) + within
        at = start + body.starts[document]
        return body.hashes(at, at + span).view(np.int64), np.zeros(len(at), np.int64), ids[document], digests[document], pack(start, start)

    second = _met(_indexed(again, string_records), False)
    spans = first.where("not asked").select("doc", "dig", "pack").unionByName(second.select("doc", "dig", "pack"))
    grouped = spans.groupBy("doc", "dig").agg(F.sort_array(F.collect_list("pack")).alias("packs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                starts, ends = [], []
                for packs in part.column("packs"):
                    x = packs.values.to_numpy()
                    lo, end = x >> 8, np.maximum.accumulate((x >> 8) + (x & 255) + span)
                    fresh = np.concatenate([[True], lo[1:] > end[:-1]])
                    starts.append(lo[fresh])
                    ends.append(end[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(x) - 1]])])
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("dig"), pa.array(starts, long_list), pa.array(ends, long_list)],
                    names=["doc", "dig", "starts", "ends"],
                )

    return grouped.mapInArrow(merge, "doc long, dig long, starts array<long>, ends array<long>")


def dedup(
    documents: DataFrame, span: int = SPAN, id_column="doc_id", text_column="text", with_bytes: bool = False,
) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans, kept_sha256, and the bytes that are left, if asked for."""
    documents = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    spans = broadcast_if_small(materialize(repeated(documents, span), "repeated-spans"), BROADCAST_DOCS)
    rows = _named(documents).join(spans, ["doc", "dig"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], []]
                columns = (part.column(c).to_pylist() for c in ("text", "starts", "ends"))
                for text, starts, ends in zip(*columns):
                    data, at, kept, n = (text or "").encode(), 0, [], 0
                    for start, end in zip(starts or (), ends or ()):
                        kept.append(data[at:start])
                        at, n = end, n + 1
                    kept.append(data[at:])
                    left = b"".join(kept)
                    row = (len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left)
                    for column, x in zip(out, row):
                        column.append(x)
                arrays = [pa.array(x) for x in out[: 4 + with_bytes]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    done = rows.select("doc_id", "text", "starts", "ends").mapInArrow(cut, schema)
    return done.withColumnRenamed("doc_id", id_column)
