"""Pack documents into token sequences by bounded-space online best fit.

Each task packs its share of the pieces one after the other. It keeps a fixed
number of open bins. A bit set has bit f set when some open bin has f tokens
free, so the best bin for a piece is the lowest set bit at or above its length.
When too many bins are open, the fullest is closed: the lowest set bit.

Pieces arrive in order of length, longest first, so that the small ones fill
what the large ones leave; a task's share is bounded, so its bins stay open in
practice and the fill is that of best fit decreasing. Shares are dealt by a
hash of a piece's place in the input, so no key can make one of them large.

Defined results: a null or empty text is a document of the end token only.
Every row is a document of its own, also when an id repeats or is null; ties
are packed in order of id and piece. An empty table gives no rows; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.arrow import map_columns
from gleanspark.runtime import materialize

CAPACITY = 2048
OPEN_BINS = 16_384
# Pieces that one task packs. A task leaves about one bin badly filled, so the loss is one in thousands.
PIECES_PER_TASK = 20_000
END_ID = 0
# Distinct words in each of the two stores of a worker; the old one is dropped when the young one is full.
KEPT_WORDS = 600_000
KEPT_LENGTH = 64
#: Mark of a piece that ends a word.
WORD_END = "</w>"
# Latin letters that stay one letter when they are normalised and put in lower case.
APART = re.compile(
    "(?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F])([!-/:-@\\[-`{-~]+)(?=[ \\n]|\\Z)"
).sub


class WordIds:
    """Little-endian ids of the words of texts.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words one after the other, and a word seen before is
    looked up. Punctuation between a letter and a blank is a pre-token of its own
    for the tokenizer, so it may stand apart as well, which leaves far fewer
    different words.

    New words of letters only are encoded many at a time: each is one
    pre-token, and its last id is that of a piece that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a letter to Python only
            return self._encode(words)
        data, starts = ids.tobytes(), [0, *(4 * stops[:-1]).tolist()]
        return [data[a:b] for a, b in zip(starts, (4 * stops).tolist())]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not in the young store; they are put there, but for the very long ones."""
        found = {w: self.old[w] for w in words if w in self.old}
        rest = [w for w in words if w not in found]
        letters = [w for w in rest if w.isalpha()]
        others = [w for w in rest if not w.isalpha()]
        for group, encode in ((letters, self._encode_letters), (others, self._encode)):
            for at in range(0, len(group), 5_000):
                part = group[at : at + 5_000]
                found.update(zip(part, encode(part)))
        if len(self.young) + len(found) > KEPT_WORDS:
            self.old, self.young = self.young, {}  # the caller still holds the old one
        self.young.update((w, b) for w, b in found.items() if len(w) <= KEPT_LENGTH)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [APART(r" \1", x or "").replace("\n", " ").split(" ") for x in texts]
        words = set().union(*split) if split else set()
        fresh = {w for w in words if w not in self.young}
        before = self.young
        found = self._learn(fresh) if fresh else {}
        lookup = self.young
        if lookup is not before or len(found) > 0 and max(map(len, found)) > KEPT_LENGTH:
            # The stores have changed places, or some words are too long to keep.
            lookup = {w: before[w] for w in words - fresh} | found
        return [b"".join(map(lookup.__getitem__, x)) for x in split]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One store for all tasks that a Python worker runs."""
    return WordIds(path)


def pieces(
    documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_column="doc_id", text_column="text", with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and ``deal``, a number that spreads the pieces.

    ``with_ids`` adds the ids themselves (little-endian 32-bit), for writing sequences.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, deal long"
    end = end_id.to_bytes(4, "little")

    def make():
        coder, context, seen = word_ids(path), TaskContext.get(), 0
        first = context.partitionId() << 40 if context else 0

        def step(keys, texts):
            nonlocal seen
            rows: list[tuple] = []
            for key, ids in zip(keys.to_pylist(), coder.encode(texts.to_pylist())):
                ids += end
                for k in range(0, len(ids) // 4, capacity):
                    part = ids[4 * k : 4 * (k + capacity)]
                    rows.append((key, k // capacity, k, len(part) // 4, zlib.crc32(part), first + seen, part))
                    seen += 1
            columns = [list(c) for c in zip(*rows)]
            return columns if with_ids else columns[:-1]

        return step

    return map_columns(documents, [id_column, text_column], schema + ", ids binary" * with_ids, make)


class Bins:
    """Open bins by free space: a bit set of the free spaces that occur, and the bins of each."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits, self.bins, self.count, self.made = 0, [deque() for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        number = self.bins[free].popleft()
        self.count -= 1
        if not self.bins[free]:
            self.free_bits ^= 1 << free
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the fullest bin that has room, else a new one."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.free_bits |= 1 << left
            self.count += 1
            if self.count > self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        return number, self.capacity - free


def place(
    cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset`` in place of ``deal``."""
    tasks = max(1, -(-cut.count() // pieces_per_task))
    names = [c for c in cut.columns if c != "deal"]
    schema = cut.drop("deal").schema.add("sequence_id", "long", False).add("offset", "long", False)
    order = [F.desc("length"), *[c for c in names if c not in ("length", "ids")], "deal"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        bins = Bins(capacity, open_bins)
        for batch in batches:
            numbers, offsets = [], []
            for length in batch.column("length").to_pylist():
                number, offset = bins.put(length)
                numbers.append(first + number)
                offsets.append(offset)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    return cut.repartition(tasks, "deal").sortWithinPartitions(*order).mapInArrow(fill, schema)


def pack(
    documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS,
    id_column="doc_id", text_column="text", with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cut = pieces(documents, path, capacity, end_id, id_column, text_column, with_ids)
    return place(materialize(cut, "pieces"), capacity, open_bins)
