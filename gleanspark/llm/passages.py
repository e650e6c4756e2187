"""Near-duplicate passages by compact windows.

Positions of a text are its words; from each one starts a *token* of ``TOKEN``
words. For a hash function, every stretch of ``length`` tokens or more has a
least hash, and all stretches with their least hash at position c are those
inside one window [l, r] around c that hold c: the node c of the Cartesian tree
of the hashes, with its subtree's span. Only nodes that span ``length`` tokens
matter, a few in a hundred words, so a few records stand for all the stretches
of a text. Of nodes with one token inside each other the outermost is kept.

Stretches of two texts with a common least hash have windows with one key, and
the anchors c say how the texts lie on each other. Two passages of 50 words with
one word changed share 37 of 51 tokens; all ``HASHES`` functions miss them with
probability (14/51) ** 7, about 1e-4. Longer passages of a similarity of 80 percent
share more. Tokens are longer than the shingles that decide, so that a common
line or phrase is no key for all the texts that have it.

Windows of a pair of texts with like offsets make an island, which is verified on
five-word shingles along the offset: a stretch whose first and last shingle are
matched, with n of them here, m there and h matched, is a repeat if 100 h >=
share (n + m - h). All words of such stretches are reported (``aligned``).

A task first pairs each record with the first of its key and the one before it
among its own texts, and verifies these at once. Records whose anchor lies in
a passage are settled: they stay sources for others, but do not travel by
their key, so a passage in a third of all texts leaves a few records per task. Across
tasks the others are paired by key in the same way. A window is open until its
anchor lies in a passage; what a passage leaves over of it is found through the
anchors there.

Open windows meet all records of their key, settled ones too. Most have nothing in
common but a phrase that is too short, the same one with the first document of
their key; two of them that share a passage share more than that. So each is compared
with this first document, and meets the others by the words where the common
stretch ends: half of the ``EDGE`` words lie on the other side, or begin a few words behind, on
either side, and again where the stretch goes on behind a changed word. What
shares such an edge meets in a grid of blocks of ``BLOCK``.

Equal texts are one from the start; copies are repeats as a whole.

The later text's passage is reported; the first one's is not. The documents named
with passages are those they were first found in, which need not be all that
hold them.

Defined results: null and short texts have no passages. Rows that share an id
are one document and never repeat each other; rows with a null id take no part.
Passages repeated inside one document are no repeats across documents. An empty
table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.arrow import slices
from gleanspark.llm.suffix_levels import gram_hashes, window_argmin
from gleanspark.runtime import broadcast_if_small, materialize

TOKEN = 7
SHINGLE = 5
WORDS = 50
SHARE = 80
HASHES = 7
#: Words of the texts that a task holds at a time.
HELD_WORDS = 1_500_000
#: Offsets of one island differ from one window to the next by this many words at most.
BAND = 24
#: Words of an edge, where the stretch that a window shares with the first of its family ends.
EDGE = 8
#: Records of an edge in one block of the grid.
BLOCK = 512
#: Words of a document that make one family of the windows first found there.
REGION = 64
#: Ends of ranges to be read are multiples of this many words.
STEP = 32
# A side with an array per row is broadcast up to so many array elements, others up to so many rows.
BROADCAST_VALUES = 2_000_000
BROADCAST_ROWS = 1_000_000

_SEEDS = np.random.default_rng(23).integers(0, 2**64, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (x ^ seed) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def compact_windows(values: np.ndarray, length: int, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian tree's nodes that span ``length`` positions or more.

    Zeros in ``values`` stand between texts, and no window crosses them. The leftmost of equal
    hashes is the upper node. Spans are found by doubling steps over minima of powers of two.
    """
    empty = np.zeros(0, np.int64)
    if len(values) < length:
        return empty, empty, empty
    least = window_argmin(values, length)
    picked = np.zeros(len(values), bool)
    picked[least] = True
    c = np.flatnonzero(picked & (values > 0))
    if not len(c):
        return empty, empty, empty
    gaps = np.flatnonzero(values == 0)
    longest = int(np.diff(np.concatenate([[-1], gaps, [len(values)]])).max()) - 1
    longest = min(longest, reach or longest)
    tables = [values]
    while 2 ** len(tables) <= longest:
        step = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
    own, left, right = values[c], c.copy(), c + 1
    for k in range(len(tables) - 1, -1, -1):
        size, table = 2**k, tables[k]
        at = left - size
        go = (at >= 0) & (table[np.clip(at, 0, len(table) - 1)] > own)
        left = np.where(go, at, left)
        go = (right + size <= len(values)) & (table[np.clip(right, 0, len(table) - 1)] >= own)
        right = np.where(go, right + size, right)
    return c, left, right - 1


def _words(text: str) -> np.ndarray:
    """Hashes of the words; A-Z in lower case."""
    words = text.encode().lower().split()  # bytes split at ASCII white space only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles_of(text: str) -> np.ndarray:
    return (_grams(_words(text), SHINGLE) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    return gram_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)


class Texts:
    """Texts of several documents: their words in one run, the windows of all functions, and the five-word shingles."""

    def __init__(self, docs: list[int], words: list[np.ndarray]):
        self.docs = np.array(docs, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        flat = np.concatenate(words)
        self.tokens = _grams(flat, TOKEN)
        self.shingles = (_grams(flat, SHINGLE) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        between = (self.ends[:, None] - np.arange(1, TOKEN)[None, :]).reshape(-1)
        self.between = between[between < len(self.tokens)]

    def records(self, length: int) -> dict[str, np.ndarray]:
        """key, at (number of the text), c, lo, hi: the windows of all functions, places in words of their text."""
        found = []
        for f, seed in enumerate(_SEEDS):
            values = np.maximum((_mix(self.tokens, seed) >> np.uint64(32)).astype(np.uint32), np.uint32(1))
            values[self.between] = 0
            c, left, right = compact_windows(values, length, REACH)
            top = (left == 0) | (values[left - 1] != values[c])
            c, left, right = c[top], left[top], right[top]
            at = np.searchsorted(self.starts, c, side="right") - 1
            base = self.starts[at]
            found.append((_mix(self.tokens[c], np.uint64(f + 1)).view(np.int64), at, c - base, left - base, right - base))
        return dict(zip(("key", "at", "c", "lo", "hi"), map(np.concatenate, zip(*found))))

    def part(self, at: int, lo: int, hi: int) -> np.ndarray:
        """Shingles that start at the words lo … hi of a text, as far as it goes."""
        start = self.starts[at]
        return self.shingles[start + lo : min(start + hi, self.ends[at] - SHINGLE) + 1]


def aligned(mine: np.ndarray, theirs: np.ndarray, low: int, high: int, length: int, share: int) -> list[tuple[int, int]]:
    """(start, end) of what is repeated in ``mine``: all stretches of ``length`` shingles or more, from a matched one
    to a matched one, whose similarity with the stretch between the matches is ``share`` percent or more. A shingle
    matches the equal one of ``theirs`` that lies nearest to an offset between ``low`` and ``high``; end exclusive."""
    if len(mine) < length or not len(theirs):
        return []
    order = np.argsort(theirs, kind="stable")
    # Values in the high bits, places below: the matches nearest to the wanted place are neighbours of its own code.
    width = np.int64(1) << np.int64(max(len(mine), len(theirs), 1)).item().bit_length()
    codes = theirs[order].astype(np.int64) * width + order
    place = np.arange(len(mine))
    wanted = np.clip(place + (low + high) // 2, 0, len(theirs) - 1)
    asked = mine.astype(np.int64) * width + wanted
    after = np.searchsorted(codes, asked)
    best, distance = np.zeros(len(mine), np.int64), np.full(len(mine), 2 * width)
    for near in (np.maximum(after - 1, 0), np.minimum(after, len(codes) - 1)):
        gap = np.where(theirs[order[near]] == mine, np.abs(order[near] - wanted), 2 * width)
        best, distance = np.where(gap < distance, order[near], best), np.minimum(gap, distance)
    offset = best - place
    hit = np.flatnonzero((distance < 2 * width) & (offset >= low - BAND) & (offset <= high + BAND))
    if not len(hit):
        return []
    other, count = best[hit], np.arange(len(hit))
    ends = (100 + share) * (count + 1) - share * (hit + other + 2)
    lows = np.minimum.accumulate((100 + share) * count - share * (hit + other))
    # For each end the first start that is close enough; what lies between is repeated.
    first = np.searchsorted(-lows, -ends, side="left")
    good = (first <= count) & (hit - hit[np.minimum(first, count)] + 1 >= length)
    starts, stops = hit[first[good]], hit[good] + 1
    order = np.argsort(starts, kind="stable")
    found: list[tuple[int, int]] = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist()):
        if found and a <= found[-1][1]:
            found[-1] = found[-1][0], max(b, found[-1][1])
        else:
            found.append((a, b))
    return found


class Spans:
    """Passages found in numbered texts, merged."""

    def __init__(self):
        self.held: dict[int, list[tuple[int, int]]] = {}

    def add(self, at: int, start: int, end: int) -> None:
        spans = self.held.setdefault(at, [])
        out = [s for s in spans if s[1] < start or s[0] > end]
        for s in spans:
            if not (s[1] < start or s[0] > end):
                start, end = min(start, s[0]), max(end, s[1])
        self.held[at] = [*out, (start, end)]

    def holds(self, at: int, start: int, end: int) -> bool:
        return any(s <= start and end <= e for s, e in self.held.get(at, ()))

    def inside(self, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each [start, end) lies in a passage of its text; ``at`` in order."""
        held = np.zeros(len(at), bool)
        for k, spans in self.held.items():
            a, b = np.searchsorted(at, k, side="left"), np.searchsorted(at, k, side="right")
            for s, e in spans:
                held[a:b] |= (start[a:b] >= s) & (end[a:b] <= e)
        return held


def _partners(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records in order of key and document: the first of the key, and the last one of an earlier document (else itself)."""
    at = np.arange(len(key))
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(new_key, at, 0))
    new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
    run = np.maximum.accumulate(np.where(new_doc, at, 0))
    return first, np.where(run > first, run - 1, at)


def _pairs(doc: np.ndarray, first: np.ndarray, before: np.ndarray, fresh: np.ndarray | None = None):
    """(record, partner) for the ``fresh`` records whose partners belong to another document."""
    at = np.arange(len(doc)) if fresh is None else np.flatnonzero(fresh)
    one = at[doc[first[at]] != doc[at]]
    two = at[(doc[before[at]] != doc[at]) & (doc[before[at]] != doc[first[at]])]
    return np.concatenate([one, two]), np.concatenate([first[one], before[two]])


#: Words around an anchor that a record keeps of its window; longer passages have other anchors.
REACH = 1_000
# A record's place in one long: its anchor, and how far the window goes to the left and to the right of it.
_SIDE = 10


def _packed(rows: dict[str, np.ndarray]) -> np.ndarray:
    c, left, right = (rows[x].astype(np.int64) for x in ("c", "lo", "hi"))
    return (c << 2 * _SIDE) | (np.minimum(c - left, REACH) << _SIDE) | np.minimum(right - c, REACH)


def _unpacked(pack: Column) -> tuple[Column, Column, Column]:
    """Anchor, first and last word of a window."""
    c, side = F.shiftright(pack, 2 * _SIDE), (1 << _SIDE) - 1
    left, right = F.shiftright(pack, _SIDE).bitwiseAND(side), pack.bitwiseAND(side)
    return c.cast("int"), (c - left).cast("int"), (c + right).cast("int")


#: kind 0: a record that is still to meet others, 1: a settled one, 2: a passage (pack: its first word in the upper half
#: and the end of its words in the lower; pdoc: where it was found), 3: a pair of records.
RECORD = "kind int, key long, doc long, pack long, pdoc long, ppack long"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = [pa.int64() if x.endswith("long") else pa.int32() for x in RECORD.split(", ")]
OPEN, SETTLED, PASSAGE, PAIR = range(4)


def _batches(kind: int, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = len(columns["doc"])
    for at in range(0, total, 50_000):
        n = min(50_000, total - at)
        arrays = [pa.array(np.full(n, kind), pa.int32())]
        for name, kind_of in zip(_NAMES[1:], _TYPES[1:]):
            x = columns.get(name)
            arrays.append(pa.nulls(n, kind_of) if x is None else pa.array(np.asarray(x[at : at + n]), kind_of))
        yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _settled_inside(texts: Texts, length: int, share: int) -> Iterator[pa.RecordBatch]:
    """Passages within some texts, and their records, settled or not."""
    rows = texts.records(length)
    order = np.lexsort((rows["c"], texts.docs[rows["at"]], rows["key"]))
    rows = {k: x[order] for k, x in rows.items()}
    docs = texts.docs[rows["at"]]
    first, before = _partners(rows["key"], docs)
    a, b = _pairs(docs, first, before)
    spans, out = Spans(), []
    if len(a):
        offset = rows["c"][b] - rows["c"][a]
        order = np.lexsort((offset, rows["at"][b], rows["at"][a]))
        a, b, offset = a[order], b[order], offset[order]
        mine, theirs = rows["at"][a], rows["at"][b]
        new = np.flatnonzero((np.diff(mine) != 0) | (np.diff(theirs) != 0) | (np.diff(offset) > BAND)) + 1
        for s, e in zip(np.append(0, new).tolist(), np.append(new, len(a)).tolist()):
            x, y, at, other = a[s:e], b[s:e], int(mine[s]), int(theirs[s])
            lo, plo = int(rows["lo"][x].min()), int(rows["lo"][y].min())
            one = texts.part(at, lo, int(rows["hi"][x].max()) + TOKEN - SHINGLE)
            two = texts.part(other, plo, int(rows["hi"][y].max()) + TOKEN - SHINGLE)
            for p, q in aligned(one, two, int(offset[s]) + lo - plo, int(offset[e - 1]) + lo - plo, length + TOKEN - SHINGLE, share):
                spans.add(at, lo + p, lo + q + SHINGLE - 1)
                out.append((texts.docs[at], texts.docs[other], lo + p, lo + q + SHINGLE - 1))
    if out:
        doc, pdoc, lo, hi = (np.array(x, np.int64) for x in zip(*out))
        yield from _batches(PASSAGE, {"doc": doc, "pdoc": pdoc, "pack": (lo << 32) | hi})
    order = np.argsort(rows["at"], kind="stable")
    done = np.zeros(len(order), bool)
    done[order] = spans.inside(rows["at"][order], rows["c"][order], rows["c"][order] + TOKEN)
    done &= first != np.arange(len(first))  # the first of a key stays for the other tasks
    pack = _packed(rows)
    for kind, some in ((OPEN, ~done), (SETTLED, done)):
        yield from _batches(kind, {"doc": docs[some], "key": rows["key"][some], "pack": pack[some]})


def _records(heads: DataFrame, words: int, share: int) -> DataFrame:
    length = words - TOKEN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, size = [], [], 0
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(*(part.column(c).to_pylist() for c in ("doc", "text"))):
                    found = _words(text)
                    if len(found) < words:
                        continue
                    docs.append(doc)
                    held.append(found)
                    size += len(found)
                    if size >= HELD_WORDS:
                        yield from _settled_inside(Texts(docs, held), length, share)
                        docs, held, size = [], [], 0
        if size:
            yield from _settled_inside(Texts(docs, held), length, share)

    return heads.select("doc", "text").mapInArrow(run, RECORD)


def _met(records: DataFrame) -> DataFrame:
    """Open records in order of key and document, and their pairs; records whose key no other document has are left out.

    The records of the key's first document and the last record are carried on from batch to batch; all that is not an
    open record passes through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, alone = None, True  # alone: the carried key has had one document so far
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            rest = np.flatnonzero(kinds != OPEN)
            if len(rest):
                yield batch.take(pa.array(rest))
            batch = batch.take(pa.array(np.flatnonzero(kinds == OPEN)))
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in ("key", "doc", "pack")}
            held = 0
            if carried is not None:
                held = len(carried["key"])
                rows = {c: np.concatenate([carried[c], rows[c]]) for c in rows}
            fresh = np.arange(len(rows["key"])) >= held  # the carried records have been paired already
            first, before = _partners(rows["key"], rows["doc"])
            a, b = _pairs(rows["doc"], first, before, fresh)
            pairs = {k: rows[k][a] for k in ("doc", "pack")} | {f"p{k}": rows[k][b] for k in ("doc", "pack")}
            yield from _batches(PAIR, pairs)
            # A record of a document behind the first one, and that first one once it has company.
            later = rows["doc"] != rows["doc"][first]
            company = np.zeros(len(later), bool)
            np.logical_or.at(company, first, later)
            keep = fresh & (later | company[first])
            if held and company[0] and alone:
                keep[:held] |= ~later[:held] & (first[:held] == 0)
            yield from _batches(OPEN, {k: x[keep] for k, x in rows.items()})
            last = len(fresh) - 1
            # A first record of this batch has been written if its key has company by now.
            start = int(first[last])
            alone = not company[start] and (alone if start == 0 and held else True)
            at = np.union1d(np.flatnonzero((first == start) & ~later), [last])
            carried = {k: x[at] for k, x in rows.items()}

    by_key = F.xxhash64("key", F.when(F.col("kind") != OPEN, F.col("doc")))
    return records.repartition(by_key).sortWithinPartitions("key", "doc", "pack").mapInArrow(run, RECORD)


def islands(pairs: DataFrame) -> DataFrame:
    """(doc, pdoc, lo, hi, plo, phi, low, high): windows of a pair of documents whose offsets follow each other closely."""
    (c, lo, hi), (pc, plo, phi) = _unpacked(F.col("pack")), _unpacked(F.col("ppack"))
    rows = pairs.select("doc", "pdoc", lo.alias("lo"), hi.alias("hi"), plo.alias("plo"), phi.alias("phi"), (pc - c).alias("offset"))
    order = Window.partitionBy("doc", "pdoc").orderBy("offset")
    rows = rows.withColumn("fresh", F.when(F.col("offset") - F.lag("offset").over(order) <= BAND, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    down = lambda c: (F.floor(F.min(c) / STEP) * STEP).cast("int").alias(c)
    up = lambda c: (F.floor((F.max(c) + TOKEN - SHINGLE) / STEP) * STEP + STEP - 1).cast("int").alias(c)
    return rows.groupBy("doc", "pdoc", "island").agg(
        down("lo"), up("hi"), down("plo"), up("phi"), F.min("offset").alias("low"), F.max("offset").alias("high")
    ).drop("island")


def _range_shingles(heads: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, lo, hi, shingles): the shingles of each range asked for, ends inclusive; a text is read once."""
    asked = asked.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    asked = materialize(asked, "asked-ranges")
    values = asked.agg(F.sum(F.size("ranges"))).first()[0] or 0
    asked = F.broadcast(asked) if values <= BROADCAST_VALUES else asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for doc, text, ranges in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "ranges"))):
                    known = shingles_of(text)
                    for at in range(0, len(ranges), 1_000):
                        los, his = ([x[c] for x in ranges[at : at + 1_000]] for c in ("lo", "hi"))
                        out = [known[lo : hi + 1] for lo, hi in zip(los, his)]
                        offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))
                        arrays = [pa.array([doc] * len(los), pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32()), lists]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "lo", "hi", "shingles"])

    rows = heads.join(asked, "doc").select("doc", "text", "ranges")
    return materialize(rows.mapInArrow(run, "doc long, lo int, hi int, shingles array<int>"), "range-shingles")


FOUND = "doc long, pdoc long, start long, end long"


def _verified(heads: DataFrame, found: DataFrame, length: int, share: int) -> DataFrame:
    """The passages of islands."""
    asked = found.select("doc", "lo", "hi").unionByName(
        found.select(F.col("pdoc").alias("doc"), F.col("plo").alias("lo"), F.col("phi").alias("hi"))
    )
    shingles = _range_shingles(heads, asked)
    theirs = shingles.select(
        F.col("doc").alias("pdoc"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("shingles").alias("theirs")
    )
    both = found.join(shingles, ["doc", "lo", "hi"]).join(theirs, ["pdoc", "plo", "phi"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(c).to_pylist() for c in ("doc", "pdoc", "lo", "plo", "low", "high")]
                out = []
                for doc, pdoc, lo, plo, low, high, mine, other in zip(*columns, part.column("mine"), part.column("theirs")):
                    shift = lo - plo
                    for a, b in aligned(mine.values.to_numpy(), other.values.to_numpy(), low + shift, high + shift, length, share):
                        out.append((doc, pdoc, lo + a, lo + b + SHINGLE - 1))
                if out:
                    arrays = [pa.array(x, pa.int64()) for x in zip(*out)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc", "pdoc", "start", "end"])

    both = both.select("doc", "pdoc", "lo", "plo", "low", "high", F.col("shingles").alias("mine"), "theirs")
    return both.mapInArrow(check, FOUND)


def _grid_passages(table: pa.Table, length: int, share: int) -> list[tuple[int, int, int, int]]:
    """Passages of the open windows of one cell that windows of earlier documents of the other block have."""
    own, first, second = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    docs, los, is_open, shifts = (table.column(c).to_numpy() for c in ("doc", "lo", "open", "shift"))
    open_from, open_to = (table.column(c).fill_null(0).to_numpy() for c in ("open_from", "open_to"))
    texts = [x.values.to_numpy() for x in table.column("shingles")]
    cell = first[0] == second[0]
    mine = np.flatnonzero(is_open & (docs > docs.min()) & np.array([len(x) >= length for x in texts]))
    if not len(mine):
        return []
    codes = np.unique(np.concatenate(texts), return_inverse=True)[1]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(codes.max()) + 1, bool)
    # A repeated stretch has a part of one to two lengths with its share of hits; so at most so many of some ``length`` miss.
    misses = int((1 - 2 * share / (100 + share)) * (2 * length - 1))

    def dense(flat: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
        """Whether a text between ``ends`` has a stretch of ``length`` with so many marked shingles."""
        sums = np.append(0, np.cumsum(mark[flat], dtype=np.int32))
        good = np.append(0, np.cumsum(sums[length:] - sums[:-length] >= least, dtype=np.int32))
        return good[np.maximum(ends[1:] - length + 1, ends[:-1])] > good[ends[:-1]]

    # Only shingles that another text of the cell has can be repeated.
    of = np.repeat(np.unique(docs, return_inverse=True)[1], sizes)
    low, high = np.full(len(mark), len(docs)), np.full(len(mark), -1)
    np.minimum.at(low, codes, of)
    np.maximum.at(high, codes, of)
    mark[:] = low < high
    mine = mine[dense(np.concatenate([parts[k] for k in mine]), np.append(0, np.cumsum(sizes[mine])), length - misses)]
    mark[:] = False
    if not len(mine):
        return []
    flat = np.concatenate([parts[k] for k in mine])
    ends = np.append(0, np.cumsum(sizes[mine]))
    waiting = np.ones(len(mine), bool)
    out, seen, spans_of = [], set(), Spans()
    for other in np.argsort(docs, kind="stable"):
        able = waiting & (docs[mine] > docs[other]) & (cell | (own[mine] != own[other]))
        content = own[other], shifts[other] - los[other], parts[other].tobytes()
        if not able.any() or content in seen:
            continue
        seen.add(content)
        mark[parts[other]] = True
        hits = dense(flat, ends, length - misses)
        mark[parts[other]] = False
        for at in np.flatnonzero(able & hits):
            k = mine[at]
            offset = int((shifts[other] - los[other]) - (shifts[k] - los[k]))
            for a, b in aligned(texts[k], texts[other], offset - BAND, offset + BAND, length, share):
                a, b = los[k] + a, los[k] + b + SHINGLE - 1
                if not spans_of.holds(at, a, b):
                    spans_of.add(at, a, b)
                    out.append((docs[k], docs[other], a, b))
                if a <= open_from[k] and open_to[k] + TOKEN <= b:
                    waiting[at] = False
    return out


def _stretch_edges(mine: np.ndarray, theirs: np.ndarray, at: int, offset: int) -> list[tuple[int, int]]:
    """(side, place) of the edges of the stretch around ``at`` that is equal in both texts, ``offset`` apart."""
    found = []
    for side in (1, -1):
        # Seen from the anchor outwards; on the left both texts are turned round.
        a, b = (mine[at:], theirs[at + offset :]) if side > 0 else (mine[at::-1], theirs[at + offset :: -1] if at + offset >= 0 else theirs[:0])
        start = 0
        for turn in range(2):
            n = min(len(a) - start, len(b) - start)
            differ = np.flatnonzero(a[start : start + n] != b[start : start + n]) if n > 0 else np.zeros(0, np.int64)
            end = start + (int(differ[0]) if len(differ) else max(n, 0))
            # The edge itself, and the words behind the first one that differs.
            found += [(side, at + side * end), (2 * side, at + side * (end + EDGE))]
            if turn or not len(differ):
                break
            # Where the stretch goes on: the next EDGE shingles that are equal.
            equal = np.convolve(a[end : start + n] == b[end : start + n], np.ones(EDGE), "valid") if start + n - end >= EDGE else np.zeros(0)
            again = np.flatnonzero(equal == EDGE)
            if not len(again):
                break
            start = end + int(again[0])
    return found


def _edges(rows: DataFrame) -> DataFrame:
    """(edge, doc, place, lo, hi, open, open_from, open_to): the edges of the windows of each family."""
    names = ["family", "region", "doc", "c", "shift", "lo", "hi", "open", "open_from", "open_to", "flo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                columns = [part.column(x).to_pylist() for x in names]
                for *row, mine, other in zip(*columns, part.column("shingles"), part.column("theirs")):
                    family, region, doc, c, shift, lo, hi, is_open, open_from, open_to, flo = row
                    mine, other = mine.values.to_numpy(), other.values.to_numpy()
                    if not 0 <= c - lo < len(mine):
                        continue
                    for side, place in _stretch_edges(mine, other, c - lo, lo - shift - flo):
                        low = place if side > 0 else place - EDGE + SHINGLE
                        if 0 <= low <= len(mine) - (EDGE - SHINGLE + 1):
                            words = mine[low : low + EDGE - SHINGLE + 1].tobytes()
                            edge = xxhash.xxh3_64_intdigest(f"{family} {region} {side} ".encode() + words)
                            out.append((edge - 2**63, doc, lo + low, lo, hi, is_open, open_from, open_to))
                if out:
                    types = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.bool_(), pa.int32(), pa.int32()]
                    arrays = [pa.array(x, t) for x, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["edge", "doc", "place", "lo", "hi", "open", "open_from", "open_to"])

    schema = "edge long, doc long, place int, lo int, hi int, open boolean, open_from int, open_to int"
    return rows.select(*names, "shingles", "theirs").mapInArrow(run, schema)


def _open_passages(heads: DataFrame, met: DataFrame, found: DataFrame, length: int, share: int) -> DataFrame:
    """The passages of windows whose anchors are in none ``found``: they meet all records of their key.

    The keys of one common passage have mostly the same first document, and places in it that lie close together:
    windows meet by this document and ``REGION`` words of it, so that documents meet once and not for each key.
    """
    done = materialize(spans(found).select("doc", "starts", "ends"), "settled-spans")
    values = done.agg(F.sum(2 * F.size("starts"))).first()[0] or 0
    done = F.broadcast(done) if values <= BROADCAST_VALUES else done
    c, lo, hi = _unpacked(F.col("pack"))
    records = met.where(F.col("kind") <= SETTLED).select("key", "doc", "kind", c.alias("c"), lo.alias("lo"), hi.alias("hi"))
    inside = F.exists(F.arrays_zip("starts", "ends"), lambda x: (x["starts"] <= F.col("c")) & (x["ends"] >= F.col("c") + TOKEN))
    open_ = (F.col("kind") == OPEN) & ~F.coalesce(inside, F.lit(False))
    records = records.join(done, "doc", "left").select("key", "doc", "c", "lo", "hi", open_.alias("open"))
    records = materialize(records, "windows-met")
    # Two documents of a key have been compared.
    keys = records.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "c")).alias("first"), F.max(F.when(F.col("open"), F.col("doc"))).alias("last")
    )
    keys = keys.where("n > 2 and last > first.doc").select(
        "key", F.col("first.doc").alias("family"), F.floor(F.col("first.c") / REGION).cast("int").alias("region"), F.col("first.c").alias("fc")
    )
    keys = broadcast_if_small(materialize(keys, "open-keys"), BROADCAST_ROWS)
    wide = 2 * length
    rows = records.join(keys, "key").withColumns(
        {"lo": F.greatest("lo", F.col("c") - wide), "hi": F.least("hi", F.col("c") + wide), "shift": F.col("c") - F.col("fc")}
    )
    # Places of a document that lie on the first one alike are one.
    family = ["family", "region", "doc", F.floor(F.col("shift") / REGION).alias("part")]
    down, up = F.floor(F.min("lo") / STEP) * STEP, F.floor((F.max("hi") + TOKEN - SHINGLE) / STEP) * STEP + STEP - 1
    rows = rows.groupBy(*family).agg(
        F.min("c").alias("c"), F.min_by("shift", "c").alias("shift"), F.min(F.when(F.col("open"), F.col("c"))).alias("open_from"),
        F.max(F.when(F.col("open"), F.col("c"))).alias("open_to"), down.cast("int").alias("lo"), up.cast("int").alias("hi"),
    )
    rows = materialize(rows.withColumn("open", F.col("open_from").isNotNull()), "families")
    shingles = _range_shingles(heads, rows.select("doc", "lo", "hi"))
    full = rows.join(shingles, ["doc", "lo", "hi"])
    firsts = full.where("doc = family and part = 0").select("family", "region", F.col("lo").alias("flo"), F.col("shingles").alias("theirs"))
    firsts = materialize(firsts.dropDuplicates(["family", "region"]), "family-firsts")
    values = firsts.agg(F.sum(F.size("theirs"))).first()[0] or 0
    firsts = F.broadcast(firsts) if values <= BROADCAST_VALUES else firsts
    edges = _edges(full.where("doc <> family").join(firsts, ["family", "region"]))
    edges = materialize(edges, "edges")
    sizes = edges.groupBy("edge").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"), F.max(F.when(F.col("open"), F.col("doc"))).alias("last")
    )
    sizes = sizes.where("n > 1 and last > least").select("edge", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = broadcast_if_small(materialize(sizes, "edge-sizes"), BROADCAST_ROWS)
    cells = edges.join(sizes, "edge").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    full = cells.join(shingles, ["doc", "lo", "hi"])
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = ["edge", "i", "j"]
    full = full.select(
        "edge", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "doc", F.col("place").alias("shift"), "lo", "open", "open_from", "open_to", "shingles",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1:
                    out += _grid_passages(table.slice(a, b - a).combine_chunks(), length, share)
            if out:
                arrays = [pa.array(np.array(x, np.int64)) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "pdoc", "start", "end"])

        def edges(table: pa.Table) -> np.ndarray:
            columns = [table.column(c).to_numpy() for c in grid]
            return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)]))

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            table = pa.concat_tables([held, table]) if held is not None else table
            starts = edges(table)
            yield from compared(table, starts)
            held = table.slice(starts[-1])
        if held is not None:
            yield from compared(held, np.array([0, held.num_rows]))

    return full.repartition(*grid).sortWithinPartitions(*grid).mapInArrow(run, FOUND)


def repeated_passages(
    documents: DataFrame, words: int = WORDS, share: int = SHARE, id_column="doc_id", text_column="text",
) -> DataFrame:
    """(doc, pdoc, start, end): passages of ``words`` words or more, in words from 0, end exclusive,
    that are near duplicates of a passage of the earlier document ``pdoc``."""
    length = words - SHINGLE + 1
    rows = documents.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    rows = rows.where("doc is not null and text is not null")
    # Of equal texts the first is looked at; the others are repeats as a whole.
    same = F.unhex(F.md5(F.col("text").cast("binary")))
    count = F.size(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    firsts = rows.groupBy(same.alias("same")).agg(F.min("doc").alias("pdoc"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = broadcast_if_small(materialize(firsts.select("same", "pdoc"), "equal-texts"), BROADCAST_ROWS)
    copies = rows.join(firsts, same == F.col("same")).where("doc > pdoc").withColumn("size", count).where(F.col("size") >= words)
    copies = copies.select("same", "doc", "pdoc", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    copies = materialize(copies, "copies")
    gone = broadcast_if_small(copies.select("same", F.col("doc").alias("d")).distinct(), BROADCAST_ROWS)
    heads = rows.join(gone, (same == F.col("same")) & (F.col("doc") == F.col("d")), "left_anti")
    copies = copies.drop("same")

    met = materialize(_met(_records(heads, words, share)), "windows")
    near = met.where(F.col("kind") == PASSAGE).select(
        "doc", "pdoc", F.shiftright("pack", 32).alias("start"), F.col("pack").bitwiseAND((1 << 32) - 1).alias("end")
    )
    across = materialize(islands(met.where(F.col("kind") == PAIR)), "islands")
    across = materialize(_verified(heads, across, length, share), "passages-across")
    found = near.unionByName(across)
    return copies.unionByName(found).unionByName(_open_passages(heads, met, found, length, share))


def spans(passages: DataFrame) -> DataFrame:
    """(doc, starts, ends, first_doc): merged word spans of each document, and the smallest document repeated."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = passages.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("doc", "span").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min("pdoc").alias("p"))
    listed = merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("x"), F.min("p").alias("first_doc"))
    return listed.select("doc", F.col("x.s").alias("starts"), F.col("x.e").alias("ends"), "first_doc")


def without_passages(
    documents: DataFrame, found: DataFrame, id_column="doc_id", text_column="text",
) -> DataFrame:
    """All rows and columns of ``documents``; the words of the spans are gone from the texts."""
    found = broadcast_if_small(materialize(found, "passage-spans"), BROADCAST_ROWS)
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("row"), F.col(id_column).cast("long").alias("doc"))
    rows = rows.join(found.select("doc", "starts", "ends"), "doc", "left")
    space = "[\\x20\\x09-\\x0D]"
    # Words with the white space behind them; white space before the first word stays.
    text = F.col(f"row.{text_column}")
    lead = F.regexp_extract(text, f"^{space}+", 0)
    words = F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]+{space}*"), F.lit(0))
    # Stretches between the spans, by words.
    stops = F.concat(F.array(F.lit(0).cast("long")), F.col("ends"))
    stretch = lambda from_, i: F.slice(
        words,
        (from_ + 1).cast("int"),
        F.greatest(F.lit(0), (F.coalesce(F.get("starts", i), F.size(words).cast("long")) - from_)).cast("int"),
    )
    left = F.array_join(F.flatten(F.transform(stops, lambda x, i: stretch(x, i))), "")
    text = F.when(F.col("starts").isNull(), text).otherwise(F.concat(lead, left))
    return rows.select(*[text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in names])
