"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its score is linear in features of the
line and of its two neighbours; the chain adds a score for each pair of
neighbouring labels. Forward-backward gives each line's marginal probability of
being good, and a document's score is their mean, weighted by line length.

The field is trained here on a bounded sample of labelled documents
(``SAMPLE_DOCS``, by a hash of the id, at most ``SAMPLE_LINES`` lines each):
all lines take their document's label, and the likelihood is climbed by its
exact gradient. Only features and weights leave the tasks.

Defined results: a text without a word, empty or null, has one line with all
features zero. Labels that contradict each other for one id, or are null, are
not learned from; without any label every score is 0.5. Repeated rows are
scored again; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.arrow import map_columns

SAMPLE_DOCS = 3_000
SAMPLE_LINES = 60
STEPS = 150
RATE = 0.08
PENALTY = 1e-3

#: Classes of bytes that are counted in a line.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "symbol": b"#*$%&<>@^_=+~\\/{}[]",
    "pipe": b"|",
    "mark": b"!?",
    "stop": b".,;:'\"()-",
    "other": bytes(range(128, 256)),
}
N_OWN = len(CLASSES) + 8
N_FEATURES = 3 * N_OWN


def _table() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES.values()):
        out[list(members)] = k
    return out


TABLE = _table()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (line, feature) of all lines of all texts, their lengths, and the number of lines of each text."""
    lines, counts, extra = [], [], []
    for text in texts:
        seen_words: set[str] = set()
        seen_lines: set[str] = set()
        kept = 0
        for line in (text or "").split("\n"):
            words = line.split()
            if not words:
                continue
            distinct = set(words)
            kept += 1
            lines.append(line.encode())
            last = line.rstrip()[-1]
            extra.append(
                (
                    np.log1p(len(words)),
                    len(distinct) / len(words),
                    len(distinct & seen_words) / len(distinct),
                    line in seen_lines,
                    last in ".!?",
                    line.lstrip()[0].isupper(),
                    len(line) / len(words) / 10,
                    1.0,
                )
            )
            seen_words |= distinct
            seen_lines.add(line)
        if not kept:
            lines.append(b"")
            extra.append((0.0,) * 8)
        counts.append(max(1, kept))
    if not lines:
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lengths)
    classes = TABLE[np.frombuffer(b"".join(lines), np.uint8)]
    own = np.zeros((len(lines), N_OWN))
    for k in range(len(CLASSES)):
        total = np.concatenate([[0], np.cumsum(classes == k, dtype=np.int64)])
        own[:, k] = (total[ends] - total[ends - lengths]) / np.maximum(1, lengths)
    own[:, len(CLASSES) :] = extra
    counts = np.array(counts)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[firsts] = 0
    after[firsts + counts - 1] = 0
    return np.concatenate([own, before, after], axis=1), np.maximum(1, lengths), counts


class Field:
    """Weights of the chain: labels are 0 (bad) and 1 (good)."""

    def __init__(self):
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weights, self.bias, self.pairs = np.zeros(N_FEATURES), 0.0, np.zeros((2, 2))

    def _marginals(self, good: np.ndarray, counts: np.ndarray):
        """Marginals of good, expected label pairs, and the log of the normaliser, of chains laid end to end.

        Chains run side by side, longest first, one position at a time.
        """
        order = np.argsort(-counts, kind="stable")
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
        sizes = counts[order]
        peak = np.maximum(good, 0)
        local = np.stack([np.exp(-peak), np.exp(good - peak)], axis=1)
        turn = np.exp(self.pairs)
        forward, scales = np.zeros((len(good), 2)), np.zeros(len(good))
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
        message = None
        for t in range(steps):
            at = firsts[: active[t]] + t
            value = local[at] if t == 0 else (message[: active[t]] @ turn) * local[at]
            total = value.sum(axis=1)
            message = value / total[:, None]
            forward[at], scales[at] = message, total
        backward = np.ones((len(good), 2))
        expected = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            at = firsts[: active[t + 1]] + t
            ahead = backward[at + 1] * local[at + 1] / scales[at + 1][:, None]
            expected += turn * (forward[at].T @ ahead)
            backward[at] = ahead @ turn.T
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), expected, float((np.log(scales) + peak).sum())

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = (features - self.mean) / self.scale @ self.weights + self.bias
        return self._marginals(good, counts)[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        features, lengths, counts = line_features(texts)
        if not len(counts):
            return np.zeros(0)
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        good = self.marginals(features, counts)
        return np.clip(np.add.reduceat(good * lengths, firsts) / np.add.reduceat(lengths, firsts), 0, 1)

    def train(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps=STEPS, rate=RATE) -> float:
        """Adam on the mean log likelihood of the label sequences; the last value of it."""
        if not len(counts):
            return 0.0
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        x = (features - self.mean) / self.scale
        y = np.repeat(labels, counts).astype(float)
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = (counts[labels == k] - 1).sum()
        first, second, value = np.zeros(N_FEATURES + 5), np.zeros(N_FEATURES + 5), 0.0
        for step in range(1, steps + 1):
            good = x @ self.weights + self.bias
            marginal, expected, normaliser = self._marginals(good, counts)
            value = ((good * y).sum() + (seen * self.pairs).sum() - normaliser) / len(counts)
            slope = np.concatenate([(y - marginal) @ x, [(y - marginal).sum()], (seen - expected).ravel()]) / len(counts)
            now = np.concatenate([self.weights, [self.bias], self.pairs.ravel()])
            slope -= PENALTY * now
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            now += rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            self.weights, self.bias, self.pairs = now[:N_FEATURES], now[N_FEATURES], now[N_FEATURES + 1 :].reshape(2, 2)
        return float(value)


def training_rows(documents: DataFrame, labels: DataFrame, eligible, id_column="doc_id", text_column="text", label_column="quality") -> DataFrame:
    """(label, features, lines) of at most ``SAMPLE_DOCS`` labelled documents."""
    chosen = (
        labels.where(eligible & F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(id_column)
        .agg(F.min(label_column).alias("__label"), F.max(label_column).alias("__other"))
        .where(F.col("__label") == F.col("__other"))
        .orderBy(F.xxhash64(id_column), id_column)
        .limit(SAMPLE_DOCS)
        .select(id_column, "__label")
    )
    # At most SAMPLE_DOCS rows on the small side, and no more after ids that repeat are dropped.
    rows = documents.select(id_column, text_column).join(F.broadcast(chosen), id_column)

    def make():
        def step(keys, label, texts):
            features, _, counts = line_features(texts.to_pylist())
            firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int) if len(counts) else []
            cut = [features[a : a + min(n, SAMPLE_LINES)] for a, n in zip(firsts, counts)]
            return [keys, label, [x.ravel().tolist() for x in cut], [len(x) for x in cut]]

        return step

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, label int, features array<double>, lines int"
    return map_columns(rows, [id_column, "__label", text_column], schema, make).dropDuplicates([id_column])


def fit(documents: DataFrame, labels: DataFrame, eligible, id_column="doc_id", text_column="text", label_column="quality") -> Field:
    rows = training_rows(documents, labels, eligible, id_column, text_column, label_column).collect()
    rows.sort(key=lambda r: str(r[0]))
    field = Field()
    if rows:
        features = np.concatenate([np.array(r["features"]).reshape(-1, N_FEATURES) for r in rows])
        field.train(features, np.array([r["lines"] for r in rows]), np.array([r["label"] for r in rows]))
    return field


def score(documents: DataFrame, field: Field, id_column="doc_id", text_column="text") -> DataFrame:
    """(id, score double) of every row."""

    def make():
        return lambda keys, texts: [keys, field.scores(texts.to_pylist())]

    kind = documents.schema[id_column].dataType.simpleString()
    return map_columns(documents, [id_column, text_column], f"`{id_column}` {kind}, score double", make)
