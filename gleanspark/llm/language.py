"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads one white-space separated word at a time (words longer than
``SEGMENT`` bytes in pieces of that size), forwards and backwards, and labels
every byte. A document's probabilities are pooled from its positions: the mean
of their log probabilities, weighted by bytes, through a softmax. Since the
state starts anew with each word, the summed log probabilities of a word are
the same wherever it stands, so a worker computes each distinct word once and
looks it up afterwards. All words of the whole text count.

The network is trained here, in numpy, by backpropagation through time, on a
bounded sample of documents: ``SAMPLE_ROWS`` per language, chosen by a hash of
the id, and ``SAMPLE_WORDS`` words spread over each. Weights go to the tasks
in the closure; their size depends on the number of languages only.

Defined results: null texts and texts without a letter give ``und`` with score
0. Texts without a trained label (an empty training set) give ``und`` too. A
null id counts as the id text '' where rows are chosen. Repeated rows are
predicted again; ties take the first label in order. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.arrow import map_columns

HIDDEN = 12
SEGMENT = 24
SAMPLE_ROWS = 150
SAMPLE_WORDS = 150
STEPS = 260
BATCH = 384
RATE = 0.02
UNDEFINED = "und"
# Distinct words whose pooled log probabilities a worker keeps.
KEPT_WORDS = 400_000


def held_out(id_column: str, parts: int, part: int):
    """Column: crc32 of the id as text, modulo ``parts``, is ``part``."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts == part


def segments(word: str) -> list[bytes]:
    """Bytes of the lower-cased word behind a blank, in pieces of at most ``SEGMENT``."""
    data = b" " + word.lower().encode()
    return [data[k : k + SEGMENT] for k in range(0, len(data), SEGMENT)]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (word, position) and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(lengths.max(initial=1))), np.uint8)
    mask = np.arange(out.shape[1]) < lengths[:, None]
    out[mask] = np.frombuffer(b"".join(words), np.uint8)
    return out, lengths


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """Two gated recurrent units, one a direction, and a label layer on both states."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.weights = {"out": normal(2 * hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}
        for way in "fb":
            # Inputs of the update gate, the reset gate and the candidate, for each byte; and the recurrent parts.
            self.weights[f"in_{way}"] = normal(256, 3 * hidden)
            self.weights[f"gates_{way}"] = normal(hidden, 2 * hidden)
            self.weights[f"cell_{way}"] = normal(hidden, hidden)

    def _run(self, way: str, data: np.ndarray, lengths: np.ndarray, keep: bool):
        """States (position, word, unit) in reading order of ``way``; what backpropagation needs, if kept."""
        w, h = self.weights, self.hidden
        steps = data.shape[1]
        state = np.zeros((len(data), h), np.float32)
        states, memory = np.zeros((steps, len(data), h), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            inputs = w[f"in_{way}"][data[:, t]]
            gates = _sigmoid(inputs[:, : 2 * h] + state @ w[f"gates_{way}"])
            update, reset = gates[:, :h], gates[:, h:]
            held = reset * state
            cell = np.tanh(inputs[:, 2 * h :] + held @ w[f"cell_{way}"])
            on = (t < lengths)[:, None]
            fresh = np.where(on, update * state + (1 - update) * cell, state)
            if keep:
                memory.append((t, state, update, reset, held, cell, on))
            state = fresh
            states[t] = state
        return states, memory

    def log_probabilities(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over a word's positions of the log probabilities of the labels."""
        states = np.concatenate([self._run(way, data, lengths, False)[0] for way in "fb"], axis=2)
        scores = states @ self.weights["out"] + self.weights["bias"]
        scores -= scores.max(axis=2, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=2, keepdims=True))
        scores *= (np.arange(data.shape[1])[:, None] < lengths)[:, :, None]
        return scores.sum(axis=0)

    def gradients(self, data: np.ndarray, lengths: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions, and its gradients, through time."""
        w, h = self.weights, self.hidden
        runs = {way: self._run(way, data, lengths, True) for way in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        scores = states @ w["out"] + w["bias"]
        scores -= scores.max(axis=2, keepdims=True)
        chances = np.exp(scores)
        chances /= chances.sum(axis=2, keepdims=True)
        on = np.arange(data.shape[1])[:, None] < lengths
        total = on.sum()
        picked = np.take_along_axis(chances, np.broadcast_to(targets[None, :, None], (*on.shape, 1)), 2)[:, :, 0]
        loss = float(-(np.log(picked + 1e-9) * on).sum() / total)
        error = chances
        np.put_along_axis(error, np.broadcast_to(targets[None, :, None], (*on.shape, 1)), picked[:, :, None] - 1, 2)
        error *= on[:, :, None] / total
        out = {"out": np.einsum("tnh,tnk->hk", states, error), "bias": error.sum((0, 1))}
        back = error @ w["out"].T
        for way, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            grad_in, grad_gates, grad_cell = (np.zeros_like(w[f"{k}_{way}"]) for k in ("in", "gates", "cell"))
            flow = np.zeros((len(data), h), np.float32)
            for t, state, update, reset, held, cell, live in reversed(runs[way][1]):
                flow = flow + part[t] * live
                here = flow * live
                d_cell = here * (1 - update) * (1 - cell * cell)
                d_held = d_cell @ w[f"cell_{way}"].T
                d_update = here * (state - cell) * update * (1 - update)
                d_reset = d_held * state * reset * (1 - reset)
                d_gates = np.concatenate([d_update, d_reset], axis=1)
                grad_cell += held.T @ d_cell
                grad_gates += state.T @ d_gates
                np.add.at(grad_in, data[:, t], np.concatenate([d_gates, d_cell], axis=1))
                flow = here * update + d_held * reset + d_gates @ w[f"gates_{way}"].T + flow * ~live
            out |= {f"in_{way}": grad_in, f"gates_{way}": grad_gates, f"cell_{way}": grad_cell}
        return loss, out

    def train(self, words: list[bytes], targets: np.ndarray, steps=STEPS, batch=BATCH, rate=RATE, seed=11) -> float:
        """Adam on random batches of words of like length; the last losses' mean."""
        if len(self.labels) < 2 or not words:
            return 0.0
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        by_label = [np.flatnonzero(targets == k) for k in range(len(self.labels))]
        by_label = [x for x in by_label if len(x)]
        losses = []
        for step in range(1, steps + 1):
            picks = np.concatenate([rng.choice(x, max(1, batch // len(by_label))) for x in by_label])
            data, lengths = padded([words[i] for i in picks])
            loss, grads = self.gradients(data, lengths, targets[picks])
            losses.append(loss)
            pace = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                self.weights[k] -= (pace * first[k] / (1 - 0.9**step) / scale).astype(np.float32)
        return float(np.mean(losses[-20:]))


def sample(documents: DataFrame, eligible, id_column="doc_id", text_column="text", label_column="lang") -> list:
    """At most ``SAMPLE_ROWS`` documents of each label, by a hash of the id, and ``SAMPLE_WORDS`` words spread over each.

    The ids are ranked first, on narrow rows; only the chosen documents' words come to the driver.
    """
    # The rank is trimmed on the map side.
    order = Window.partitionBy(label_column).orderBy(F.xxhash64(id_column), id_column)
    narrow = documents.where(eligible & F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    chosen = (
        narrow.select(id_column, label_column)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= SAMPLE_ROWS)
        .select(id_column, F.col(label_column).alias("__label"))
        .dropDuplicates([id_column])
    )
    words = F.split(F.trim(F.coalesce(text_column, F.lit(""))), r"\s+")
    stride = F.greatest(F.lit(1), F.floor(F.size("w") / SAMPLE_WORDS)).cast("int")
    return (
        narrow.select(id_column, words.alias("w"))
        .join(F.broadcast(chosen), id_column)  # at most SAMPLE_ROWS rows a label
        .dropDuplicates([id_column])  # rows that repeat an id stay within the bound
        .select("__label", F.slice(F.filter("w", lambda x, i: i % stride == 0), 1, SAMPLE_WORDS).alias("w"))
        .collect()
    )


def fit(documents: DataFrame, eligible, id_column="doc_id", text_column="text", label_column="lang") -> Network:
    rows = sample(documents, eligible, id_column, text_column, label_column)
    rows.sort(key=lambda r: (r["__label"], r["w"]))
    labels = sorted({r["__label"] for r in rows})
    words, targets = [], []
    for row in rows:
        for word in row["w"]:
            for part in segments(word) if word else ():
                words.append(part)
                targets.append(labels.index(row["__label"]))
    network = Network(labels)
    network.train(words, np.array(targets, np.int64))
    return network


class Reader:
    """Pools documents with one network; words seen before are looked up."""

    def __init__(self, network: Network):
        self.network, self.known, self.values = network, {}, np.zeros((0, len(network.labels)), np.float32)

    def _learn(self, words: list[str]) -> np.ndarray:
        parts = [segments(w) for w in words]
        flat = [p for x in parts for p in x]
        sums = np.zeros((len(flat), len(self.network.labels)), np.float32)
        order = np.argsort(np.fromiter(map(len, flat), np.int64, len(flat)), kind="stable")
        for k in range(0, len(order), 4096):
            picks = order[k : k + 4096]
            sums[picks] = self.network.log_probabilities(*padded([flat[i] for i in picks]))
        starts = np.cumsum([0, *map(len, parts[:-1])])
        return np.add.reduceat(sums, starts, axis=0)

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.network.labels:
            return [(UNDEFINED, 0.0)] * len(texts)
        split = [x.split() if x else [] for x in texts]
        fresh = [w for w in set().union(*split) if w not in self.known] if split else []
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known, self.values = {}, self.values[:0]
            fresh = list(set().union(*split))
        if fresh:
            start = len(self.values)
            self.values = np.concatenate([self.values, self._learn(fresh)])
            self.known.update(zip(fresh, range(start, start + len(fresh))))
        out, find, labels = [], self.known.__getitem__, self.network.labels
        for text, words in zip(texts, split):
            if not text or not any(map(str.isalpha, text)):
                out.append((UNDEFINED, 0.0))
                continue
            sums = self.values[np.fromiter(map(find, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            # Positions pool by their mean; the root of the word count keeps long texts from saturating.
            pooled = sums / max(1, len(text)) * np.sqrt(len(words))
            chances = np.exp(pooled - pooled.max())
            chances /= chances.sum()
            best = int(chances.argmax())
            out.append((labels[best], float(chances[best])))
        return out


def predict(documents: DataFrame, network: Network, id_column="doc_id", text_column="text") -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def make():
        reader = Reader(network)

        def step(keys, texts):
            found = reader.read(texts.to_pylist())
            return [keys, [x for x, _ in found], [x for _, x in found]]

        return step

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, lang_pred string, score double"
    return map_columns(documents, [id_column, text_column], schema, make)
