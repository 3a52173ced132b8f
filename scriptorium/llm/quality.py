"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over every byte of the document.
Their responses are max-pooled over overlapping chunks (two neighbouring cells
of ``CELL`` bytes each), pass a rectifier, and the mean and the maximum over
all chunks are combined into one probability.

Training uses numpy on the driver and a bounded sample: per class at most
``SAMPLE_PER_CLASS`` labelled rows, taken by a hash of doc_id, with texts of at
most ``SAMPLE_CHARS`` characters, never rows held out by crc32(doc_id) mod 4 =
2.  Only text bytes enter a score.  Scoring runs over whole texts in pieces of
bounded size.  The last bias is shifted so that 0.7 separates the classes of
the sample best.

Defined cases: null and empty texts are one empty chunk and get its constant
score; a null doc_id is not held out; without labels of both classes every
score is 0.5; repeated rows get equal scores.  Of labels of one doc_id that
differ the smaller counts, and of its texts that differ the one of least hash,
so the sample does not depend on how the tables are divided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import map_batches, text_or_empty

WIDTH = 6
FILTERS = 16
CELL = 256
PIECE = 256 * CELL
SAMPLE_PER_CLASS = 1200
SAMPLE_CHARS = 32_000
EPOCHS = 14
BATCH = 32
RATE = 0.01
THRESHOLD = 0.7
HELD_OUT = 2


class Network:
    """Weights: filters (WIDTH, 256, FILTERS), bias, and the combination of mean and maximum."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.mean = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.top = np.zeros(FILTERS, dtype=np.float32)
        self.last = np.zeros(1, dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.mean, self.top, self.last]

    def pair_tables(self) -> list[np.ndarray]:
        """Summed responses of neighbouring taps for each pair of bytes: half the look-ups."""
        taps = self.filters
        return [(taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]


def responses(data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Filter responses at each byte; ``data`` ends with WIDTH - 1 bytes of padding or look-ahead."""
    pairs = data[:-1].astype(np.int32) * 256 + data[1:]
    n = len(data) - WIDTH + 1
    total = tables[0][pairs[:n]]
    for j in range(1, len(tables)):
        total += tables[j][pairs[2 * j : 2 * j + n]]
    return total


def padded(text: str) -> np.ndarray:
    return np.frombuffer((text.encode("utf-8") or b"\0") + b"\0" * (WIDTH - 1), dtype=np.uint8)


def chunk_maxima(cells: np.ndarray) -> np.ndarray:
    """Overlapping chunks: each pair of neighbouring cells (one cell alone is a chunk)."""
    return np.maximum(cells[:-1], cells[1:]) if len(cells) > 1 else cells


def logit(text: str, network: Network, tables: list[np.ndarray]) -> float:
    data = padded(text)
    n = len(data) - WIDTH + 1
    cells = []
    for at in range(0, n, PIECE):
        found = responses(data[at : min(n, at + PIECE) + WIDTH - 1], tables)
        cells.append(np.maximum.reduceat(found, np.arange(0, len(found), CELL)))
    hidden = np.maximum(chunk_maxima(np.concatenate(cells)) + network.bias, 0)
    return float(hidden.mean(0) @ network.mean + hidden.max(0) @ network.top + network.last[0])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _backward(text: str, label: int, weight: float, network: Network, tables: list[np.ndarray], grads: list) -> None:
    """Add one document's gradient; filter gradients go to the bytes under each pooled maximum."""
    data = padded(text)
    found = responses(data, tables)
    n, count = len(found), -(-len(found) // CELL)
    grid = np.full((count * CELL, FILTERS), -np.inf, dtype=np.float32)
    grid[:n] = found
    grid = grid.reshape(count, CELL, FILTERS)
    place = grid.argmax(1)
    cells = np.take_along_axis(grid, place[:, None], 1)[:, 0]
    place = place + np.arange(count)[:, None] * CELL
    if count > 1:
        second = cells[1:] > cells[:-1]
        place = np.where(second, place[1:], place[:-1])
    chunks = chunk_maxima(cells) + network.bias
    hidden = np.maximum(chunks, 0)
    first = hidden.argmax(0)
    columns = np.arange(FILTERS)
    score = hidden.mean(0) @ network.mean + hidden[first, columns] @ network.top + network.last[0]
    slope = np.float32(weight * (sigmoid(score) - label))
    back = np.tile(slope * network.mean / len(hidden), (len(hidden), 1))
    back[first, columns] += slope * network.top
    back *= chunks > 0
    grads[1] += back.sum(0)
    grads[2] += slope * hidden.mean(0)
    grads[3] += slope * hidden[first, columns]
    grads[4] += slope
    flat = np.broadcast_to(columns, place.shape).ravel()
    for j in range(WIDTH):
        at = data[place.ravel() + j].astype(np.int64) * FILTERS + flat
        grads[0][j] += np.bincount(at, back.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit by Adam on class-balanced cross entropy, then place the threshold."""
    network = Network(seed)
    y = np.array(labels)
    if len(set(labels)) < 2:
        network.mean[:] = 0
        return network
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in network.weights()]
    second = [np.zeros_like(w) for w in network.weights()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            grads = [np.zeros_like(w) for w in network.weights()]
            tables, batch = network.pair_tables(), order[at : at + BATCH]
            for k in batch:
                _backward(texts[k], int(y[k]), float(weight[k]) / len(batch), network, tables, grads)
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for w, g, m, v in zip(network.weights(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    tables = network.pair_tables()
    scores = np.array([logit(t, network, tables) for t in texts])
    order = np.argsort(scores)
    ranked, good = scores[order], y[order] == 1
    # cutting before rank k: share of good ones kept plus share of bad ones dropped
    kept = 1 - np.concatenate(([0], np.cumsum(good))) / good.sum()
    dropped = np.concatenate(([0], np.cumsum(~good))) / (~good).sum()
    best = np.flatnonzero(kept + dropped >= (kept + dropped).max() - 1e-9)
    k = int(np.clip(best[len(best) // 2], 1, len(y) - 1))
    cut = (ranked[k - 1] + ranked[k]) / 2
    network.last -= np.float32(cut - np.log(THRESHOLD / (1 - THRESHOLD)))
    return network


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], list[int]]:
    """The bounded training sample; the labels are sampled first, so documents are never shuffled."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(
        F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT
    )
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taken = None
    for quality in (0, 1):
        part = usable.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        taken = part if taken is None else taken.unionByName(part)
    taken = taken.withColumnRenamed("doc_id", "label_id")
    rows = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(taken), F.col("doc_id") == F.col("label_id"))
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.quality for r in rows]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    network = train(*labelled_sample(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.pair_tables()
        for batch in batches:
            found = sigmoid(np.array([logit(t.as_py(), network, tables) for t in batch.column(2)], dtype=np.float64))
            predicted = (found >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array(predicted)],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_or_empty().alias("text"))
    return map_batches(source, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are."""
    network = train(*labelled_sample(docs, labels))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.pair_tables()
        for batch in batches:
            logits = [logit(t.as_py() or "", network, tables) for t in batch.column(at_text)]
            yield batch.filter(pa.array(sigmoid(np.array(logits, dtype=np.float64)) >= THRESHOLD))

    return map_batches(docs, run, docs.schema)
