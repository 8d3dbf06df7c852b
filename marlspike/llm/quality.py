"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, and filters of ``2 * BLOCK`` bytes slide over them a block at a time.
Chunks of ``CHUNK_GROUPS`` groups of ``GROUP`` blocks overlap by one group and cover the
whole document. A filter's greatest value in a chunk is pooled; the document's features are
the mean and the greatest of that over its chunks, and a logistic unit combines them.
Embedding, filters and unit are learned together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batches_by_bytes, in_training, training_sample
from .textvec import flat_bytes, ragged, row_sizes

#: Bounds of the training sample: documents of each label, and the bytes of one document.
SAMPLE_DOCS = 1000
SAMPLE_TEXT_BYTES = 16_384
EPOCHS, BATCH_DOCS, RATE = 12, 24, 0.02
SHORT_SHARE = 0.25
DIMS, FILTERS = 8, 32
BLOCK, GROUP, CHUNK_GROUPS = 4, 32, 4
GROUP_BYTES = BLOCK * GROUP
SLICE_BYTES = 1 << 18
THRESHOLD = 0.3


class Layout:
    """Rows of bytes laid out in whole groups: byte 0 of the table below is padding, byte b stands at b + 1."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = np.diff(bounds)
        self.groups = (n + BLOCK) // GROUP_BYTES + 1
        self.first = np.concatenate(([0], np.cumsum(self.groups)))
        self.bytes = np.zeros(int(self.first[-1]) * GROUP_BYTES, np.int16)
        self.bytes[ragged(self.first[:-1] * GROUP_BYTES, n)] = data.astype(np.int16) + 1
        self.last_blocks = self.first[1:] * GROUP - 1
        step = CHUNK_GROUPS - 1
        self.chunks = np.maximum(1, -(-(self.groups - 1) // step))
        self.chunk_first = np.concatenate(([0], np.cumsum(self.chunks)))
        row = np.repeat(np.arange(len(n)), self.chunks)
        k = np.arange(int(self.chunk_first[-1])) - self.chunk_first[row]
        start = self.first[row] + k * step
        self.chunk_groups = np.minimum(start[:, None] + np.arange(CHUNK_GROUPS), self.first[row + 1][:, None] - 1)


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (257, DIMS)).astype(np.float32)
        self.embed[0] = 0
        self.filters = rng.normal(0, 0.25, (2 * BLOCK * DIMS, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.unit = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.unit, self.bias]

    def forward(self, at: Layout):
        x = self.embed[at.bytes].reshape(-1, BLOCK * DIMS)
        half = BLOCK * DIMS
        act = x @ self.filters[:half]
        act[:-1] += x[1:] @ self.filters[half:]
        act += self.offset
        act[at.last_blocks] = 0  # the block after it is another document's
        np.maximum(act, 0, out=act)
        pooled = act.reshape(-1, GROUP, FILTERS).max(axis=1)
        chunk = pooled[at.chunk_groups].max(axis=1)
        mean = np.add.reduceat(chunk, at.chunk_first[:-1], axis=0) / at.chunks[:, None].astype(np.float32)
        top = np.maximum.reduceat(chunk, at.chunk_first[:-1], axis=0)
        features = np.concatenate((mean, top), axis=1)
        return features @ self.unit + self.bias[0], (x, act, pooled, chunk, top, features)

    def gradients(self, at: Layout, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        z, (x, act, pooled, chunk, top, features) = self.forward(at)
        dz = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32) / len(y)
        d_unit, d_bias = features.T @ dz, np.array([dz.sum()], np.float32)
        row = np.repeat(np.arange(len(y)), at.chunks)
        # chunks overlap, so several may have a document's greatest value from one place: the first counts
        is_top = chunk == top[row]
        seen = np.cumsum(is_top, axis=0)
        before = np.concatenate((np.zeros((1, FILTERS), seen.dtype), seen))[at.chunk_first[row]]
        is_top &= seen - before == 1
        d_chunk = dz[row, None] * (self.unit[:FILTERS] / at.chunks[row, None] + self.unit[FILTERS:] * is_top)
        # the greatest of a chunk's groups, then of a group's blocks
        column = np.arange(FILTERS)
        best = pooled[at.chunk_groups].argmax(axis=1)
        d_pooled = np.zeros_like(pooled)
        np.add.at(d_pooled, (at.chunk_groups[np.arange(len(chunk))[:, None], best], column[None, :]), d_chunk)
        where = act.reshape(-1, GROUP, FILTERS).argmax(axis=1) + (np.arange(len(pooled)) * GROUP)[:, None]
        d_act = np.zeros_like(act)
        d_act[where, column[None, :]] = d_pooled * (pooled > 0)
        half = BLOCK * DIMS
        d_filters = np.concatenate((x.T @ d_act, x[1:].T @ d_act[:-1]))
        d_x = d_act @ self.filters[:half].T
        d_x[1:] += d_act[:-1] @ self.filters[half:].T
        d_x = d_x.reshape(-1, DIMS)
        d_embed = np.stack([np.bincount(at.bytes, weights=d_x[:, k], minlength=257) for k in range(DIMS)], axis=1).astype(np.float32)
        d_embed[0] = 0
        return [d_embed, d_filters, d_act.sum(axis=0), d_unit, d_bias]

    def tables(self) -> np.ndarray:
        """What a byte at each place under a filter adds to its value: ``2 * BLOCK`` by 257 by ``FILTERS``."""
        return np.stack([self.embed @ f for f in self.filters.reshape(2 * BLOCK, DIMS, FILTERS)])

    def score(self, data: np.ndarray, bounds: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """As ``forward``, but for the order of sums: it is the same for a row whatever rows are around it, so its score is too."""
        at = Layout(data, bounds)
        block = at.bytes.reshape(-1, BLOCK)
        act = np.tile(self.offset, (len(block), 1))
        for j in range(BLOCK):
            act += tables[j].take(block[:, j], axis=0)
            act[:-1] += tables[BLOCK + j].take(block[1:, j], axis=0)
        act[at.last_blocks] = 0
        np.maximum(act, 0, out=act)
        chunk = act.reshape(-1, GROUP, FILTERS).max(axis=1)[at.chunk_groups].max(axis=1)
        mean = np.add.reduceat(chunk, at.chunk_first[:-1], axis=0, dtype=np.float64) / at.chunks[:, None]
        top = np.maximum.reduceat(chunk, at.chunk_first[:-1], axis=0)
        z = (np.concatenate((mean, top), axis=1) * self.unit).sum(axis=1) + self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(texts, good: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model from an Arrow array of texts and their labels, by Adam over shuffled batches; classes weigh alike."""
    model = Model(seed)
    if not len(good) or good.all() or not good.any():
        model.unit[:] = 0
        model.bias[:] = 4.0 if len(good) and good.all() else -4.0 if len(good) else 0.0
        return model
    rng = np.random.default_rng(seed)
    y = good.astype(np.float32)
    weight = np.where(good, 0.5 / y.mean(), 0.5 / (1 - y).mean()).astype(np.float32)
    data, bounds = flat_bytes(texts)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step, total = 0, epochs * -(-len(y) // BATCH_DOCS)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH_DOCS):
            rows = order[k : k + BATCH_DOCS]
            lengths, low = bounds[rows + 1] - bounds[rows], bounds[rows]
            # a part of a good text is good: some are cut short, so that being short isn't held against a text
            short = good[rows] & (rng.random(len(rows)) < SHORT_SHARE)
            cut = np.minimum(lengths, rng.integers(8, 256, len(rows)))
            low = np.where(short, low + (rng.random(len(rows)) * (lengths - cut)).astype(np.int64), low)
            lengths = np.where(short, cut, lengths)
            at = Layout(data[ragged(low, lengths)], np.concatenate(([0], np.cumsum(lengths))))
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for p, g, (m, v) in zip(model.parameters(), model.gradients(at, y[rows], weight[rows]), moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.tables()))

    def run(batches):
        import pyarrow as pa

        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(1)) + GROUP_BYTES, SLICE_BYTES):
            model, tables = shared.value
            s = model.score(*flat_bytes(batch.column(1)), tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Fit on the labelled training rows and score every whole text.

    One row for each row of ``docs``: ``doc_id, held_out, score, predicted``. Null and empty
    texts are padding alone and all get one score; a null id is not held out. Without labels,
    or with one label only, all texts get the same score. A score depends on its text alone,
    so repeated rows get equal rows in any batch. Other columns are not read. An empty table gives an empty result.
    """
    model = fit(*training_sample(docs, labels, id_col, text_col, label_col, sample_docs, SAMPLE_TEXT_BYTES))
    return score(docs, model, id_col, text_col, threshold).select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
