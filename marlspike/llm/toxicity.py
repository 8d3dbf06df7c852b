"""Toxic spans and scores by a linear-chain conditional random field.

Tags are 0 (outside) and 1 (toxic). A token's evidence is a sum of weights of hashed
features: its word, its first bytes and its last bytes. Neighbouring tags are tied by
four transition weights. Tags to learn from are derived from document labels: in toxic
documents those tokens count as toxic whose word or beginning is common among toxic
documents and far rarer among others.

Forward and backward messages are kept as the odds of tag 1, which each token changes by
a Moebius map. Maps compose as 2 x 2 matrices, so tokens are taken in segments: all
segments of a batch advance together, and the messages between them follow exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batches_by_bytes, in_training, training_sample
from .textvec import ASCII_LOWER, U64, flat_bytes, row_sizes, span_hashes, spans

#: Bounds of the training sample: documents of each label, and the bytes of one document.
SAMPLE_DOCS = 800
SAMPLE_TEXT_BYTES = 16_384
BUCKET_BITS = 21
ROUNDS = 25
SEGMENT = 128
SLICE_BYTES = 2 << 20
THRESHOLD = 0.5
#: A feature marks toxic tokens if this share of toxic documents has it, and its odds ratio is at least this.
MARK_SHARE = 0.03
MARK_ODDS = 40.0
COUNTED = 0.1
PREFIXES, SUFFIX = (4, 5, 7), 4

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
N_FEATURES = len(PREFIXES) + 2


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, edges, features``: word spans by row, and a bucket for each feature of each word."""
    data = ASCII_LOWER[data]
    starts, ends, edges = spans(_WORD[data], bounds)
    hashed = [span_hashes(data, starts, ends)]
    hashed += [span_hashes(data, starts, np.minimum(starts + n, ends)) for n in PREFIXES]
    tail = np.maximum(ends - SUFFIX, starts)
    hashed.append(span_hashes(data, tail, ends))
    salted = [h * U64(2 * k + 3) for k, h in enumerate(hashed)]
    return starts, ends, edges, np.stack([(h >> U64(64 - BUCKET_BITS)).astype(np.int32) for h in salted], axis=1) if len(starts) else np.zeros((0, N_FEATURES), np.int32)


def _scan(w: np.ndarray, edges: np.ndarray, m: np.ndarray, first: float) -> np.ndarray:
    """Odds after each token: ``f = w (m01 + m11 f') / (m00 + m10 f')`` from the left, and ``f = w first`` at a row's start."""
    lengths = np.diff(edges)
    n_seg = -(-lengths // SEGMENT)
    total = int(n_seg.sum())
    out = np.empty(len(w))
    if not total:
        return out
    seg_row = np.repeat(np.arange(len(lengths)), n_seg)
    seg_in_row = np.arange(total) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    seg_start = edges[:-1][seg_row] + seg_in_row * SEGMENT
    seg_len = np.minimum(SEGMENT, edges[1:][seg_row] - seg_start)
    a, b, c, d = np.zeros(total), np.ones(total), np.ones(total), np.zeros(total)
    heads = seg_in_row == 0
    for j in range(int(seg_len.max())):
        k = np.flatnonzero(seg_len > j)
        x = w[seg_start[k] + j]
        na, nb = x * (m[0, 1] * c[k] + m[1, 1] * a[k]), x * (m[0, 1] * d[k] + m[1, 1] * b[k])
        nc, nd = m[0, 0] * c[k] + m[1, 0] * a[k], m[0, 0] * d[k] + m[1, 0] * b[k]
        if j == 0:
            h = heads[k]
            na[h], nb[h], nc[h], nd[h] = x[h] * first, 0.0, 1.0, 0.0
        scale = nc + nd
        a[k], b[k], c[k], d[k] = na / scale, nb / scale, nc / scale, nd / scale
    before = np.zeros(total)
    by = np.argsort(seg_in_row, kind="stable")
    cuts = np.searchsorted(seg_in_row[by], np.arange(int(n_seg.max()) + 1))
    for low, high in zip(cuts[1:-1], cuts[2:]):
        k = by[low:high]
        f = before[k - 1]
        before[k] = (a[k - 1] + b[k - 1] * f) / (c[k - 1] + d[k - 1] * f)
    f = before
    for j in range(int(seg_len.max())):
        k = np.flatnonzero(seg_len > j)
        at = seg_start[k] + j
        step = (m[0, 1] + m[1, 1] * f[k]) / (m[0, 0] + m[1, 0] * f[k])
        if j == 0:
            step[heads[k]] = first
        f[k] = out[at] = w[at] * step
    return out


def marginals(evidence: np.ndarray, edges: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``p, f, g, w``: chance of tag 1 of each token, with forward and backward odds and the token's own.

    ``transition[i, j]`` is the weight of tag j after tag i; a row begins as if after tag 0.
    """
    w = np.exp(np.clip(evidence, -30, 30))
    m = np.exp(transition)
    f = _scan(w, edges, m, m[0, 1] / m[0, 0])
    back = len(w) - edges[::-1]
    g = _scan(w[::-1], back, m.T, 1.0)[::-1]
    odds = f * g / w
    return odds / (1 + odds), f, g, w


def pair_counts(f: np.ndarray, g: np.ndarray, edges: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Expected number of each pair of neighbouring tags, the tag before a row (0) included."""
    m = np.exp(transition)
    before = np.zeros(len(f))
    inner = np.ones(len(f), bool)
    inner[edges[:-1][np.diff(edges) > 0]] = False
    before[1:] = f[:-1]
    before[~inner] = 0
    cells = np.stack((m[0, 0] * np.ones(len(f)), m[0, 1] * g, m[1, 0] * before, m[1, 1] * before * g))
    return (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)


def _tags(features: np.ndarray, edges: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Toxic tokens of the sample, from the labels of their documents.

    A feature is counted by the different words before it, so copies of a document add nothing.
    """
    row = np.repeat(np.arange(len(toxic)), np.diff(edges))
    before = np.concatenate(([0], features[:-1, 0])) + 1
    before[edges[:-1][np.diff(edges) > 0]] = 0
    tags = np.zeros(len(features))
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    for k in range(N_FEATURES - 1):
        seen = [np.bincount(np.unique(before[of].astype(np.int64) << 32 | features[of, k]) & 0xFFFFFFFF, minlength=1 << BUCKET_BITS) for of in (toxic[row], ~toxic[row])]
        odds = ((seen[0] + 0.25) / (n_toxic + 0.5)) / ((seen[1] + 0.25) / (n_clean + 0.5))
        marks = (seen[0] >= max(3, MARK_SHARE * n_toxic)) & (odds >= MARK_ODDS)
        tags[marks[features[:, k]]] = 1
    return tags * toxic[row]


def summary(p: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each row: 1, the logit of the highest marginal, and the log of the expected number of toxic tokens.

    Marginals under ``COUNTED`` do not add to that number, so that a long text is not toxic by its length.
    """
    n = len(edges) - 1
    top, total = np.zeros(n), np.zeros(n)
    full = np.diff(edges) > 0
    if full.any():
        top[full] = np.maximum.reduceat(p, edges[:-1][full])
        total[full] = np.add.reduceat(np.where(p >= COUNTED, p, 0.0), edges[:-1][full])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack((np.ones(n), np.log(top / (1 - top)), np.log(total + 0.1)), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    u = np.zeros(x.shape[1])
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
        h = (x * (s * (1 - s))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        u += np.linalg.solve(h, x.T @ (y - s) - ridge * u)
    return u


class Model:
    """Feature weights, transitions, and how marginals make a document's score."""

    def __init__(self):
        self.weights = np.zeros(1 << BUCKET_BITS, np.float32)
        self.bias = -4.0
        self.transition = np.zeros((2, 2))
        self.document = np.array([0.0, 1.0, 0.0])

    def evidence(self, features: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[features].sum(axis=1, dtype=np.float64)

    def score(self, p: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, edges) @ self.document, -30, 30)))


def fit(texts, toxic: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model from an Arrow array of texts and their labels: full-batch steps with a rate for each weight."""
    model = Model()
    _, _, edges, features = tokens(*flat_bytes(texts))
    if not len(features) or toxic.all() or not toxic.any():
        # nothing to tell apart: every text gets the only label seen, or 0
        model.document = np.array([8.0 if len(toxic) and toxic.all() else -8.0, 0.0, 0.0])
        return model
    tags = _tags(features, edges, toxic)
    starts = edges[:-1][np.diff(edges) > 0]
    previous = np.concatenate(([0.0], tags[:-1]))
    previous[starts] = 0
    seen = np.bincount((2 * previous + tags).astype(np.int64), minlength=4).reshape(2, 2)
    used, at = np.unique(features, return_inverse=True)
    at = at.reshape(features.shape)
    weights, squares = np.zeros(len(used)), np.full(len(used), 1e-3)
    bias, bias_square, moved = model.bias, 1e-3, np.full((2, 2), 1e-3)
    for _ in range(rounds):
        p, f, g, _ = marginals(bias + weights[at].sum(axis=1), edges, model.transition)
        gap = tags - p
        grad = sum(np.bincount(at[:, k], weights=gap, minlength=len(used)) for k in range(N_FEATURES)) - 1e-3 * weights
        squares += grad**2
        weights += 0.5 * grad / np.sqrt(squares)
        bias_square += gap.sum() ** 2
        bias += 0.5 * gap.sum() / np.sqrt(bias_square)
        step = seen - pair_counts(f, g, edges, model.transition) - 1e-2 * model.transition
        moved += step**2
        model.transition = model.transition + 0.3 * step / np.sqrt(moved)
    model.bias = float(bias)
    model.weights[used] = weights
    p, *_ = marginals(model.evidence(features), edges, model.transition)
    model.document = _logistic(summary(p, edges), toxic.astype(np.float64))
    return model


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` different texts of each label and ``SAMPLE_TEXT_BYTES`` each, of the training rows.

    The sample is the same at every run: rows come by a hash of their id.
    """
    import pyarrow as pa

    text, label = training_sample(docs, labels, id_col, text_col, label_col, sample_docs, SAMPLE_TEXT_BYTES)
    seen, first = set(), []
    for k, t in enumerate(text.to_pylist()):
        if t not in seen:
            seen.add(t)
            first.append(k)
    return fit(text.take(pa.array(first, pa.int64())), label[np.array(first, np.int64)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, spans`` of each row: the spans are ``[start, end)`` in UTF-8 bytes, of tokens whose marginal reaches one half, joined if adjacent tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(1)) + 64, SLICE_BYTES):
            data, bounds = flat_bytes(batch.column(1))
            starts, ends, edges, features = tokens(data, bounds)
            p, *_ = marginals(model.evidence(features), edges, model.transition)
            s = model.score(p, edges)
            hot = np.flatnonzero(p >= 0.5)
            row = np.searchsorted(edges, hot, side="right") - 1
            found = [[] for _ in range(len(s))]
            last = -2
            for k, r in zip(hot.tolist(), row.tolist()):
                start, end = int(starts[k] - bounds[r]), int(ends[k] - bounds[r])
                if k == last + 1 and found[r]:
                    found[r][-1]["end"] = end
                else:
                    found[r].append({"start": start, "end": end})
                last = k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(found, span_type)],
                names=["doc_id", "score", "predicted", "spans"],
            )

    schema = "doc_id long, score double, predicted int, spans array<struct<start: long, end: long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, all columns unchanged.

    Rows are decided where they are read: nothing is joined or shuffled. Null and empty texts stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(at)) + 64, SLICE_BYTES):
            _, _, edges, features = tokens(*flat_bytes(batch.column(at)))
            p, *_ = marginals(model.evidence(features), edges, model.transition)
            yield batch.filter(pa.array(model.score(p, edges) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Fit on the labelled training rows and score every whole text.

    One row for each row of ``docs``: ``doc_id, held_out, score, predicted, spans``. Null and
    empty texts have no tokens and get the score of a text without toxic ones; a null id is
    not held out. Without labels, or with one label only, all texts get the same score.
    Repeated rows get equal rows. Other columns are not read. An empty table gives an empty
    result.
    """
    model = fit_on(docs, labels, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "spans")
