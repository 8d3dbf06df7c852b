"""Texts of an Arrow batch as flat byte arrays, and hashes of their parts, by numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words after which all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary Arrow array end to end, and the ``n + 1`` bounds of its rows. Nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_sizes(column) -> np.ndarray:
    """Bytes of each row of a string or binary Arrow array."""
    return np.diff(flat_bytes(column)[1])


def byte_words(seed: int) -> np.ndarray:
    """A random 64-bit word for each byte value."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


_WORDS = byte_words(20240229)
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))


HASH_BLOCK = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` mod 2**64."""
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS[:] = [powers(_BASE, n + 1 + (n >> 1)), powers(_INVERSE, n + 1 + (n >> 1))]
    sums = np.zeros(n + 1, U64)
    np.cumsum(_WORDS[data] * _POWERS[0][:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _POWERS[1][starts]
    return mix(raw ^ ((ends - starts).astype(U64) * ODD))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; equal bytes hash alike wherever they stand.

    Starts ascend. Bytes are taken in blocks, so memory follows the longest span, not the text.
    """
    out = np.empty(len(starts), U64)
    k = 0
    while k < len(starts):
        low = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, low + HASH_BLOCK, side="right")))
        high = int(ends[k:stop].max())
        out[k:stop] = _hash_block(data[low:high], starts[k:stop] - low, ends[k:stop] - low)
        k = stop
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], .., starts[i] + lengths[i] - 1`` for each i, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total, dtype=np.int64)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: entry i is ``min(x[i:i + width])``."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:n], out[rest : rest + n])


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def spans(is_word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends`` of runs of true bytes within rows, and the ``n + 1`` bounds of rows among them."""
    first, last = is_word.copy(), is_word.copy()
    if len(is_word) > 1:
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(is_word))]
    first[inner] = is_word[inner]
    last[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)
