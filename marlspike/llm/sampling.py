"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text becomes a mark for a space, then itself with spaces as marks. No piece has a mark
after other characters, so the lattice falls apart into units: marks and what follows up to
the next ones. Units that occur often are the same lattice; each different one of a batch is
filtered once, by vectors over all of them: edges are found by hashes of substrings, and
forward sums advance through all units together. Backward, each occurrence draws its pieces
by numbers made from the row's key and the place, so a row is segmented alike wherever and
whenever it is processed. A unit of more than ``LONG_UNIT`` bytes, as text without spaces has them, is filtered
by itself, a block of nodes at a time, which takes time in proportion to it and keeps one number a node. Characters without a piece become their UTF-8 bytes' pieces, and so
does the mark's own character, so decoding gives the text back byte by byte.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batches_by_bytes
from .textvec import U64, flat_bytes, mix, powers, ragged, row_sizes, span_hashes

MODEL = "piece_bpe_32k.model"
#: A piece of merge rank r has the weight ``(r + 2) ** -ALPHA``.
ALPHA = 1.0
SEED = 20240501
SLICE_BYTES = 1 << 20
LONG_UNIT = 1024
NODE_BLOCK = 1 << 14
MARK = 0x2581
RAW = 0x110000  # symbols from here on are bytes
_FILTER_BITS = 22


class Pieces:
    """The pieces of a model: hashes for finding them, weights, and bytes for decoding."""

    def __init__(self, model_file: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        texts, ids, self.raw_id = [], [], np.zeros(256, np.int64)
        spelled = []
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.raw_id[int(piece[3:5], 16)] = k
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(chr(MARK), " ").encode())
                texts.append(piece)
                ids.append(k)
        self.longest = max(map(len, texts))
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
        lengths = np.array([len(c) for c in codes])
        flat = np.concatenate(codes)
        heads = np.cumsum(lengths) - lengths
        keys = substring_hashes(flat, heads, lengths)
        by = np.argsort(keys)
        self.keys, self.ids = keys[by], np.array(ids)[by]
        scores = np.array([model.get_score(int(k)) for k in self.ids])
        self.weights = -alpha * np.log(2.0 + np.maximum(0.0, -scores))
        self.raw_weight = -alpha * np.log(2.0 + n)
        self.single = np.unique(flat[heads[lengths == 1]])
        self.may_be = np.zeros(1 << _FILTER_BITS, bool)
        self.may_be[(self.keys & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_lengths = np.array([len(s) for s in spelled], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are pieces, and where in ``ids`` and ``weights`` they stand."""
        k = np.flatnonzero(self.may_be[(keys & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[k]), len(self.keys) - 1)
        hit = self.keys[at] == keys[k]
        return k[hit], at[hit]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` end to end, before the first mark of each text is dropped."""
        return self.bytes[ragged(self.byte_starts[ids], self.byte_lengths[ids])]


_BASE = U64(0xA0761D6478BD642F)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * powers(_BASE, len(codes)), out=sums[1:])
    return sums, powers(_INVERSE, len(codes) + 1)


def substring_hashes(codes: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    sums, inverse = _sums(codes)
    return mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + np.asarray(lengths).astype(U64))


def _symbols(data: bytes, bounds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the units, marks for spaces, bytes for characters without a piece; and the units' bounds among them."""
    raw = np.frombuffer(data, np.uint8)
    try:
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
    except UnicodeDecodeError:
        codes, at = np.where(raw < 128, raw, -1).astype(np.int64), np.arange(len(raw))
    known = np.isin(codes, pieces.single) & (codes != MARK)
    codes = np.where(codes == 32, MARK, codes)
    known |= (codes == MARK) & (raw[at] == 32)
    width = np.diff(np.append(at, len(raw)))
    count = np.where(known, 1, width)
    out = np.repeat(codes, count)
    unknown = np.repeat(~known, count)
    out[unknown] = raw[ragged(at[~known], width[~known])].astype(np.int64) + RAW
    edges = np.concatenate(([0], np.cumsum(count)))
    return out, edges[np.searchsorted(at, bounds)]


class Lattice:
    """Edges of all units by their end, each with the cumulated chance of coming from it."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, pieces: Pieces):
        n_units = len(bounds) - 1
        unit = np.repeat(np.arange(n_units), np.diff(bounds))
        # a unit of m symbols has m + 1 nodes; node 0 has no edges
        first = bounds[:-1] + np.arange(n_units)
        self.last = bounds[1:] + np.arange(n_units)
        here = np.arange(len(codes)) + unit
        left = bounds[1:][unit] - np.arange(len(codes))
        raw = np.flatnonzero(codes >= RAW)
        start, stop, ids, weight = [here[raw]], [here[raw] + 1], [pieces.raw_id[codes[raw] - RAW]], [np.full(len(raw), pieces.raw_weight)]
        sums, inverse = _sums(codes)
        at = np.flatnonzero(codes < RAW)
        for length in range(1, pieces.longest + 1):
            at = at[left[at] >= length]
            if not len(at):
                break
            k, found = pieces.find(mix((sums[at + length] - sums[at]) * inverse[at] + U64(length)))
            start.append(here[at[k]])
            stop.append(here[at[k]] + length)
            ids.append(pieces.ids[found])
            weight.append(pieces.weights[found])
        start, stop, ids, weight = (np.concatenate(x) for x in (start, stop, ids, weight))
        depth = stop - first[np.searchsorted(first, stop, side="right") - 1]
        by = np.lexsort((stop, depth))
        start, stop, ids, weight, depth = start[by], stop[by], ids[by], weight[by], depth[by]
        forward = np.zeros(len(codes) + n_units)
        chance = np.empty(len(start))
        cuts = np.searchsorted(depth, np.arange(1, int(depth.max()) + 2)) if len(depth) else []
        for low, high in zip(cuts[:-1], cuts[1:]):
            end = stop[low:high]
            heads = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            sizes = np.diff(np.append(heads, high - low))
            value = forward[start[low:high]] + weight[low:high]
            top = np.maximum.reduceat(value, heads)
            share = np.exp(value - np.repeat(top, sizes))
            total = np.add.reduceat(share, heads)
            forward[end[heads]] = top + np.log(total)
            running = np.cumsum(share / np.repeat(total, sizes))
            running -= np.repeat(np.concatenate(([0.0], running[heads[1:] - 1])), sizes)
            running[np.append(heads[1:], high - low) - 1] = 1.0
            chance[low:high] = np.minimum(running, 1.0)
        by = np.argsort(stop, kind="stable")
        self.start, self.ids = start[by], ids[by]
        self.limit = stop[by] + chance[by]
        self.first = first

    def draw(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of each occurrence of ``units``, end to end, and how many each has."""
        node, goal = self.last[units].copy(), self.first[units]
        count = np.zeros(len(units), np.int64)
        live = np.flatnonzero(node > goal)
        drawn = []
        step = 0
        while len(live):
            u = _uniform(keys[live], np.array([step]))
            edge = np.searchsorted(self.limit, node[live] + np.minimum(u, 1 - 1e-9), side="right")
            drawn.append((live, self.ids[edge]))
            node[live] = self.start[edge]
            count[live] += 1
            live = live[node[live] > goal[live]]
            step += 1
        stops = np.cumsum(count)
        out = np.zeros(int(stops[-1]) if len(stops) else 0, np.int64)
        for k, (who, ids) in enumerate(drawn):
            out[stops[who] - 1 - k] = ids
        return out, count


def _uniform(keys: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each key and step."""
    return (mix(keys + steps.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) * 2.0**-53


class LongUnit:
    """The lattice of one long unit: the forward sum of each node; edges are found again where they are needed."""

    def __init__(self, codes: np.ndarray, pieces: Pieces):
        self.codes, self.pieces = codes, pieces
        self.forward = array("d", [0.0])
        for block in range(-(-len(codes) // NODE_BLOCK)):
            starts, weights, _, heads = self._edges(block)
            for a, b in zip(heads, heads[1:]):
                if b - a == 1:
                    self.forward.append(self.forward[starts[a]] + weights[a])
                    continue
                values = [self.forward[starts[k]] + weights[k] for k in range(a, b)]
                top = max(values)
                self.forward.append(top + math.log(sum([math.exp(v - top) for v in values])))

    def _edges(self, block: int) -> tuple[list, list, list, list]:
        """``starts, weights, ids`` of the edges into the nodes of a block, by node, and the nodes' bounds among them."""
        low, high = block * NODE_BLOCK, min((block + 1) * NODE_BLOCK, len(self.codes))
        base = max(0, low - self.pieces.longest)
        codes = self.codes[base:high]
        raw = np.flatnonzero(codes[low - base :] >= RAW) + low - base
        start, stop, ids, weight = [raw], [raw + 1], [self.pieces.raw_id[codes[raw] - RAW]], [np.full(len(raw), self.pieces.raw_weight)]
        sums, inverse = _sums(codes)
        for length in range(1, self.pieces.longest + 1):
            at = np.arange(max(0, low - base - length + 1), max(0, high - base - length + 1))
            k, found = self.pieces.find(mix((sums[at + length] - sums[at]) * inverse[at] + U64(length)))
            start.append(at[k])
            stop.append(at[k] + length)
            ids.append(self.pieces.ids[found])
            weight.append(self.pieces.weights[found])
        start, stop, ids, weight = (np.concatenate(x) for x in (start, stop, ids, weight))
        by = np.argsort(stop, kind="stable")
        heads = np.searchsorted(stop[by], np.arange(low - base + 1, high - base + 2))
        return (start[by] + base).tolist(), weight[by].tolist(), ids[by].tolist(), heads.tolist()

    def draw(self, key: np.uint64) -> np.ndarray:
        """The piece ids of one occurrence."""
        node, out, block, drawn = len(self.codes), array("q"), -1, []
        while node:
            if (node - 1) // NODE_BLOCK != block:
                block = (node - 1) // NODE_BLOCK
                starts, weights, ids, heads = self._edges(block)
            if not len(out) % NODE_BLOCK:
                drawn = _uniform(key, np.arange(len(out), len(out) + NODE_BLOCK)).tolist()
            at = node - 1 - block * NODE_BLOCK
            left, total, edge = drawn[len(out) % NODE_BLOCK], self.forward[node], heads[at]
            for edge in range(heads[at], heads[at + 1]):
                left -= math.exp(self.forward[starts[edge]] + weights[edge] - total)
                if left < 0:
                    break
            out.append(ids[edge])
            node = starts[edge]
        return np.frombuffer(out, np.int64)[::-1]


def encode_batch(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, pieces: Pieces, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all rows end to end, and the rows' bounds among them. Empty rows have none."""
    lengths = np.diff(bounds)
    full = lengths > 0
    new_bounds = np.concatenate(([0], np.cumsum(lengths + full)))
    text = np.full(int(new_bounds[-1]), 32, np.uint8)
    text[ragged(new_bounds[:-1] + full, lengths)] = data
    space = text == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[new_bounds[:-1][full]] = True
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    ends = np.append(starts[1:], len(text))
    _, one, unit = np.unique(span_hashes(text, starts, ends), return_index=True, return_inverse=True)
    size = ends[one] - starts[one]
    row = np.searchsorted(new_bounds, starts, side="right") - 1
    place = (starts - new_bounds[row]).astype(U64)
    keys = mix(mix(keys[row].astype(np.int64).view(U64) ^ U64(seed)) + place * U64(0xD6E8FEB86659FD93))

    is_long = size > LONG_UNIT
    short = np.flatnonzero(~is_long)
    number = np.zeros(len(size), np.int64)
    number[short] = np.arange(len(short))
    parts = []
    if len(short):
        body = text[ragged(starts[one[short]], size[short])].tobytes()
        codes, unit_bounds = _symbols(body, np.concatenate(([0], np.cumsum(size[short]))), pieces)
        own = np.flatnonzero(~is_long[unit])
        parts.append((own, *Lattice(codes, unit_bounds, pieces).draw(number[unit[own]], keys[own])))
    for k in np.flatnonzero(is_long):
        at = starts[one[k]]
        held = LongUnit(_symbols(text[at : at + size[k]].tobytes(), np.array([0, size[k]]), pieces)[0], pieces)
        for own in np.flatnonzero(unit == k):
            drawn = held.draw(keys[own])
            parts.append((np.array([own]), drawn, np.array([len(drawn)])))
    count = np.zeros(len(unit), np.int64)
    for own, _, n in parts:
        count[own] = n
    by_row = np.concatenate(([0], np.cumsum(count)))
    ids = np.zeros(int(by_row[-1]), np.int64)
    for own, drawn, n in parts:
        ids[ragged(by_row[own], n)] = drawn
    return ids, by_row[np.searchsorted(starts, new_bounds)]


_HELD: dict[tuple, Pieces] = {}


def pieces_of(model: str, alpha: float) -> Pieces:
    if (model, alpha) not in _HELD:
        import public_tokenizers

        _HELD[model, alpha] = Pieces(public_tokenizers.path(model), alpha)
    return _HELD[model, alpha]


def sampled_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_pieces, ids_crc32, decoded_sha256, lossless`` and, ``with_ids``, ``ids``.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit numbers. ``decoded_sha256`` is
    of the bytes that the ids decode to; ``lossless`` tells whether these are the text's. Null
    and empty texts have no pieces. A null id counts as the key 0; rows of equal key and text
    have equal pieces. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa

        pieces = pieces_of(model, alpha)
        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(1)) + 64, SLICE_BYTES):
            data, bounds = flat_bytes(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy()
            ids, edges = encode_batch(data, bounds, keys, pieces, seed)
            made = pieces.decode(ids)
            at = np.concatenate(([0], np.cumsum(pieces.byte_lengths[ids])))[edges]
            raw = ids.astype("<u4")
            out = []
            for k in range(batch.num_rows):
                back = made[at[k] : at[k + 1]][1:]
                out.append((edges[k + 1] - edges[k], zlib.crc32(raw[edges[k] : edges[k + 1]].tobytes()), hashlib.sha256(back.tobytes()).hexdigest(), bool(np.array_equal(back, data[bounds[k] : bounds[k + 1]]))))
            columns = [batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.bool_())))]
            names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decoded(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of each row of piece ids. Null and empty ids are an empty text."""

    def run(batches):
        import pyarrow as pa

        pieces = pieces_of(model, ALPHA)
        for batch in batches_by_bytes(batches, lambda b: 8 * b.column(1).value_lengths().fill_null(0).to_numpy(), 4 * SLICE_BYTES):
            text = [pieces.decode(np.array(ids or (), np.int64))[1:].tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
