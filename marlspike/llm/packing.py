"""Best-fit packing of documents into sequences of fixed capacity, with certified bin counts.

Documents are tokenized once; pieces longer than the capacity are cut, and only what
is shorter than a whole sequence needs packing. Partitions pack their pieces by
best-fit decreasing over counts of equal lengths and compare the number of sequences
with lower bounds from dual-feasible functions. A partition that meets its bound is
certified and done. The others keep their fullest sequences and give the pieces of
those with gaps into an exchange, which deals them to fewer partitions and packs them
again, as long as that brings the number of sequences nearer to the bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import batches_by_bytes, written
from .textvec import flat_bytes, row_sizes

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
SLICE_BYTES = 2 << 20
#: Pieces that one task packs; their ids and lengths are all it holds.
PARTITION_PIECES = 20_000
#: Packings in all; exchanges end before it where they gain nothing.
ROUNDS = 12
#: Of an uncertified partition, sequences filled to this share of the capacity stay packed.
KEEP_FILL = 0.995
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLACED = "row long, piece int, sequence_id long, offset long"


class TokenIds:
    """Token ids of texts as the ``tokenizers`` file ``name`` gives them without special tokens.

    The same vocabulary's rank file is several times faster to apply, and is used for
    texts whose characters are all in ``AGREED``, where both give the same ids (each
    character of the range is tested). Other texts go through the ``tokenizers`` file.
    """

    AGREED = 0x2000

    def __init__(self, name: str = TOKENIZER):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str, agreed: bool) -> list[int]:
        if not agreed or "<|" in text:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    @classmethod
    def agreed(cls, column) -> list[bool]:
        """For each text of an Arrow array, whether all its characters are below ``AGREED``, by the first byte of their UTF-8."""
        data, bounds = flat_bytes(column)
        high = np.flatnonzero(data >= chr(cls.AGREED).encode()[0])
        return (np.searchsorted(high, bounds[1:]) == np.searchsorted(high, bounds[:-1])).tolist()


_HELD: dict[str, TokenIds] = {}


def token_ids(name: str) -> TokenIds:
    if name not in _HELD:
        _HELD[name] = TokenIds(name)
    return _HELD[name]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole sequences, and a first piece of what is over."""
    over = n % capacity
    return [over] * (over > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, row, piece, start, length, ids_crc32`` of each piece; ``row`` numbers the rows of ``docs``."""

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encode = token_ids(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(1)) + 64, SLICE_BYTES):
            out = []
            for doc_id, text, agreed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode.agreed(batch.column(1))):
                ids = np.array([*encode(text or "", agreed), end_id], "<u4")
                start = 0
                for k, length in enumerate(cut_lengths(len(ids), capacity)):
                    out.append((doc_id, number, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start += length
                number += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do without.

    For each threshold t up to half the capacity, items above ``capacity - t`` count as a
    whole sequence, those from t on by their length, smaller ones as nothing; and for each
    k, items count by how many k-ths of the capacity they exceed. Both are dual feasible.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    mass, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    full = number[-1] - number[capacity - t]
    middle = mass[capacity - t] - mass[t - 1]
    best = max(best, int((full + -(-middle // capacity)).max()))
    for k in range(2, 21):
        # the superadditive step function: multiples of capacity / (k + 1) count by themselves, others round down
        exact = size * (k + 1) % capacity == 0
        value = np.where(exact, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``bin, offset`` of each item and the number of bins.

    Items come by falling length; each goes to the fullest bin that has room. Bins are
    kept in stacks by room left, and a bit set tells which stacks are not empty.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n_bins = 0, 0
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fits = open_ >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                open_ &= ~(1 << room)
        else:
            room, own, n_bins = capacity, n_bins, n_bins + 1
        bins[item], offsets[item] = own, capacity - room
        room -= length
        stacks[room].append(own)
        open_ |= 1 << room
    return bins, offsets, n_bins


PACKED = "row long, piece int, length long, sequence_id long, offset long, given boolean, part long, part_sequences long, part_bound long"


def _packing(capacity: int, keep_fill: float):
    """Pack one partition, and mark the pieces that it would give to an exchange; with its number of sequences and their bound."""

    def run(key, table):
        import pyarrow as pa

        row, piece, length = (table.column(k).to_numpy() for k in ("row", "piece", "length"))
        by = np.lexsort((piece, row))
        row, piece, length = row[by], piece[by], length[by]
        bins, offsets, n_bins = best_fit_decreasing(length, capacity)
        part, bound = key[0].as_py(), lower_bound(length, capacity)
        given = np.zeros(len(row), bool)
        if n_bins > bound:
            fill = np.bincount(bins, weights=length, minlength=n_bins)
            given = fill[bins] < keep_fill * capacity
        same = lambda x: pa.array(np.full(len(row), x, np.int64))
        return pa.table(
            {
                "row": pa.array(row, pa.int64()),
                "piece": pa.array(piece, pa.int32()),
                "length": pa.array(length, pa.int64()),
                "sequence_id": pa.array(bins + (part << 32), pa.int64()),
                "offset": pa.array(offsets, pa.int64()),
                "given": pa.array(given),
                "part": same(part),
                "part_sequences": same(n_bins),
                "part_bound": same(bound),
            }
        )

    return run


def pack(open_: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, keep_fill: float = KEEP_FILL, rounds: int = ROUNDS) -> DataFrame:
    """``row, piece, sequence_id, offset, part_sequences, part_bound`` for each ``row, piece, length`` of ``open_``, all shorter than ``capacity``.

    The last two tell of the partition that placed a piece how many sequences it made and how
    many no packing of its pieces can do without; it is certified where they are equal.
    """
    open_ = open_.select("row", "piece", "length")
    result = ["row", "piece", "sequence_id", "offset", "part_sequences", "part_bound"]
    done, missing = None, None
    for level in range(rounds):
        parts = max(1, -(-open_.count() // partition_pieces))
        number = F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(parts)) + (level << 24)
        packed = open_.withColumn("part", number).groupBy("part").applyInArrow(_packing(capacity, keep_fill), PACKED)
        packed = written(packed, "packed")
        # sequences above the bounds, a number for each partition
        tally = packed.groupBy("part").agg(F.first("part_sequences").alias("n"), F.first("part_bound").alias("least"))
        gap = tally.agg(F.coalesce(F.sum(F.col("n") - F.col("least")), F.lit(0))).first()[0]
        last = gap == 0 or parts == 1 or level == rounds - 1 or (missing is not None and gap >= missing)
        placed = (packed if last else packed.filter("not given")).select(result)
        done = placed if done is None else done.union(placed)
        if last:
            break
        missing = gap
        open_ = packed.filter("given").select("row", "piece", "length")
    return done


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str = TOKENIZER,
    partition_pieces: int = PARTITION_PIECES,
) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_sequences, part_bound``.

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone.
    Documents longer than ``capacity`` are cut into pieces of ``capacity`` ids after a first
    shorter one; others stay whole. Pieces of a sequence follow each other without gaps
    from 0. ``part_sequences`` and ``part_bound`` are those of ``pack``; a piece as long as a
    sequence is a partition of its own. Null and repeated ids are kept as they are; each row of ``docs`` is a document.
    Other columns are not read. An empty table gives an empty result.
    """
    cut = written(pieces(docs, id_col, text_col, capacity, end_id, tokenizer), "pieces")
    placed = pack(cut.filter(F.col("length") < capacity), capacity, partition_pieces)
    whole = F.col("length") == capacity
    # sequences of one whole piece are numbered below zero
    own = -1 - F.monotonically_increasing_id()
    return (
        cut.filter(~whole)
        .join(placed, ["row", "piece"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_sequences", "part_bound")
        .union(cut.filter(whole).select("doc_id", "piece", "start", "length", "ids_crc32", own.alias("sequence_id"), *[F.lit(x).cast("long") for x in (0, 1, 1)]))
    )
