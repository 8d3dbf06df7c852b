"""Exact deduplication by Grace hashing.

Two passes with the same table. The first runs on each input partition as it is
read and keeps one record for each content with its largest id and its count, so
that a content which fills a third of the corpus crosses the network once a
partition. The second runs after those records are dealt out by digest. Each pass
streams its rows into an open-addressing table; once the table's contents exceed
``memory_bytes``, rows are dealt to spill files by further digest bits and each
file is treated alike, down to files that fit.

The table compares complete contents: equal hashes only pick the slot to look in.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MEMORY_BYTES = 64 << 20
FAN_OUT = 16
MAX_DEPTH = 12
ROW_COST = 160

_REPRESENTATIVE = T.StructType(
    [
        T.StructField("sha", T.BinaryType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("top_id", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
_GROUP = T.StructType(
    [
        T.StructField("sha", T.BinaryType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
    ]
)


def larger(a: int | None, b: int | None) -> int | None:
    """The larger id; a null id counts as smaller than all others."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b)


class ContentTable:
    """Open addressing with linear probing; a slot names an entry, an entry holds its whole content."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.entries: list[list] = []
        self.used_bytes = 0

    def add(self, sha: bytes, content: bytes, top_id: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(sha[24:32], "little") & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == sha and entry[1] == content:
                entry[2] = larger(entry[2], top_id)
                entry[3] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([sha, content, top_id, n])
        self.used_bytes += len(content) + ROW_COST
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][24:32], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


class SpillFiles:
    """``FAN_OUT`` files in the task's own temporary folder, each of pickled rows."""

    def __init__(self, depth: int):
        self.depth = depth
        self.folder = tempfile.mkdtemp(prefix="grace-")
        self.files = [open(os.path.join(self.folder, str(k)), "wb", 1 << 16) for k in range(FAN_OUT)]

    def add(self, row: tuple) -> None:
        bits = int.from_bytes(row[0][:8], "little") >> (4 * self.depth)
        pickle.dump(row, self.files[bits % FAN_OUT], pickle.HIGHEST_PROTOCOL)

    def buckets(self) -> Iterator[Iterator[tuple]]:
        for file in self.files:
            file.close()
        for k in range(FAN_OUT):
            path = os.path.join(self.folder, str(k))
            yield self._rows(path)
            os.unlink(path)

    @staticmethod
    def _rows(path: str) -> Iterator[tuple]:
        with open(path, "rb", 1 << 16) as file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

    def close(self) -> None:
        for file in self.files:
            file.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def grace(rows: Iterable[tuple], memory_bytes: int = MEMORY_BYTES, depth: int = 0) -> Iterator[list]:
    """``[sha, content, top_id, n]`` once for each content in ``rows`` of the same shape.

    A bucket that no longer splits (one digest, or ``MAX_DEPTH``) is held whole.
    """
    table, spill = ContentTable(), None
    try:
        for row in rows:
            if spill is not None:
                spill.add(row)
                continue
            table.add(*row)
            if table.used_bytes > memory_bytes and depth < MAX_DEPTH and len(table.entries) > 1:
                spill = SpillFiles(depth)
                for entry in table.entries:
                    spill.add(tuple(entry))
                table = ContentTable()
        if spill is None:
            yield from table.entries
            return
        for bucket in spill.buckets():
            yield from grace(bucket, memory_bytes, depth + 1)
    finally:
        if spill is not None:
            spill.close()


def _chunks(entries: Iterable[list], schema, columns, limit: int = 8 << 20):
    """Entries as Arrow record batches of bounded size."""
    import pyarrow as pa

    held, used = [], 0
    for entry in entries:
        held.append(entry)
        used += len(entry[1]) + 64
        if used >= limit:
            yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in held], f.type) for c, f in zip(columns, schema)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in held], f.type) for c, f in zip(columns, schema)], schema=schema)


def _local_pass(memory_bytes: int):
    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    raw = text.as_buffer()
                    content = (raw.to_pybytes() if raw is not None else b"").lower()
                    yield hashlib.sha256(content).digest(), content, doc_id.as_py(), 1

        schema = pa.schema([("sha", pa.binary()), ("content", pa.binary()), ("top_id", pa.int64()), ("n", pa.int64())])
        yield from _chunks(grace(rows(), memory_bytes), schema, (0, 1, 2, 3))

    return run


def _global_pass(memory_bytes: int):
    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                for sha, content, top_id, n in zip(*batch.columns):
                    yield sha.as_py(), content.as_py(), top_id.as_py(), n.as_py()

        schema = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
        yield from _chunks(grace(rows(), memory_bytes), schema, (0, 2, 3))

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row for each different content: ``sha`` (binary), ``keep_id``, ``group_size``."""
    local = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_local_pass(memory_bytes), _REPRESENTATIVE)
    dealt = local.repartition("sha")
    return dealt.mapInArrow(_global_pass(memory_bytes), _GROUP)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row
    with the largest id stays. Null text counts as empty; a null id is smaller than
    any other, so it stays only if its whole group has null ids. Rows that repeat
    an id and its text all count in ``group_size`` and are all ``kept`` when that id
    stays (they cannot be told apart). Other columns of ``docs`` are not read, so
    their names cannot clash. An empty table gives an empty result.

    A digest shared by two different contents would make a row appear twice;
    ``keep_id`` still refers to equal contents only.
    """
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    members = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("sha"))
    groups = exact_groups(docs, id_col, text_col, memory_bytes)
    return members.join(groups, "sha", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each different content, all columns unchanged.

    Of rows that repeat both id and content one stays, and so does one row of a content whose
    ids are all null. Columns may have any names. An empty table gives an empty result.
    """
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    keep = exact_groups(docs, id_col, text_col).select("sha", "keep_id")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("sha"), F.col(id_col).cast("long").alias("keep_id"))
    stays = tagged.alias("d").join(keep.alias("k"), (F.col("d.sha") == F.col("k.sha")) & F.col("d.keep_id").eqNullSafe(F.col("k.keep_id")), "left_semi")
    return stays.dropDuplicates(["sha", "keep_id"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
