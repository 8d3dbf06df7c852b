"""Removal of repeated passages, by suffix arrays over shards of the corpus.

A passage is any string of ``LENGTH`` bytes of one document. It repeats if the same
string starts earlier: in a document of smaller id, or earlier in the same document.

To find all repeats without sorting the corpus in one place, every passage is routed
by a word of its own text: the ``WORD``-byte substring of least hash within it. Equal
passages have equal least words, so they meet in one shard. Neighbouring passages
mostly share their least word and travel as one stretch.

1. Documents are packed into compressed chunks, the unit of all later steps.
2. Each chunk reports its least words; words that several chunks report, or that occur
   twice in one, are the only ones that can carry a repeat.
3. Each chunk sends its stretches with such words to their shards, each different
   content once, with its earliest place; later copies in the chunk repeat wholly. A word
   with more text around it than a suffix array takes is hot: its passages are dealt anew
   by their least ``WIDE``-byte word, so they part wherever their surroundings differ.
4. A shard builds a suffix array of its contents by induced sorting, with permuted
   common prefixes, and finds each passage's earliest place.
5. What repeats goes back to its chunk, which removes the bytes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .suffix_array import permuted_prefixes, suffix_array
from .tables import batches_by_bytes, drop_written, written
from .textvec import U64, flat_bytes, mix, ragged, row_sizes, window_min

LENGTH = 100
WORD = 32
WIDE = 88
CHUNK_BYTES = 2 << 20
#: Bytes of text whose least words one task compares.
WORD_SHARE = 32 << 20
#: Bytes of stretches in a shard, and in one suffix array.
SHARD_BYTES = 4 << 20
ARRAY_BYTES = 1 << 20
#: Words with more bytes of stretches than this are hot.
HOT_BYTES = 4 << 20
#: Shards for each task that reads them, as long as these are no more than MAX_TASKS.
TASK_SHARDS = 1
MAX_TASKS = 50_000
#: Up to so many regions of hot words in a chunk are looked at one by one.
REGIONS = 300
#: Beyond so many chunks, equal contents are merged in groups of chunks before they meet in a shard.
MERGE_CHUNKS = 4096

CHUNK = "chunk long, n_bytes long, ids binary, bounds binary, body binary, rest binary"
PLACED = np.dtype([("doc", "<i8"), ("chunk", "<i8"), ("start", "<i4"), ("row", "<i4"), ("length", "<u2"), ("twice", "<u2"), ("word", "<u8")])
SPAN = np.dtype([("row", "<i4"), ("start", "<i8"), ("stop", "<i8")])


@functools.cache
def _packer(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor()


def _zip(data, level: int = 3) -> bytes:
    return _packer(level).compress(bytes(data))


def _unzip(data: bytes) -> bytes:
    return _unpacker().decompress(data)


def _rows(names: list[str], types: list, rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` packed into rows of about ``CHUNK_BYTES`` of text; null texts are empty, null ids sort last.

    ``rest`` has the columns ``carry`` of the rows, and which texts are null, as an Arrow stream.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(1)) + 64, CHUNK_BYTES):
            data, bounds = flat_bytes(batch.column(1))
            ids = np.full(batch.num_rows, np.iinfo(np.int64).max)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids[known] = batch.column(0).drop_null().to_numpy()
            held = np.concatenate((ids, known.astype(np.int64)))
            rest = b""
            if carry:
                sink = pa.BufferOutputStream()
                own = pa.RecordBatch.from_arrays([batch.column(2), batch.column(1).is_null()], names=["rest", "null"])
                with pa.ipc.new_stream(sink, own.schema) as stream:
                    stream.write_batch(own)
                rest = _zip(sink.getvalue())
            row = (number, len(data), held.tobytes(), bounds.tobytes(), _zip(data, 5), rest)
            yield _rows(["chunk", "n_bytes", "ids", "bounds", "body", "rest"], [pa.int64(), pa.int64(), *[pa.binary()] * 4], [row])
            number += 1

    own = [F.struct(*[F.col(f"`{c}`") for c in carry])] if carry else []
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *own).mapInArrow(run, CHUNK)


class Chunk:
    def __init__(self, ids: bytes, bounds: bytes, body: bytes):
        held = np.frombuffer(ids, np.int64)
        self.ids, self.known = held[: len(held) // 2], held[len(held) // 2 :] > 0
        self.bounds = np.frombuffer(bounds, np.int64)
        self.data = np.frombuffer(_unzip(body), np.uint8)

    def stretches(self, length: int, width: int = WORD):
        """``starts, stops, rows, words, twice``: passages that start in ``[start, stop)`` have the least word ``word`` of ``width`` bytes.

        ``twice``: that word stands at several places in them, so they may repeat among themselves.
        """
        found = [_stretches(self.data[a : b + length - 1], length, a, width) for a, b in self._blocks(length)]
        none = np.zeros(0, np.int64)
        starts, stops, words, twice = (np.concatenate(x) for x in zip(*found)) if found else (none, none, none.astype(U64), none > 0)
        # passages stay within their document
        row = np.searchsorted(self.bounds, starts, side="right") - 1
        limit = self.bounds[row + 1] - length + 1
        cross = np.flatnonzero(stops > limit)
        next_starts, next_rows = [], []
        inside = np.flatnonzero(starts < limit)
        for k in cross:
            for r in range(row[k] + 1, len(self.bounds) - 1):
                if self.bounds[r] >= stops[k]:
                    break
                next_starts.append(k)
                next_rows.append(r)
        k = np.concatenate((inside, np.array(next_starts, np.int64)))
        r = np.concatenate((row[inside], np.array(next_rows, np.int64)))
        s = np.maximum(starts[k], self.bounds[r])
        e = np.minimum(stops[k], self.bounds[r + 1] - length + 1)
        keep = s < e
        k = k[keep]
        return s[keep], e[keep], r[keep], words[k], twice[k]

    def dealt_anew(self, stretches: tuple, hot: np.ndarray, length: int) -> tuple:
        """``stretches`` with those of the words ``hot`` cut by wide words, which take the words' place."""
        is_hot = np.isin(stretches[3], hot)
        if not is_hot.any():
            return stretches
        s, e, r = (x[is_hot] for x in stretches[:3])
        by = np.argsort(s, kind="stable")
        s, e, r = s[by], e[by], r[by]
        # neighbours are one region, whose wide words are looked for at once
        head = np.flatnonzero(np.append(True, (s[1:] > e[:-1]) | (r[1:] != r[:-1])))
        regions = zip(s[head].tolist(), e[np.append(head[1:], len(s)) - 1].tolist())
        if len(head) <= REGIONS:
            found = [_stretches(self.data[a : b + length - 1], length, a, WIDE) for a, b in regions]
            starts, stops, words, twice = (np.concatenate(x) for x in zip(*found))
        else:
            wide = self.stretches(length, WIDE)
            by = np.argsort(wide[0], kind="stable")
            starts, stops, _, words, twice = (x[by] for x in wide)
        low, high = np.searchsorted(starts, s, side="right") - 1, np.searchsorted(starts, e, side="left")
        k, owner = ragged(low, high - low), np.repeat(np.arange(len(s)), high - low)
        cut = (np.maximum(starts[k], s[owner]), np.minimum(stops[k], e[owner]), r[owner], mix(words[k] + U64(WIDE)), twice[k])
        return tuple(np.concatenate((x[~is_hot], y)) for x, y in zip(stretches, cut))

    def _blocks(self, length: int):
        last = len(self.data) - length + 1
        for a in range(0, last, CHUNK_BYTES):
            yield a, min(a + CHUNK_BYTES, last)


def _stretches(data: np.ndarray, length: int, base: int, size: int):
    """Stretches of ``data``, whose every position up to its last ``length - 1`` starts a passage."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words).view(np.uint64)[:, 0]
    n = len(data) - size + 1
    h = np.zeros(n, U64)
    for k in range(size // 8):
        h += words[8 * k : 8 * k + n] * U64(pow(0x9E3779B97F4A7C15, k + 1, 2**64))
    h = mix(h)
    least = window_min(h, length - size + 1)
    # where the least word stands: its first place at or after the passage's start
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    # a least word that leaves the passage while an equal one follows keeps the stretch going
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(least))
    long_ = stops - starts > 4 * length
    if long_.any():
        # a word that repeats without end is cut, so contents stay short and repeat among themselves
        parts = np.where(long_, -(-(stops - starts) // (2 * length)), 1)
        heads = np.repeat(starts, parts)
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.minimum(np.repeat(stops, parts), heads + (step + 1) * 2 * length)
        starts, stops = heads + step * 2 * length, np.where(np.repeat(long_, parts), ends, np.repeat(stops, parts))
    # all places of least words, and how many of them a stretch has with its own word
    width = length - size + 1
    reach = ~window_min(~np.concatenate((np.full(width - 1, least[0]), least, np.full(width - 1, least[-1]))), width)
    places = np.flatnonzero(h == reach)
    low, high = np.searchsorted(places, starts), np.searchsorted(places, stops + width - 1)
    own = np.repeat(least[starts], high - low) == h[places[ragged(low, high - low)]]
    total = np.concatenate(([0], np.cumsum(own)))
    edge = np.concatenate(([0], np.cumsum(high - low)))
    twice = total[edge[1:]] - total[edge[:-1]] > 1
    return starts + base, stops + base, least[starts], twice


def _word_reports(length: int, shares: int):
    """For each share of the words, those of a chunk and, up to 65,535, the numbers of their stretches."""

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for row in zip(*batch.columns):
                chunk, ids, bounds, body = (x.as_py() for x in row)
                words, n = np.unique(Chunk(ids, bounds, body).stretches(length)[3], return_counts=True)
                share = (words % U64(shares)).astype(np.int64)
                by = np.argsort(share, kind="stable")
                words, n, share = words[by], np.minimum(n[by], 0xFFFF).astype("<u2"), share[by]
                cut = np.append(np.flatnonzero(np.diff(share, prepend=-1)), len(by))
                if len(words):
                    yield _rows(["share", "chunk", "words", "counts"], types, [(int(share[a]), chunk, words[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])])

    return run


def _common_words(length: int):
    """Of one share, the words that more than one chunk reports, by chunk, and which of them are hot."""

    def run(table):
        import pyarrow as pa

        reports = [np.frombuffer(x.as_py(), U64) for x in table.column("words")]
        held = np.concatenate(reports)
        n = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("counts")]).astype(np.int64)
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in reports])
        words, group, count = np.unique(held, return_inverse=True, return_counts=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, group, n)
        is_hot = (total * (length + length // 3) > HOT_BYTES)[group]
        common = (count[group] > 1) | is_hot
        held, n, chunk, is_hot = held[common], n[common], chunk[common], is_hot[common]
        by = np.argsort(chunk, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(chunk[by], prepend=-1)), len(by))
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            k = by[a:b]
            rows.append((int(chunk[k[0]]), int(n[k].sum()), held[k].tobytes(), held[k[is_hot[k]]].tobytes()))
        schema = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("hot", pa.binary())])
        return pa.table({k: pa.array(list(c), schema.field(k).type) for k, c in zip(schema.names, zip(*rows))}, schema=schema) if rows else schema.empty_table()

    return run


def _content_rows(contents: list[bytes], placed: np.ndarray, shards: int):
    """Contents and their places by shard: ``(shard, places, zipped contents)``."""
    shard = (mix(placed["word"]) % U64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(shard[by], prepend=-1)), len(by))
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(shard[by[a]]), placed[by[a:b]].tobytes(), _zip(b"".join(contents[k] for k in by[a:b]))


def _earliest(contents: list[bytes], placed: np.ndarray):
    """Each different content with its earliest place; and the places of the others."""
    order = np.lexsort((placed["start"], placed["row"], placed["chunk"], placed["doc"]))
    first: dict[bytes, int] = {}
    later = []
    for k in order:
        if first.setdefault(contents[k], k) != k:
            later.append(k)
    kept = np.fromiter(first.values(), np.int64, len(first))
    return kept, np.array(later, np.int64)


def _span_rows(placed: np.ndarray, starts: np.ndarray, n_starts: np.ndarray, length: int):
    """``(chunk, spans)`` for runs of ``n_starts`` repeating passages from ``starts`` on, in documents ``placed``."""
    chunk = placed["chunk"]
    spans = np.zeros(len(placed), SPAN)
    starts = starts.astype(np.int64)
    spans["row"], spans["start"], spans["stop"] = placed["row"], starts, starts + n_starts + length - 1
    by = np.argsort(chunk, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(chunk[by], prepend=-1)), len(by))
    return [(int(chunk[by[a]]), spans[by[a:b]].tobytes()) for a, b in zip(cut[:-1], cut[1:])]


OUT = ["shard", "chunk", "places", "body"]


def _out_batch(shard_rows, span_rows, salt: int = 0):
    import pyarrow as pa

    rows = [(s, salt, p, z) for s, p, z in shard_rows] + [(None, c, p, None) for c, p in span_rows]
    return _rows(OUT, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows) if rows else None


def _send(length: int, shards: int):
    """Rows for shards (``places`` and zipped ``body``) and rows of spans for chunks (``shard`` null)."""

    def run(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                chunk, ids, bounds, body, common, hot = (x.as_py() for x in row)
                held = Chunk(ids, bounds, body)
                found = held.stretches(length)
                s, e, r, w, twice = found
                known = np.sort(np.concatenate([np.frombuffer(x, U64) for x in common])) if common else np.zeros(0, U64)
                here, count = np.unique(w, return_counts=True)
                wanted = np.union1d(known, np.union1d(here[count > 1], w[twice]))
                if not len(wanted):
                    continue
                at = np.minimum(np.searchsorted(wanted, w), len(wanted) - 1)
                k = np.flatnonzero(wanted[at] == w)
                hot = np.concatenate([np.frombuffer(x, U64) for x in hot]) if hot else np.zeros(0, U64)
                s, e, r, w, twice = held.dealt_anew(tuple(x[k] for x in found), hot, length)
                placed = np.zeros(len(s), PLACED)
                placed["doc"], placed["chunk"], placed["row"], placed["start"] = held.ids[r], chunk, r, s - held.bounds[r]
                placed["length"], placed["word"], placed["twice"] = e - s, w, twice
                data = held.data.tobytes()
                contents = [data[a:b] for a, b in zip(s.tolist(), (e + length - 1).tolist())]
                kept, later = _earliest(contents, placed)
                out = _out_batch(
                    _content_rows([contents[i] for i in kept], placed[kept], shards),
                    _span_rows(placed[later], placed["start"][later], placed["length"][later], length),
                    chunk,
                )
                if out is not None:
                    yield out

    return run


def _read_contents(table, length: int):
    placed, contents = [], []
    for places, body in zip(table.column("places"), table.column("body")):
        own, text, at = np.frombuffer(places.as_py(), PLACED), _unzip(body.as_py()), 0
        for n in (own["length"].astype(np.int64) + length - 1).tolist():
            contents.append(text[at : at + n])
            at += n
        placed.append(own)
    return contents, np.concatenate(placed)


def _merge(length: int, shards: int):
    def run(key, table):
        import pyarrow as pa

        contents, placed = _read_contents(table, length)
        kept, later = _earliest(contents, placed)
        out = _out_batch(
            _content_rows([contents[i] for i in kept], placed[kept], shards),
            _span_rows(placed[later], placed["start"][later], placed["length"][later], length),
            key[1].as_py(),
        )
        return pa.Table.from_batches([out])

    return run


def _repeats(contents: list[bytes], placed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``content, first, n``: runs of passages of ``contents`` (all different) that repeat, by a suffix array."""
    sizes = np.array([len(x) for x in contents], np.int64)
    heads = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int32) + 2
    text[heads + sizes] = 1
    text[-1] = 0
    order = suffix_array(text)
    shared = permuted_prefixes(text, order, 4 * length)
    group = np.cumsum(shared[order] < length)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    offset = np.arange(len(text)) - heads[owner]
    passage = offset < placed["length"][owner]
    k = passage[order]
    at, group = order[k], group[k]
    rank = np.lexsort((placed["start"][owner[at]] + offset[at], *(placed[f][owner[at]] for f in ("row", "chunk", "doc"))))
    place = np.empty(len(at), np.int64)
    place[rank] = np.arange(len(at))
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(place, cut) if len(cut) else place
    repeated = np.zeros(len(text) + 1, bool)
    repeated[at] = place != np.repeat(least, np.diff(np.append(cut, len(at))))
    edge = np.diff(repeated.astype(np.int8), prepend=0)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return owner[first], offset[first], stop - first


def _shard(length: int):
    """Spans of one shard, by chunk."""

    def run(table):
        import pyarrow as pa

        contents, placed = _read_contents(table, length)
        kept, later = _earliest(contents, placed)
        rows = _span_rows(placed[later], placed["start"][later], placed["length"][later], length)
        contents, placed = [contents[i] for i in kept], placed[kept]
        # the passages of a word's only content meet no others, and each other only if it has the word twice
        by = np.argsort(placed["word"], kind="stable")
        word = placed["word"][by]
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(by) else np.zeros(0, np.int64)
        size = np.array([len(x) for x in contents], np.int64)[by]
        ends = np.append(heads[1:], len(by))
        alone = np.repeat(ends - heads == 1, ends - heads) & (placed["twice"][by] == 0)
        group = np.repeat(np.arange(len(heads)), ends - heads)
        by, size, group = by[~alone], size[~alone], group[~alone]
        start = 0
        total = np.cumsum(size)
        while start < len(by):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + ARRAY_BYTES, side="right")))
            while stop < len(by) and group[stop] == group[stop - 1]:
                stop += 1
            k = by[start:stop]
            owner, first, n = _repeats([contents[i] for i in k], placed[k], length)
            own = placed[k][owner]
            rows += _span_rows(own, own["start"] + first, n, length)
            start = stop
        schema = pa.schema([("chunk", pa.int64()), ("spans", pa.binary())])
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "spans": pa.array([r[1] for r in rows], pa.binary())}, schema=schema)

    return run


def _cut(length: int, schema: T.StructType, with_text: bool, carry: tuple[str, ...], text_col: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in zip(*batch.columns):
                ids, bounds, body, rest, spans = (x.as_py() for x in row)
                held = Chunk(ids, bounds, body)
                gone = np.zeros(len(held.data) + 1, np.int32)
                for x in spans or ():
                    own = np.frombuffer(x, SPAN)
                    np.add.at(gone, held.bounds[own["row"]] + own["start"], 1)
                    np.add.at(gone, held.bounds[own["row"]] + own["stop"], -1)
                gone = np.cumsum(gone[:-1]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = held.bounds[:-1][held.bounds[:-1] < len(gone)]
                edge[inner] = gone[inner]
                spans_to, gone_to = (np.concatenate(([0], np.cumsum(x))) for x in (edge, gone))
                if carry:
                    yield _carried(held, gone, gone_to, pa.ipc.open_stream(_unzip(rest)).read_next_batch(), schema, text_col)
                    continue
                out = []
                for k, (a, b) in enumerate(zip(held.bounds[:-1], held.bounds[1:])):
                    kept = held.data[a:b][~gone[a:b]].tobytes()
                    text = None
                    if with_text:
                        text = _whole_characters(held.data[a:b], gone[a:b]) if gone_to[b] > gone_to[a] else kept
                    out.append((int(held.ids[k]) if held.known[k] else None, int(b - a), int(gone_to[b] - gone_to[a]), int(spans_to[b] - spans_to[a]), hashlib.sha256(kept).hexdigest(), text))
                names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                if with_text:
                    names, types = [*names, "kept_text"], [*types, pa.binary()]
                yield _rows(names, types, [r[: len(names)] for r in out])

    return run


def _carried(held: Chunk, gone: np.ndarray, gone_to: np.ndarray, rest, schema: T.StructType, text_col: str):
    """The rows as they were, but for their texts and a last column with the number of removed bytes."""
    import pyarrow as pa

    null = rest.column(1).to_numpy(zero_copy_only=False)
    texts = []
    for k, (a, b) in enumerate(zip(held.bounds[:-1], held.bounds[1:])):
        text = _whole_characters(held.data[a:b], gone[a:b]) if gone_to[b] > gone_to[a] else held.data[a:b].tobytes()
        texts.append(None if null[k] else text.decode())
    own = rest.column(0)
    columns = {f.name: own.field(i) for i, f in enumerate(own.type)}
    removed = gone_to[held.bounds[1:]] - gone_to[held.bounds[:-1]]
    names = [f.name for f in schema]
    return pa.RecordBatch.from_arrays([*[pa.array(texts, pa.string()) if c == text_col else columns[c] for c in names[:-1]], pa.array(removed)], names=names)


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> bytes:
    """What stays when a character goes only if all its bytes do."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, lead)
    return data[~np.repeat(whole, np.diff(np.append(lead, len(data))))].tobytes()


def _spans(held: DataFrame, length: int) -> DataFrame:
    """``chunk, spans`` of what repeats in ``held``, the chunks."""
    n_chunks, n_bytes = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    shares = max(1, -(-n_bytes // WORD_SHARE))
    reports = held.select("chunk", "ids", "bounds", "body").mapInArrow(_word_reports(length, shares), "share long, chunk long, words binary, counts binary")
    common = written(reports.groupBy("share").applyInArrow(_common_words(length), "chunk long, n long, words binary, hot binary"), "common", "none")
    n_common = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-n_common * (length + length // 3) // SHARD_BYTES))
    asked = common.groupBy("chunk").agg(F.collect_list("words").alias("common"), F.collect_list("hot").alias("hot"))
    told = held.join(asked, "chunk", "left").select("chunk", "ids", "bounds", "body", "common", "hot")
    out = "shard long, chunk long, places binary, body binary"
    sent = written(told.mapInArrow(_send(length, shards), out), "sent", "none")
    drop_written(common)
    spans = sent.filter("shard is null").select("chunk", F.col("places").alias("spans"))
    contents = sent.filter("shard is not null")
    fan = n_chunks
    while fan > MERGE_CHUNKS:
        fan = -(-fan // MERGE_CHUNKS)
        salted = contents.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(fan)))
        merged = written(salted.groupBy("shard", "chunk").applyInArrow(_merge(length, shards), out), "merged", "none")
        spans = spans.union(merged.filter("shard is null").select("chunk", F.col("places").alias("spans")))
        contents = merged.filter("shard is not null")
    tasks = min(MAX_TASKS, -(-shards // TASK_SHARDS))
    dealt = contents.select("shard", "places", "body").repartition(tasks, "shard")
    found = dealt.groupBy("shard").applyInArrow(_shard(length), "chunk long, spans binary")
    return spans.union(found).groupBy("chunk").agg(F.collect_list("spans").alias("spans"))


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int, with_text: bool, carry: tuple[str, ...], schema: T.StructType) -> DataFrame:
    if not WIDE + 8 <= length <= 8192:
        raise ValueError(f"length must be from {WIDE + 8} to 8192")
    held = written(chunks(docs, id_col, text_col, carry), "chunks", "none")
    told = held.join(_spans(held, length), "chunk", "left").select("ids", "bounds", "body", "rest", "spans")
    return told.mapInArrow(_cut(length, schema, with_text, carry, text_col), schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removed is each byte of a ``length``-byte string that also starts earlier; strings are
    compared as UTF-8 and judged on the input. With ``with_text`` a column ``kept_text``
    follows: what stays in whole characters, so a character is lost only if all its bytes
    are removed (``n_removed`` and ``kept_sha256`` count bytes).

    Null and empty texts and texts shorter than ``length`` lose nothing. A null id counts as
    larger than any other; rows that repeat an id are compared in the order they are read.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    longs = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    text = [T.StructField("kept_text", T.BinaryType())] if with_text else []
    return _removed(docs, id_col, text_col, length, with_text, (), T.StructType([*longs, T.StructField("kept_sha256", T.StringType()), *text]))


def suffix_dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, removed: str = "n_removed") -> DataFrame:
    """The rows of ``docs``, one for one, without the bytes that ``suffix_dedup`` removes, in whole characters.

    All other columns stay as they are, and ``removed`` follows: the number of removed bytes.
    A null text stays null. Rows are told apart by their place, so repeated and null ids do no harm.
    """
    carry = tuple(c for c in docs.columns if c != text_col)
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema]
    return _removed(docs, id_col, text_col, length, True, carry, T.StructType([*fields, T.StructField(removed, T.LongType())]))
