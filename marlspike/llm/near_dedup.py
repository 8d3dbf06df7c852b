"""Near-duplicates by bottom-k sketches.

One hash function is applied to the shingles of a document; its sketch is the
``SKETCH`` least values. A pair at the threshold shares, but for a chance under
1e-6, at least ``SHARED`` of them (``bounds_of``). So each document is listed under only the
rarest of its values, enough that two documents that share so many meet in a list
(a document of few shingles is its own sketch, and there the bound is exact).
Values that many documents hold come last, and lists of them stay short.

Within a list the sketch of the union estimates the overlap of a pair; pairs that
pass are verified on their complete shingle sets. Documents with equal sets are one
class from the start, and a class is a row: its number is that of a row that holds it.

A pair belongs to one list, that of the rarest value it shares. A first round links each
class of a list to one representative, so groups of any size become stars. A second
round takes every remaining pair whose classes are not connected yet: lists that lie
within one component are closed without being read, and of the others the classes
outside the largest component are compared with the rest. Where these are many, the list
is refined by the next value that its pairs share, if that makes less to compare.
The documents of such pairs, not the pairs, are gathered by list and compared on their
sets, so no link that matters to a component is left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import batches_by_bytes, written
from .textvec import ASCII_LOWER, U64, flat_bytes, mix, ragged, row_sizes, span_hashes, spans

SHINGLE_WORDS = 5
THRESHOLD = 80
SKETCH = 32
#: The chance to miss a pair at the threshold is below this.
MISS = 1e-6
#: Lists are cut to blocks of about so many classes, and so many shingles.
LIST_BLOCK = 1024
LIST_SHINGLES = 4_000_000
#: A list with more classes (or shingles of them) outside its largest component is refined.
REFINE = 2048
#: Lists are refined by so many shared values at most.
REFINE_DEPTH = 3
#: In the first round, so many representatives of a long list are tried.
HUBS = 8
#: In the first round, lists up to this length propose all pairs.
ALL_PAIRS = 6
#: Up to so many ids are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
SLICE_BYTES = 2 << 20
PAIR_SLICE = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def bounds_of(threshold: int) -> tuple[int, int]:
    """``SHARED, SMALL_SET`` of a threshold in percent.

    A pair at the threshold shares at least ``SHARED`` sketch values but for a chance of
    ``MISS``; sets below ``SMALL_SET`` can only meet sets that fit a sketch whole.
    """
    t = threshold / 100
    less, shared = 0.0, 0
    while shared < SKETCH and (less := less + math.comb(SKETCH, shared) * t**shared * (1 - t) ** (SKETCH - shared)) <= MISS:
        shared += 1
    if not shared or threshold > 100:
        raise ValueError(f"sketches of {SKETCH} values cannot tell pairs at {threshold} percent")
    return shared, math.floor(SKETCH * threshold / 100) + 1


def shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, repeats included, and the rows' bounds among them.

    Words are runs of bytes other than space and 9-13, after lower-casing A-Z. A row
    of fewer than ``width`` words has one shingle of all of them; one without words, none.
    """
    data = ASCII_LOWER[data]
    starts, ends, edges = spans(~_SPACE[data], bounds)
    hashes = span_hashes(data, starts, ends)
    n_words = np.diff(edges)
    n_out = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n_out)))
    at = ragged(edges[:-1], n_out)
    n_here = np.repeat(np.minimum(n_words, width), n_out)
    out = n_here.astype(U64)
    padded = np.concatenate((hashes, np.zeros(width, U64)))
    for j in range(width):
        factor = U64(pow(0xBF58476D1CE4E5B9, j + 1, 2**64))
        out += np.where(j < n_here, padded[at + j] * factor, U64(0))
    return mix(out), out_bounds


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow string array."""
    values, bounds = shingles(*flat_bytes(column), width)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``row, doc_id, n_shingles, mark1, mark2, sketch, text`` of each row, and a struct ``rest`` of the columns ``carry``.

    The marks identify the whole set; ``row`` is a number of the row's own.
    """
    taken = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []),
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(2)) + 256, SLICE_BYTES):
            sets = shingle_sets(batch.column(2), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            marks = [(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum()), int(np.bitwise_xor.reduce(mix(s + U64(0x14057B7EF767814F))))) for s in sets]
            marks = np.array(marks, dtype=U64).view(np.int64).reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum(np.minimum(sizes, SKETCH)))).astype(np.int32)
            kept = np.concatenate([s[:SKETCH] for s in sets]).view(np.int64)
            made = [pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *made, *batch.columns[2:]],
                names=["row", "doc_id", "n_shingles", "mark1", "mark2", "sketch", *batch.schema.names[2:]],
            )

    made = [T.StructField(c, T.LongType()) for c in ("row", "doc_id", "n_shingles", "mark1", "mark2")] + [T.StructField("sketch", T.ArrayType(T.LongType()))]
    return taken.mapInArrow(run, T.StructType(made + taken.schema.fields[2:]))


def _least(n: Column, threshold: int) -> Column:
    """How many sketch values a set of ``n`` shingles shares with any set like it."""
    floor, small_set = bounds_of(threshold)
    return F.when(n < small_set, F.ceil(n * threshold / 100)).otherwise(floor).cast("int")


def listings(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``key, last, blocks, id, n, sketch, room``: each class under its rarest values that another class holds too.

    ``sketch`` has the shared values in the order of their rarity, as codes of how many
    classes hold a value and its low 32 bits; equal values have equal codes, and values that
    are confused only make more pairs to verify. The class is listed under the first ``room``.
    ``last`` is the code that makes the list, ``key`` a hash of the codes before it.
    """
    held = classes.select("id", "n", F.explode("sketch").alias("value"))
    common = held.groupBy("value").agg(F.count(F.lit(1)).alias("listed"), F.sum("n").alias("shingles")).filter("listed > 1")
    low = F.shiftrightunsigned(F.shiftleft("value", 32), 32)
    common = common.select("value", F.shiftleft(F.least("listed", F.lit((1 << 30) - 1)), 32).bitwiseOR(low).alias("code"), "listed", "shingles")
    shared = held.join(common, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("code", "listed", "shingles"))).alias("v"))
    room = (F.size("v") - _least(F.col("n"), threshold) + 1).cast("int")
    named = shared.withColumn("room", room).filter("room > 0")
    blocks = F.ceil(F.greatest(F.col("e.listed") / LIST_BLOCK, F.col("e.shingles") / LIST_SHINGLES)).cast("long")
    return named.select("id", "n", F.col("v.code").alias("sketch"), "room", F.explode(F.slice("v", F.lit(1), F.col("room"))).alias("e")).select(
        F.col("e.code").alias("key"), F.col("e.code").alias("last"), blocks.alias("blocks"), "id", "n", "sketch", "room"
    )


def _sketch_matrix(column) -> np.ndarray:
    """Sketches as rows of ``SKETCH`` codes; missing places are -1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lengths), SKETCH), -1, np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, ragged(np.zeros(len(lengths), np.int64), lengths)] = flat
    return out


def needed(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """How many sketch values sets of ``a`` and ``b`` shingles must share; more than a sketch has if their sizes tell them apart."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    floor, small_set = bounds_of(threshold)
    out = np.where(small < small_set, np.ceil(large * threshold / 100), floor)
    return np.where(100 * small >= threshold * large, out, SKETCH + 1)


def similar(sk: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, last: np.ndarray, threshold: int) -> np.ndarray:
    """For each pair of rows: may its similarity reach the threshold, and is ``last`` the rarest value it shares."""
    need = needed(n[a], n[b], threshold)
    keep = np.flatnonzero(need <= SKETCH)
    out = np.zeros(len(a), bool)
    for at in range(0, len(keep), PAIR_SLICE):
        k = keep[at : at + PAIR_SLICE]
        x = np.sort(np.concatenate((sk[a[k]], sk[b[k]]), axis=1), axis=1)
        same = (x[:, 1:] == x[:, :-1]) & (x[:, 1:] >= 0)
        first = x[np.arange(len(k)), same.argmax(axis=1)]
        out[k] = (same.sum(axis=1) >= need[k]) & (first == last[k])
    return out


class List:
    """One list's sketches, to compare one class with many."""

    def __init__(self, sk: np.ndarray, n: np.ndarray, last: int, depth: int, threshold: int):
        self.n, self.depth, self.threshold = n, depth, threshold
        known, number = np.unique(sk, return_inverse=True)
        self.number = number.reshape(sk.shape)
        self.real = sk >= 0
        self.upto = self.real & (sk <= last)
        self.mark = np.zeros(len(known), bool)

    def fame(self) -> np.ndarray:
        """For each class, how often its values stand in the list."""
        count = np.bincount(self.number.ravel(), minlength=len(self.mark))
        return np.where(self.real, count[self.number], 0).sum(axis=1)

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may reach the threshold with ``i``, and first share the values that make the list."""
        need = needed(self.n[others], self.n[i], self.threshold)
        fit = need <= SKETCH
        others, need = others[fit], need[fit]
        mine = self.number[i][self.real[i]]
        self.mark[mine] = True
        common = self.mark[self.number[others]]
        self.mark[mine] = False
        fit = (common.sum(axis=1) >= need) & ((common & self.upto[others]).sum(axis=1) == self.depth)
        return others[fit]


def _runs(batches, n_keys: int):
    """Sorted batches cut at changes of their first columns: each yield is a table of whole runs."""
    import pyarrow as pa

    held = []

    def cut(batch):
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
        return int(np.flatnonzero(new)[-1]), tuple(x[0] for x in keys), tuple(x[-1] for x in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        at, _, _ = cut(batch)
        first = tuple(batch.column(k)[0].as_py() for k in range(n_keys))
        if held and tuple(held[-1].column(k)[-1].as_py() for k in range(n_keys)) != first:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if at:
            held.append(batch.slice(0, at))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _run_bounds(table, n_keys: int) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = False
        for k in range(n_keys):
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _pair_batch(a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _arrays(table):
    columns = [table.column(c).to_numpy() for c in ("last", "id", "n")]
    return *columns, _sketch_matrix(table.column("sketch").combine_chunks())


def _star_pairs(threshold: int):
    """All pairs of short lists; in longer ones each class with the first representative that it is similar to."""

    def run(batches):
        for table in _runs(batches, 3):
            bounds = _run_bounds(table, 3)
            lengths = np.diff(bounds)
            last, ids, n, sk = _arrays(table)
            lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for width in range(2, ALL_PAIRS + 1):
                heads = bounds[:-1][lengths == width]
                for i in range(width):
                    for j in range(i + 1, width):
                        lefts.append(heads + i)
                        rights.append(heads + j)
            a, b = np.concatenate(lefts), np.concatenate(rights)
            fit = similar(sk, n, a, b, last[a], threshold)
            lefts, rights = [a[fit]], [b[fit]]
            for head, stop in zip(bounds[:-1][lengths > ALL_PAIRS], bounds[1:][lengths > ALL_PAIRS]):
                held = List(sk[head:stop], n[head:stop], int(last[head]), 1, threshold)
                left = np.lexsort((ids[head:stop], -held.fame()))
                for _ in range(HUBS):
                    if len(left) < 2:
                        break
                    hub, left = left[0], left[1:]
                    near = held.partners(hub, left)
                    lefts.append(head + near)
                    rights.append(np.full(len(near), head + hub))
                    left = left[~np.isin(left, near)]
            a, b = np.concatenate(lefts), np.concatenate(rights)
            if len(a):
                yield _pair_batch(ids[a], ids[b])

    return run


OPEN = "key long, last long, salt long, id long, component_id long, minor boolean"


def _open_rows(threshold: int):
    """The classes of each block that may be similar to one of another component, ``minor`` being those to compare with all.

    Main rows belong to the list's largest component and stand in one block each;
    the others stand in all blocks of their list, and meet each other in the first.
    """

    def run(batches):
        import pyarrow as pa

        for table in _runs(batches, 3):
            bounds = _run_bounds(table, 3)
            last, ids, n, sk = _arrays(table)
            key, salt, label, depth = (table.column(k).to_numpy() for k in ("key", "salt", "component_id", "depth"))
            main = table.column("main").to_numpy().astype(bool)
            picked = [np.zeros(0, np.int64)]
            for head, stop in zip(bounds[:-1], bounds[1:]):
                if stop - head < 2 or (label[head:stop] == label[head]).all():
                    continue
                own_label, own_main = label[head:stop], main[head:stop]
                held = List(sk[head:stop], n[head:stop], int(last[head]), int(depth[head]), threshold)
                used = np.zeros(stop - head, bool)
                for i in np.flatnonzero(~own_main):
                    later = (salt[head] == 0) & (np.arange(stop - head) > i)
                    near = held.partners(i, np.flatnonzero((own_label != own_label[i]) & (own_main | later)))
                    if len(near):
                        used[near] = True
                        used[i] = True
                picked.append(head + np.flatnonzero(used))
            k = np.concatenate(picked)
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[k]), pa.array(last[k]), pa.array(salt[k]), pa.array(ids[k]), pa.array(label[k]), pa.array(~main[k])],
                    names=["key", "last", "salt", "id", "component_id", "minor"],
                )

    return run


def _verify_blocks(width: int, threshold: int):
    """Links between documents of different components, one for each document and component at most."""

    def run(batches):
        import pyarrow as pa

        for table in _runs(batches, 3):
            bounds = _run_bounds(table, 3)
            ids, label = table.column("id").to_numpy(), table.column("component_id").to_numpy()
            minor, text = table.column("minor").to_numpy().astype(bool), table.column("text").combine_chunks()
            found = []
            for head, stop in zip(bounds[:-1], bounds[1:]):
                own_ids, own_label, own_minor = ids[head:stop], label[head:stop], minor[head:stop]
                sets = shingle_sets(text.slice(head, stop - head), width)
                size = np.array([len(x) for x in sets])
                starts = np.cumsum(size) - size
                known, number = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(len(known) + 1, bool)
                number = np.append(number, len(known))
                for i in np.flatnonzero(own_minor):
                    mine = number[starts[i] : starts[i] + size[i]]
                    mark[mine] = True
                    both = np.add.reduceat(mark[number], starts) * (size > 0)
                    mark[mine] = False
                    fit = (100 * both >= threshold * (size + size[i] - both)) & (own_label != own_label[i])
                    at = np.flatnonzero(fit)
                    _, one = np.unique(own_label[at], return_index=True)
                    found += [(int(own_ids[i]), int(own_ids[j])) for j in at[one]]
            if found:
                a, b = np.array(found, np.int64).T
                yield _pair_batch(a, b)

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold. ``texts``: ``id, text``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches_by_bytes(batches, lambda b: row_sizes(b.column(2)) + row_sizes(b.column(3)) + 64, SLICE_BYTES):
            fit = []
            for x, y in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                fit.append(100 * both >= threshold * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(fit, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _list_stats(known: DataFrame) -> DataFrame:
    """For each list: its largest component, its blocks, ``cost`` in comparisons, and whether ``many`` classes are outside that component."""
    per = known.groupBy("key", "last", "component_id").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    most = F.max(F.struct("c", "s", "component_id")).alias("most")
    stat = per.groupBy("key", "last").agg(F.sum("c").alias("rows"), F.sum("s").alias("shingles"), most)
    minor, minor_shingles = F.col("rows") - F.col("most.c"), F.col("shingles") - F.col("most.s")
    blocks = F.ceil(F.greatest(F.col("rows") / LIST_BLOCK, F.col("shingles") / LIST_SHINGLES)).cast("long")
    many = (minor > REFINE) | (minor_shingles > LIST_SHINGLES)
    cost = minor.cast("double") * F.col("rows")
    return written(stat.select("key", "last", F.col("most.component_id").alias("largest"), blocks.alias("blocks"), many.alias("many"), cost.alias("cost")), "stat")


def _open_lists(lists: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """The rows of ``lists`` that may hold pairs of different components, with ``component_id, main, salt, depth``.

    A list of many classes outside its largest component is refined by the next value that a
    pair shares if that halves the comparisons at least; a list of classes that share most of
    their values would only be repeated by it.
    """
    floor, _ = bounds_of(threshold)
    known = written(lists.drop("blocks").join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "id")), "known")
    stat = _list_stats(known)
    rows = None
    for depth in range(1, min(floor, REFINE_DEPTH) + 1):
        is_open = known.join(stat.filter("cost > 0"), ["key", "last"]).withColumn("depth", F.lit(depth)).withColumn("next", F.xxhash64("key", "last"))
        part = is_open
        again = depth < min(floor, REFINE_DEPTH) and stat.filter("many").limit(1).count() > 0
        if again:
            at = F.array_position("sketch", F.col("last")).cast("int")
            after = F.slice("sketch", at + 1, F.greatest(F.lit(0), F.least(F.col("room") + depth, F.size("sketch")) - at))
            finer = is_open.filter("many").select(F.col("next").alias("key"), F.explode(after).alias("last"), "id", "n", "sketch", "room", "component_id")
            finer = written(finer, "finer")
            finer_stat = _list_stats(finer)
            costs = stat.filter("many").select(F.xxhash64("key", "last").alias("key"), (F.col("cost") / 2).alias("half"))
            better = finer_stat.groupBy("key").agg(F.sum("cost").alias("sum")).join(costs, "key").filter("sum <= half").select("key")
            better = written(better, "better")
            # of a refined list, sets so small that pairs may share no further value are compared here
            known, stat = finer.join(better, "key", "left_semi"), finer_stat.join(better, "key", "left_semi")
            part = is_open.join(better.select(F.col("key").alias("next"), F.lit(True).alias("refined")), "next", "left")
            part = part.filter(F.col("refined").isNull() | (_least(F.col("n"), threshold) <= depth)).drop("refined")
        rows = part if rows is None else rows.union(part.select(rows.columns))
        if not again:
            break
    main = F.col("component_id") == F.col("largest")
    salts = F.when(main, F.array(F.pmod(F.xxhash64("id"), "blocks"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return rows.select("key", "last", F.explode(salts).alias("salt"), "id", "n", "sketch", "component_id", main.alias("main"), "depth")


def near_links(marked: DataFrame, classes: DataFrame, width: int, threshold: int) -> DataFrame | None:
    """``id, component_id`` of each class that is linked with another, or None where no two share a value.

    ``marked``: what ``sketches`` gives; ``classes``: ``id, n, sketch``, with ids that are rows of it.
    """
    lists = written(listings(classes, threshold), "lists")
    named = written(lists.select("id").distinct(), "named")
    n_named = named.count()
    if not n_named:
        return None
    texts = marked.select(F.col("row").alias("id"), "text")
    texts = written(texts.join(F.broadcast(named) if n_named <= BROADCAST_IDS else named, "id", "left_semi"), "texts")

    by = ["key", "last", "salt"]
    blocks = F.col("blocks")
    # a long list is cut twice, by independent hashes, so its blocks overlap
    cuts = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit(1)), blocks), blocks + F.pmod(F.xxhash64("id", F.lit(2)), blocks)))
    dealt = lists.select("key", "last", F.explode(cuts).alias("salt"), "id", "n", "sketch").repartition(*by).sortWithinPartitions(*by)
    few = written(dealt.mapInArrow(_star_pairs(threshold), "a long, b long").distinct(), "pairs")
    links = written(verified(few, texts, width, threshold), "links")
    labels = components(links)

    open_lists = _open_lists(lists, labels, threshold).repartition(*by).sortWithinPartitions(*by)
    rows = written(open_lists.mapInArrow(_open_rows(threshold), OPEN), "open")
    with_text = rows.join(texts, "id").select(*by, "id", "component_id", "minor", "text").repartition(*by).sortWithinPartitions(*by)
    more = written(with_text.mapInArrow(_verify_blocks(width, threshold), "a long, b long"), "links")
    if not more.limit(1).count():
        return labels
    return components(links.union(more))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What ``sketches`` gives, and ``mark1, mark2, component_id, stays``: the smallest id of each set's component and the row that has it."""
    bounds_of(threshold)
    marked = written(sketches(docs, id_col, text_col, width, carry), "sketches")
    # a class is numbered by its row of least id; null ids come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = marked.filter("n_shingles > 0").groupBy("mark1", "mark2").agg(first, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    groups = written(groups.select("mark1", "mark2", F.col("first.row").alias("id"), "first", "n", "sketch"), "groups")
    labels = near_links(marked, groups.select("id", "n", "sketch"), width, threshold)
    named = groups.select("mark1", "mark2", "id", "first")
    if labels is not None:
        tied = written(labels.join(named.select("id", "first"), "id"), "tied")
        roots = tied.groupBy("component_id").agg(F.min("first").alias("root"))
        named = named.join(tied.join(roots, "component_id").select("id", "root"), "id", "left").withColumn("first", F.coalesce("root", "first"))
    return marked, named.select("mark1", "mark2", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("stays"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents whose distinct ``width``-word shingles have a Jaccard similarity of
    ``threshold`` percent or more are linked; ``component_id`` is the smallest id
    reachable, and that document is ``kept``. Null and empty texts and texts of
    separators have no shingles and link with nothing. Rows are compared whatever their
    ids: rows that repeat an id each link by their own text, and rows with a null id link
    like any other. The component of rows that all have null ids is null and they are kept.
    Other columns of ``docs`` are not read. An empty table gives an empty result. Thresholds
    that sketches cannot tell (below 36) raise an error.
    """
    marked, named = _grouped(docs, id_col, text_col, width, threshold)
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        marked.select("doc_id", "n_shingles", "mark1", "mark2")
        .join(named, ["mark1", "mark2"], "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
    )


def near_dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``near_dedup`` keeps: one of each component.

    It is the row of smallest id; null ids count as larger than any other, and of rows that
    repeat an id and its text one stays. Rows without shingles all stay.
    """
    carry = tuple(c for c in docs.columns if c != text_col)
    marked, named = _grouped(docs, id_col, text_col, width, threshold, carry)
    gone = marked.filter("n_shingles > 0").select("row", "mark1", "mark2").join(named, ["mark1", "mark2"]).filter("row <> stays").select("row")
    kept = marked.select("row", "text", "rest").join(written(gone, "gone"), "row", "left_anti")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
