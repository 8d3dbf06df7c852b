"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest pivots, in order. Pivots are taken from a
bounded sample of the vectors; every vector is indexed. Inverted lists hold, for each
pivot, the vectors that have it among their nearest. Two vectors are candidates if they
share at least ``SHARED`` pivots; the count is made within the list of the rarest pivot
they share, so a pair is counted once. Candidates are verified by cosine in double
precision. Equal vectors are one class, indexed once, with their number.

A list longer than ``MAX_BLOCKS`` blocks is refined by the next pivot that a pair shares,
until its vectors share ``SHARED`` of them and are candidates of each other. Lists are cut to blocks
of ``BLOCK`` vectors and each pair of blocks is a task's work, so no list has to fit a
task. A task returns a row for each linked vector: how many vectors it found for it, and
one that it is connected with.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import written

THRESHOLD = 0.9
NEAREST = 12
SHARED = 3
BLOCK = 2048
MAX_BLOCKS = 4
#: Cosines in single precision are off by less than this; where at most this share of pairs comes near the threshold, pairs are counted one by one.
ROUNDING, FEW = 1e-4, 0.02
PAIR_SLICE = 1 << 15
#: Pivots for n vectors: PIVOTS_PER_ROOT times the square root of n, within these bounds.
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 2.0, 64, 4096
#: Vectors that pivots are chosen from, for each pivot.
SAMPLE_PER_PIVOT = 3
#: A pivot is no nearer to another than this cosine, as long as the sample lasts.
PIVOT_SPREAD = 0.7


def usable(vector: str = "embedding"):
    """Neither null nor zero, and all components finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list array of one length, in double precision and of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # scaled first, so that the squares of very large or small components stay in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int, spread: float = PIVOT_SPREAD) -> np.ndarray:
    """The first ``n`` rows of ``sample`` that keep their distance; others follow if these are too few."""
    kept: list[int] = []
    rest: list[int] = []
    for k in range(len(sample)):
        if len(kept) == n:
            break
        near = kept and (sample[kept] @ sample[k]).max() > spread
        (rest if near else kept).append(k)
    return sample[(kept + rest)[:n]]


def _index(pivots: dict[int, tuple[int, np.ndarray]], nearest: int):
    """Each vector's nearest pivots.

    ``pivots`` has the first number and the pivots of each length; vectors of a length that it lacks share one list.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == d)))
                if d in pivots:
                    first, known = pivots[d]
                    near = (first + np.argsort(-(_matrix(own.column(2)) @ known.T), axis=1, kind="stable")[:, :nearest]).astype(np.int64)
                else:
                    near = np.full((own.num_rows, 1), -d, np.int64)
                order = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), order, own.column(2)], names=["id", "size", "nearest", "embedding"])

    return run


def _membership(near: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows by ``pivots``: 1 where the pivot is among the row's nearest."""
    out = np.zeros((len(near), len(pivots)), np.float32)
    at = np.searchsorted(pivots, near)
    at[at == len(pivots)] = 0
    found = pivots[at] == near
    out[np.nonzero(found)[0], at[found]] = 1
    return out


def links_of(x: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, last: int, depth: int, shared: int, threshold: float) -> np.ndarray:
    """Which of ``left`` (rows) and ``right`` (columns) are linked through a list whose vectors all have ``depth`` pivots, ``last`` the most common."""
    out = np.zeros((len(left), len(right)), bool)
    if not len(left) or not len(right):
        return out
    single = x.astype(np.float32)
    # in single precision, few pairs of a list come near the threshold at all; only theirs need be counted
    i, j = np.nonzero(single[left] @ single[right].T >= threshold - ROUNDING)
    if len(i) <= FEW * out.size:
        for at in range(0, len(i), PAIR_SLICE):
            k, m = i[at : at + PAIR_SLICE], j[at : at + PAIR_SLICE]
            a, b = near[left[k]], near[right[m]]
            same = (a[:, :, None] == b[:, None, :]).any(axis=2)
            linked = (same.sum(axis=1) >= shared) & ((same & (a <= last)).sum(axis=1) == depth)
            k, m = k[linked], m[linked]
            out[k, m] = (x[left[k]] * x[right[m]]).sum(axis=1) >= threshold
        return out
    pivots = np.unique(near)
    upto = pivots <= last
    a, b = _membership(near[left], pivots), _membership(near[right], pivots)
    # pairs that share another pivot as rare are counted in its list
    first = a[:, upto] @ b[:, upto].T == depth
    candidate = first & (a[:, ~upto] @ b[:, ~upto].T >= shared - depth)
    rows = np.flatnonzero(candidate.any(axis=1))
    out[rows] = candidate[rows] & (x[left[rows]] @ x[right].T >= threshold)
    return out


def _compare(shared: int, threshold: float):
    def run(key, table):
        import pyarrow as pa

        _, last, depth, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        ids, size, block = (table.column(k).to_numpy() for k in ("id", "size", "block"))
        x = _matrix(table.column("embedding").chunk(0))
        near = np.stack(table.column("nearest").chunk(0).flatten().to_numpy().reshape(len(ids), -1))
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block == high)
        linked = links_of(x, near, left, right, last, depth, min(shared, near.shape[1]), threshold)
        if low == high:
            np.fill_diagonal(linked, False)
        found = np.zeros(len(ids), np.int64)
        np.add.at(found, left, linked @ size[right])
        if low != high:
            np.add.at(found, right, size[left] @ linked)
        label = ids.copy()
        touched_left, touched_right = linked.any(axis=1), linked.any(axis=0)
        linked = linked[touched_left][:, touched_right]
        a, b = left[touched_left], right[touched_right]
        top = np.iinfo(np.int64).max
        while len(a):
            was = label.copy()
            label[a] = np.minimum(label[a], np.where(linked, label[b], top).min(axis=1))
            label[b] = np.minimum(label[b], np.where(linked, label[a][:, None], top).min(axis=0))
            if (label == was).all():
                break
        k = np.flatnonzero(found > 0)
        return pa.table({"id": ids[k], "links": found[k], "near": label[k]})

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    nearest: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors of cosine ``threshold`` or more are linked if the index retrieves them (recall
    is measured in the tests); ``n_links`` counts the other vectors linked directly, and
    ``component_id`` is the smallest id reachable. Equal vectors are always linked.

    Vectors are compared with those of their own length, and each length has its own index.
    Vectors that are null, zero, or hold null or non-finite components link with nothing,
    and so do rows with a null id. Rows count as vectors: rows that repeat an id and its
    vector are linked, and different vectors under one id each have their own links. Other
    columns are not read. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("fit", usable() & F.col("vec_id").isNotNull())
    # 128 bits name a vector wherever rows are joined; vectors themselves are shuffled once
    named_by = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2")]
    fit = rows.filter("fit").select("vec_id", "embedding", *named_by)
    classes = fit.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # few vectors of a length need no pivots: each is compared with each
    pivots, first = {}, 0
    for d, n in sorted(tuple(r) for r in classes.groupBy(F.size("embedding")).count().filter(F.col("count") > MIN_PIVOTS).collect()):
        n_pivots = int(min(MAX_PIVOTS, max(MIN_PIVOTS, PIVOTS_PER_ROOT * n**0.5)))
        drawn = classes.filter(F.size("embedding") == d).orderBy("h1", "h2").limit(SAMPLE_PER_PIVOT * n_pivots).select("embedding").toArrow()
        pivots[d] = first, choose_pivots(_matrix(drawn.column(0).combine_chunks()), n_pivots)
        first += len(pivots[d][1])

    indexed = classes.select("id", "size", "embedding").mapInArrow(_index(pivots, nearest), f"id long, size long, nearest array<long>, embedding {dict(classes.dtypes)['embedding']}")
    lists = _lists(written(indexed, "indexed"), nearest, shared, block)
    # a list stands in each pair of its blocks; it has few, unless its vectors are candidates of each other
    dealt = (
        lists.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    found = dealt.select("key", "last", "depth", "low", "high", "block", "id", "size", "nearest", "embedding").groupBy("key", "last", "depth", "low", "high").applyInArrow(_compare(shared, threshold), "id long, links long, near long")
    found = written(found, "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("near").alias("b")))
    named = classes.select("h1", "h2", "id", "least", "size").join(counts, "id", "left").join(labels, "id", "left").withColumn("component", F.coalesce("component_id", "id"))
    named = written(named.select("h1", "h2", "least", "size", "links", "component"), "named")
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    own_class = fit.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = rows.filter(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own_class.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _lists(indexed: DataFrame, nearest: int, shared: int, block: int) -> DataFrame:
    """The inverted lists: ``key, last, depth, blocks, block`` and the columns of ``indexed``.

    Pivots are numbered anew by how rare they are, and a vector is listed under those of its
    pivots that can be the rarest it shares with a candidate. ``last`` is the pivot that makes
    the list, the ``depth``-th that its vectors have in common; ``key`` is a hash of those before it.
    """
    counts = indexed.select(F.explode("nearest").alias("pivot")).groupBy("pivot").count()
    # a row for each pivot, and one for each length without pivots
    codes = F.broadcast(counts.select("pivot", (F.shiftleft("count", 24) + F.pmod("pivot", F.lit(1 << 24))).alias("code")))
    coded = indexed.select("id", F.explode("nearest").alias("pivot")).join(codes, "pivot").groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("nearest"))
    held = indexed.drop("nearest").join(coded, "id")

    def listed(df: DataFrame, depth: int, after: Column) -> Column:
        """The pivots that may be the ``depth``-th shared one; of few pivots, all must be shared."""
        have = F.size("nearest")
        room = F.greatest(F.lit(0), have - F.least(F.lit(shared), have) + depth - after)
        return F.explode(F.slice("nearest", after + 1, room))

    own = held.select(F.lit(0).cast("long").alias("key"), listed(held, 1, F.lit(0)).alias("last"), F.lit(1).alias("depth"), "id", "size", "nearest")
    out = None
    for depth in range(1, shared + 1):
        own = written(own, "lists")
        sizes = written(own.groupBy("key", "last").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        part = own.join(sizes.select("key", "last", "blocks"), ["key", "last"])
        long_ = F.col("blocks") > MAX_BLOCKS
        again = depth < shared and sizes.filter(long_).limit(1).count() > 0
        if again:
            after = F.array_position("nearest", F.col("last")).cast("int")
            # vectors of so few pivots that all lists of theirs are used up stay together
            more = long_ & (F.size("nearest") > depth)
            own = part.filter(more).select(F.xxhash64("key", "last").alias("key"), listed(part, depth + 1, after).alias("last"), F.lit(depth + 1).alias("depth"), "id", "size", "nearest")
            part = part.filter(~more)
        out = part if out is None else out.union(part)
        if not again:
            break
    with_vectors = out.join(indexed.select("id", "embedding"), "id")
    return with_vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
