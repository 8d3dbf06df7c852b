"""Connected components of a graph of long ids, labelled by their smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_written, written

#: Graphs of at most so many edges are labelled by one task (a few tens of MB); larger ones by rounds of joins.
ONE_TASK_EDGES = 200_000
LABELS = "id long, component_id long"


class Forest:
    """Union-find over any hashable ids; the smaller root wins."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _one_task(batches):
    import pyarrow as pa

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
    ids = list(forest.parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.find(x) for x in ids], pa.int64())], names=["id", "component_id"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``id, component_id`` of each id in ``edges`` (columns ``a, b``); an id without edges is not listed.

    Null ends and loops are ignored. Beyond ``one_task_edges`` edges, rounds of minimum
    labels follow: each id learns the least label among its neighbours and each label's
    own label (pointer jumping), until nothing changes.
    """
    clean = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b").distinct(), "edges")
    if clean.count() <= one_task_edges:
        return written(clean.coalesce(1).mapInArrow(_one_task, LABELS), "labels")
    both = clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component_id")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("near"))
        best = labels.join(near, "id").select("id", F.col("component_id").alias("old"), F.least("component_id", "near").alias("low"))
        best = written(best, "best")
        # the label of a label, and a hint to the old label's own id that a lower one exists
        hint = best.filter("low < old").groupBy(F.col("old").alias("id")).agg(F.min("low").alias("hint"))
        known = best.join(hint, "id", "left").select("id", "old", F.least("low", F.coalesce("hint", "low")).alias("low"))
        jump = known.alias("x").join(known.select(F.col("id").alias("jid"), F.col("low").alias("jlow")), F.col("low") == F.col("jid"), "left")
        step = written(jump.select("id", "old", F.least("low", F.coalesce("jlow", "low")).alias("component_id")), "labels")
        changed = step.filter("component_id <> old").limit(1).count()
        drop_written(best)
        drop_written(labels)
        labels = step.select("id", "component_id")
        if not changed:
            return labels
