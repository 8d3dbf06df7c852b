"""Reading input tables and writing intermediate ones.

Inputs are only opened by Spark's readers, so any store that Spark knows will do.
Intermediate tables go to the folder in ``spark.checkpoint.dir``: it is shared by
the executors, so a lost executor costs a retry and never data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder.

    Only when the session names none (tests on one machine) is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOT:
            _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="marlspike-")
        root = f"file://{_LOCAL_ROOT[app]}"
    return f"{root.rstrip('/')}/marlspike-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part", compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it instead of repeating what made it.

    As with reliable checkpoints, the files stay until their folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    # the shuffle files of what made the table go as soon as it stands, instead of when the driver collects its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def head(text: Column, n: int) -> Column:
    """The first whole characters of ``text`` that fit ``n`` bytes."""
    raw = text.cast("binary")
    # a cut is between characters where the next byte does not continue one
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")
    cut = F.substring(raw, 1, n - 3)
    for k in (n - 2, n - 1, n):
        cut = F.when(inside(k), cut).otherwise(F.substring(raw, 1, k))
    return F.when(F.octet_length(text) <= n, text).otherwise(cut.cast("string"))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int, text_bytes: int):
    """Texts and labels of at most ``sample_docs`` training rows of each label; of longer texts, the first ``text_bytes``.

    Rows come by a hash of their id, among those with a text, so the sample is the same at
    every run. Returns an Arrow array and a boolean array.
    """
    import numpy as np
    import pyarrow as pa

    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & in_training(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") > 0)
    order = F.xxhash64("doc_id")
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    drawn = [usable.filter(F.col("label") == k).orderBy(order, "doc_id").limit(sample_docs) for k in (0, 1)]
    small = F.broadcast(drawn[0].union(drawn[1]))  # 2 * sample_docs ids at most
    found = texts.select("doc_id", head(F.col("text"), text_bytes).alias("text")).join(small, "doc_id").withColumn("order", order)
    rows = [found.filter(F.col("label") == k).orderBy("order", "doc_id").limit(sample_docs).select("text", "label").toArrow() for k in (0, 1)]
    sample = pa.concat_tables(rows).combine_chunks()
    if not sample.num_rows:
        return pa.array([], pa.string()), np.zeros(0, bool)
    return sample.column("text").chunk(0), sample.column("label").to_numpy() > 0


def batches_by_bytes(batches, sizes, limit: int):
    """Slices of Arrow record batches with about ``limit`` bytes by ``sizes(batch)`` each, one row at least."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        cum = np.cumsum(sizes(batch))
        start = 0
        while start < batch.num_rows:
            base = int(cum[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(cum, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
