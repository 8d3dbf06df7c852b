"""Table sources by name, with their read options, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


class Tables:
    """Named tables: files of a folder (``format`` of Spark's readers), frames, or catalogue tables."""

    def __init__(self, spark: SparkSession, folder: str | None = None, format: str = "parquet", suffix: str = ".parquet", **options):
        self.spark, self.folder, self.format, self.suffix, self.options = spark, folder, format, suffix, options
        self.named: dict[str, Callable[[], DataFrame]] = {}

    def add(self, name: str, frame: DataFrame | Callable[[], DataFrame]) -> None:
        self.named[name] = frame if callable(frame) and not isinstance(frame, DataFrame) else lambda: frame

    def read(self, name: str) -> DataFrame:
        if name in self.named:
            return self.named[name]()
        if self.folder is not None:
            return self.spark.read.format(self.format).options(**self.options).load(f"{self.folder}/{name}{self.suffix}")
        return self.spark.table(name)


def written(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared checkpoint folder, so later reads see one result."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = "file://" + _LOCAL_ROOT.setdefault(app, tempfile.mkdtemp(prefix="marlspike-"))
    path = f"{root.rstrip('/')}/marlspike-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
