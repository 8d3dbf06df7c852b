"""The corpus pipeline: stages in order, each over all rows its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read
again as the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from marlspike.llm.tables import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores as toxic go. It learns from the labels of ``sf_dir`` and the texts of ``docs``."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id stays."""
    return exact_dedup.exact_dedup_documents(docs).select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the document with the smallest id stays; of rows that repeat it, one."""
    return near_dedup.near_dedup_documents(docs.select(COLUMNS))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier go, in whole characters; ``n_chars`` follows. All rows stay, if empty."""
    cut = suffix_dedup.suffix_dedup_documents(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, capacity=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("suffix dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learned scores nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
