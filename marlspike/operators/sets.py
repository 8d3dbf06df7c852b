"""Set operators, plain and by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import by_instant
from .ordering import Key, sorts


def same_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """``right`` under the names of ``left``, by place."""
    return right.toDF(*left.columns)


def distinct_by(df: DataFrame, order: tuple[Key, ...], keys: list[str]) -> DataFrame:
    """The first row of each key in order. Ties beyond the order are broken by the other columns."""
    rest = [F.col(c) for c in df.columns]
    w = Window.partitionBy(*[by_instant(df, k) for k in keys]).orderBy(*sorts(order), *rest)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def _match(keys: list[str]):
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def except_by(df: DataFrame, order, keys: list[str], other: DataFrame) -> DataFrame:
    gone = other.toDF(*keys).distinct()
    return distinct_by(df.alias("a").join(gone.alias("b"), _match(keys), "left_anti"), order, keys)


def intersect_by(df: DataFrame, order, keys: list[str], other: DataFrame) -> DataFrame:
    held = other.toDF(*keys).distinct()
    return distinct_by(df.alias("a").join(held.alias("b"), _match(keys), "left_semi"), order, keys)


def union_by(df: DataFrame, order, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` first, then those of ``other`` with new keys."""
    both = df.withColumn("__side", F.lit(0)).union(same_columns(df, other).withColumn("__side", F.lit(1)))
    return distinct_by(both, (Key("__side"), *order), keys).drop("__side")


def default_if_empty(df: DataFrame, **default) -> DataFrame:
    """One row of defaults (nulls where none is given) if there is no other."""
    types = dict(df.dtypes)
    row = df.sparkSession.range(1).select(*[F.lit(default.get(c)).cast(types[c]).alias(c) for c in df.columns])
    some = df.limit(1).select(F.lit(True).alias("__some"))
    return df.unionByName(row.join(F.broadcast(some), F.lit(True), "left_anti"))
