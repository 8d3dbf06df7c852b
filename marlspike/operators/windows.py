"""Numbering and offsets over the whole ordered sequence.

A sequence has one order and no partition, so a window function would bring all rows to one
task. Places counted over sorted partitions give the same: a row's number is its place, its
rank that of the first row with its keys, and its neighbours are found by their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import POSITION, Key, positions


def _need(order: tuple[Key, ...]) -> tuple[Key, ...]:
    if not order:
        raise ValueError("a window needs an order")
    return order


def row_number(df: DataFrame, order, name: str = "row_number") -> DataFrame:
    return positions(df, _need(order)).select(*df.columns, (F.col(POSITION) + 1).alias(name))


def _by_keys(df: DataFrame, order, numbers: DataFrame, name: str) -> DataFrame:
    """``numbers``: ``k0, ..`` and the number of each combination of keys, joined to all rows that have it."""
    on = [df[f"`{k.column}`"].eqNullSafe(numbers[f"k{i}"]) for i, k in enumerate(order)]
    return df.join(numbers, on).select(*[df[f"`{c}`"] for c in df.columns], numbers["n"].alias(name))


def _keys(order) -> list[Column]:
    return [F.col(f"`{k.column}`").alias(f"k{i}") for i, k in enumerate(order)]


def rank(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """One more than the rows before; the keys' first places are aggregated before they are joined, so ties do not gather."""
    # rows of equal keys are dealt by their other columns, or they would be sorted by one task
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    placed = positions(df.withColumn("__tie", tie), (*_need(order), Key("__tie"))).drop("__tie")
    first = placed.groupBy(*_keys(order)).agg((F.min(POSITION) + 1).alias("n"))
    return _by_keys(placed, order, first, name).drop(POSITION)


def dense_rank(df: DataFrame, order, name: str = "dense_rank") -> DataFrame:
    """The number of the keys among the different ones."""
    different = df.select(*_keys(_need(order))).distinct()
    numbered = positions(different, tuple(Key(f"k{i}", k.descending) for i, k in enumerate(order)))
    return _by_keys(df, order, numbered.withColumn("n", F.col(POSITION) + 1), name)


def _offset(df: DataFrame, order, value: Column, n: int, default: Column | None, name: str) -> DataFrame:
    placed = positions(df, _need(order))
    there = placed.select((F.col(POSITION) + n).alias("at"), F.struct(value.alias("v")).alias("there"))
    joined = placed.join(there, placed[POSITION] == there["at"], "left")
    # a default expression holds only where there is no such row, not where its value is null
    moved = F.col("there.v") if default is None else F.when(F.col("there").isNotNull(), F.col("there.v")).otherwise(default)
    return joined.select(*[placed[f"`{c}`"] for c in df.columns], moved.alias(name))


def lag(df: DataFrame, order, value: Column, n: int = 1, default: Column | None = None, name: str = "lag") -> DataFrame:
    if n < 0:
        raise ValueError("the offset must not be negative")
    return _offset(df, order, value, n, default, name)


def lead(df: DataFrame, order, value: Column, n: int = 1, default: Column | None = None, name: str = "lead") -> DataFrame:
    if n < 0:
        raise ValueError("the offset must not be negative")
    return _offset(df, order, value, -n, default, name)
