"""Positional operators: windows of a sequence, while-clauses, chunks, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expr import not_
from .ordering import POSITION, Key, positions, precedes, reverse, sorts


def take(df: DataFrame, order, n: int) -> DataFrame:
    return (df.orderBy(*sorts(order)) if order else df).limit(max(0, n))


#: Up to so many rows are skipped by finding the last of them; beyond, by the places of all rows.
NEAR = 10_000


def page(df: DataFrame, order, n: int, size: int) -> DataFrame:
    """``size`` rows after the first ``n``: the first ``n + size`` of each partition, merged."""
    return (df.orderBy(*sorts(order)) if order else df).offset(max(0, n)).limit(max(0, size))


def skip(df: DataFrame, order, n: int, unique: bool = False) -> DataFrame:
    """All rows but the first ``n``. ``unique``: no two rows have the same place in the order."""
    if n <= 0:
        return df
    if unique and order and n <= NEAR:
        keys = [F.col(f"`{k.column}`").alias(f"k{i}") for i, k in enumerate(order)]
        first = df.orderBy(*sorts(order)).limit(n).select(*keys)
        sides = [Key(f"k{i}", not k.descending) for i, k in enumerate(order)]
        last = first.orderBy(*sorts(tuple(sides))).limit(1).select(F.struct(*[F.col(f"k{i}").alias(k.column) for i, k in enumerate(order)]).alias("__bound"))
        # one row, or none if there are no rows at all
        same = F.lit(True)
        for k in order:
            same &= F.col(f"`{k.column}`").eqNullSafe(F.col("__bound")[k.column])
        return df.join(F.broadcast(last), F.lit(True)).filter(~precedes(order, "__bound") & ~same).drop("__bound")
    return positions(df, order).filter(F.col(POSITION) >= n).drop(POSITION)


def take_last(df: DataFrame, order, n: int) -> DataFrame:
    return take(df, reverse(order), n)


def skip_last(df: DataFrame, order, n: int, unique: bool = False) -> DataFrame:
    return skip(df, reverse(order), n, unique)


def first_failing(df: DataFrame, order: tuple[Key, ...], pred: Column) -> DataFrame:
    """The order keys of the first row that ``pred`` does not accept, as a struct; no row if there is none."""
    return df.filter(not_(pred)).orderBy(*sorts(order)).limit(1).select(F.struct(*[F.col(k.column) for k in order]).alias("__bound"))


def take_while(df: DataFrame, order: tuple[Key, ...], pred: Column) -> DataFrame:
    """The rows before the first that ``pred`` does not accept; the order must have no ties."""
    bound = first_failing(df, order, pred)  # one row
    joined = df.join(F.broadcast(bound), F.lit(True), "left")
    return joined.filter(F.col("__bound").isNull() | precedes(order, "__bound")).drop("__bound")


def skip_while(df: DataFrame, order: tuple[Key, ...], pred: Column) -> DataFrame:
    bound = first_failing(df, order, pred)
    return df.join(F.broadcast(bound), F.lit(True)).filter(~precedes(order, "__bound")).drop("__bound")


def indexed_while(df: DataFrame, order: tuple[Key, ...], pred, skipping: bool) -> DataFrame:
    """While-clauses whose predicate also sees the place: ``pred(position column)``."""
    placed = positions(df, order)
    place = (Key(POSITION),)
    return (skip_while if skipping else take_while)(placed, place, pred(F.col(POSITION))).drop(POSITION)


def chunk(df: DataFrame, order: tuple[Key, ...], n: int, fields: list[str]) -> DataFrame:
    """``chunk, items``: structs of the ``fields`` of ``n`` neighbouring rows in order, the last may be shorter."""
    placed = positions(df, order)
    item = F.struct(POSITION, *fields)
    grouped = placed.groupBy(F.floor(F.col(POSITION) / n).cast("long").alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("chunk", F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("items"))


def zip_with(left: DataFrame, left_order, right: DataFrame, right_order, left_fields: list[str], right_fields: list[str]) -> DataFrame:
    """Rows of equal places side by side, as structs ``first`` and ``second``; the shorter sequence ends it."""
    a = positions(left, left_order).select(POSITION, F.struct(*left_fields).alias("first"))
    b = positions(right, right_order).select(POSITION, F.struct(*right_fields).alias("second"))
    return a.join(b, POSITION)


def sequence_differences(left: DataFrame, left_order, right: DataFrame, right_order, left_fields: list[str], right_fields: list[str]) -> DataFrame:
    """Places at which two sequences differ, or where only one has a row."""
    a = positions(left, left_order).select(POSITION, F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(left_fields)]).alias("first"))
    b = positions(right, right_order).select(POSITION, F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(right_fields)]).alias("second"))
    return a.join(b, POSITION, "full").filter(~F.col("first").eqNullSafe(F.col("second")) | F.col("first").isNull() | F.col("second").isNull())
