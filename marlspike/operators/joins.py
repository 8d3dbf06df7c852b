"""Joins. Null keys never match; a group join keeps outer rows without matches with an empty list."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .ordering import POSITION, Key, positions


def on_keys(left: list[str], right: list[str]) -> list[Column]:
    return [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in zip(left, right, strict=True)]


def join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str = "inner") -> DataFrame:
    """Both sides under the aliases ``l`` and ``r``."""
    return left.alias("l").join(right.alias("r"), on_keys(left_keys, right_keys), how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    return left.alias("l").join(right.alias("r"), condition, how)


#: Rows of a block at most. Two blocks make up to the square of it in pairs; a task of ``below_join`` makes about so many.
BLOCK, PAIRS_OF_TASK, MOST_TASKS = 1024, 8_000_000, 20_000


def below_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], low: Column, high: Column) -> DataFrame:
    """Pairs of rows with equal keys, ``low`` of the left one less than ``high`` of the right one, under the aliases ``l`` and ``r``.

    Both sides are sorted by keys and value and cut into blocks. Only blocks of which some rows are pairs meet, so what is compared
    is what is returned and the edges; tasks get meetings of blocks, not keys, so a few large keys still make many tasks.
    """
    a, first = _blocks(left, left_keys, low)
    b, second = _blocks(right, right_keys, high)
    meet = first.alias("l").join(second.alias("r"), [F.col(f"l.__k{k}") == F.col(f"r.__k{k}") for k in range(len(left_keys))] + [F.col("l.__least") < F.col("r.__most")])
    sides = [F.struct(*[F.col(f"{s}.__k{k}") for k in range(len(left_keys))], F.col(f"{s}.__block")).alias(s) for s in "lr"]
    work = F.col("l.__n") * F.col("r.__n") + F.col("l.__n") + F.col("r.__n")
    met = written(meet.select(F.monotonically_increasing_id().alias("__meeting"), *sides, work.alias("__work")))
    tasks = min(MOST_TASKS, max(1, math.ceil((met.agg(F.sum(F.col("__work").cast("double"))).first()[0] or 0) / PAIRS_OF_TASK)))

    def dealt(rows: DataFrame, columns: list[str], keys: list[str], side: str) -> DataFrame:
        own = met.select("__meeting", *[F.col(f"{side}.__k{k}").alias(f"__k{k}") for k in range(len(keys))], F.col(f"{side}.__block").alias("__of"))
        on = [F.col(f"x.{c}") == F.col(f"m.__k{k}") for k, c in enumerate(keys)] + [F.col("x.__block") == F.col("m.__of")]
        return rows.alias("x").join(own.alias("m"), on).select(*[F.col(f"x.`{c}`") for c in columns], "x.__value", "m.__meeting").repartition(tasks, "__meeting")

    # merged, so that no more than a block is held; dealt to a given number of tasks, which are not joined for their few bytes
    l, r = dealt(a, left.columns, left_keys, "l").hint("merge"), dealt(b, right.columns, right_keys, "r")
    pairs = l.alias("l").join(r.alias("r"), (F.col("l.__meeting") == F.col("r.__meeting")) & (F.col("l.__value") < F.col("r.__value")))
    return pairs.drop("__meeting", "__value")


def _blocks(df: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that may be in pairs, with ``__value`` and ``__block``, and each block of each key: its rows and its least and greatest value."""
    rows = df.withColumn("__value", value)
    for c in [*keys, "__value"]:
        rows = rows.filter(F.col(c).isNotNull())
    placed = positions(rows, tuple(map(Key, [*keys, "__value"]))).withColumn("__block", F.floor(F.col(POSITION) / BLOCK).cast("long")).drop(POSITION)
    edges = placed.groupBy(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(keys)], "__block")
    return placed, edges.agg(F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__least"), F.max("__value").alias("__most"))


def group_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], fields: list[str], name: str = "items", order: list[str] | None = None) -> DataFrame:
    """Each outer row with the list of its matches. Matches are gathered by key before the join, so outer rows are not repeated."""
    lists = gathered(right, right_keys, fields, name, order)
    out = left.alias("l").join(lists.alias("r"), [F.col(f"l.{a}") == F.col(f"r.__k{k}") for k, a in enumerate(left_keys)], "left")
    return out.select("l.*", F.coalesce(F.col(f"r.{name}"), F.array().cast(lists.schema[name].dataType)).alias(name))


def gathered(df: DataFrame, keys: list[str], fields: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """``__k0, .., name``: for each key the list of its rows' ``fields``, sorted by ``order`` (the fields if none is given)."""
    sort = [F.col(c).alias(f"__o{k}") for k, c in enumerate(order or [])]
    item = F.struct(*sort, *fields)
    grouped = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sort_array(F.collect_list(item)).alias(name))
    if not sort:
        return grouped
    return grouped.withColumn(name, F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields])))
