"""Aggregates with the conventions of sequences: a sum of nothing is 0, conditions are two-valued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expr import is_true
from .ordering import Key, sorts


def count(where: Column | None = None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count_if(is_true(where))


def total(x: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(x if where is None else F.when(is_true(where), x)), F.lit(0))


def average(x: Column, where: Column | None = None) -> Column:
    return F.avg(x if where is None else F.when(is_true(where), x))


def least(x: Column, where: Column | None = None) -> Column:
    return F.min(x if where is None else F.when(is_true(where), x))


def greatest(x: Column, where: Column | None = None) -> Column:
    return F.max(x if where is None else F.when(is_true(where), x))


def distinct_count(x: Column, where: Column | None = None) -> Column:
    return F.count_distinct(x if where is None else F.when(is_true(where), x))


def distinct_total(x: Column) -> Column:
    return F.coalesce(F.sum_distinct(x), F.lit(0))


def only(x: Column) -> Column:
    """The value of the group's one row; raises where the group has several."""
    several = F.count(F.lit(1)) > 1
    return F.when(several, F.raise_error(F.lit("more than one row in a group"))).otherwise(F.first(x))


def any_of(pred: Column) -> Column:
    return F.coalesce(F.bool_or(is_true(pred)), F.lit(False))


def all_of(pred: Column, where: Column | None = None) -> Column:
    """Rows outside ``where`` satisfy it vacuously."""
    ok = is_true(pred) if where is None else ~is_true(where) | is_true(pred)
    return F.coalesce(F.bool_and(ok), F.lit(True))


def joined_text(x: Column, separator: str, order: Column | None = None) -> Column:
    """Values as text in the order of ``order`` (or of the values), joined; nulls are skipped."""
    key = x if order is None else order
    pairs = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(key.alias("k"), x.cast("string").alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def nth_of_group(df: DataFrame, keys: list[str], order: tuple[Key, ...], n: int = 1) -> DataFrame:
    """The ``n``-th row of each group in order. Null keys come first, unlike in ``min_by``."""
    w = Window.partitionBy(*keys).orderBy(*sorts(order))
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") == n).drop("__rank")


def fold_sum(x: Column, seed=0) -> Column:
    return F.lit(seed) + total(x)


def fold_max(x: Column, seed=None) -> Column:
    return F.max(x) if seed is None else F.greatest(F.max(x), F.lit(seed))


def fold_min(x: Column, seed=None) -> Column:
    return F.min(x) if seed is None else F.least(F.min(x), F.lit(seed))


def fold_concat(x: Column, order: Column, separator: str = "", seed: str = "") -> Column:
    return F.concat(F.lit(seed), joined_text(x, separator, order))


def with_children(parents: DataFrame, children: DataFrame, key: list[str], child_key: list[str], **aggregates: Column) -> DataFrame:
    """Parents with aggregates over their children, which are combined by key before the join. Counts and sums of none are 0."""
    by = children.groupBy(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(child_key)]).agg(*[a.alias(n) for n, a in aggregates.items()])
    out = parents.join(by, [parents[p] == by[f"__k{k}"] for k, p in enumerate(key)], "left")
    return out.drop(*[f"__k{k}" for k in range(len(key))])
