"""Related rows as nested lists: filtered, ordered, the first few of each parent, over several levels or a bridge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import gathered
from .ordering import Key, sorts


def first_per_parent(children: DataFrame, keys: list[str], order: tuple[Key, ...], n: int | None, skip: int = 0) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*sorts(order))
    ranked = children.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") > skip)
    return (ranked if n is None else ranked.filter(F.col("__rank") <= skip + n)).drop("__rank")


def include(
    parents: DataFrame,
    children: DataFrame,
    parent_key: list[str],
    child_key: list[str],
    name: str,
    fields: list[str] | None = None,
    where: Column | None = None,
    order: tuple[Key, ...] = (),
    take: int | None = None,
    skip: int = 0,
) -> DataFrame:
    """``parents`` with the column ``name``: the list of its children, empty without any. Order defaults to the fields."""
    fields = fields or list(children.columns)
    if where is not None:
        children = children.filter(where)
    if take is not None or skip:
        children = first_per_parent(children, child_key, order or tuple(Key(f) for f in fields), take, skip)
    if any(k.descending for k in order):
        w = Window.partitionBy(*child_key).orderBy(*sorts(order))
        children = children.withColumn("__place", F.row_number().over(w))
        by = ["__place"]
    else:
        by = [k.column for k in order]
    lists = gathered(children, child_key, fields, name, by or None)
    out = parents.alias("p").join(lists.alias("c"), [F.col(f"p.{p}") == F.col(f"c.__k{k}") for k, p in enumerate(parent_key)], "left")
    return out.select("p.*", F.coalesce(F.col(f"c.{name}"), F.array().cast(lists.schema[name].dataType)).alias(name))


def include_many(parents: DataFrame, bridge: DataFrame, others: DataFrame, parent_key: list[str], own: list[str], other: list[str], other_key: list[str], name: str, fields: list[str], **more) -> DataFrame:
    """Many-to-many: the other entities that ``bridge`` names for a parent, each once."""
    pairs = bridge.select(*[F.col(c).alias(f"__own{k}") for k, c in enumerate(own)], *[F.col(c).alias(f"__other{k}") for k, c in enumerate(other)]).distinct()
    related = pairs.join(others, [pairs[f"__other{k}"] == others[c] for k, c in enumerate(other_key)])
    return include(parents, related, parent_key, [f"__own{k}" for k in range(len(own))], name, fields, **more)
