"""Order keys: what a frame lacks to be a sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expr import is_true
from ..sources.tables import written

POSITION = "__position"


@dataclass(frozen=True)
class Key:
    """A column to order by. Nulls are the smallest values."""

    column: str
    descending: bool = False

    @property
    def sort(self) -> Column:
        c = F.col(f"`{self.column}`")
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()

    def reversed(self) -> Key:
        return Key(self.column, not self.descending)


def sorts(order: tuple[Key, ...]) -> list[Column]:
    return [k.sort for k in order]


def reverse(order: tuple[Key, ...]) -> tuple[Key, ...]:
    return tuple(k.reversed() for k in order)


def precedes(order: tuple[Key, ...], bound: str) -> Column:
    """Whether a row comes before the row in the struct column ``bound``."""
    out = F.lit(False)
    for k in reversed(order):
        mine, theirs = F.col(f"`{k.column}`"), F.col(bound)[k.column]
        a, b = (theirs, mine) if k.descending else (mine, theirs)
        less = is_true(a < b) | (a.isNull() & b.isNotNull())
        out = less | (mine.eqNullSafe(theirs) & out)
    return out


def positions(df: DataFrame, order: tuple[Key, ...]) -> DataFrame:
    """``df`` with the place of each row from 0, found without bringing the rows to one task.

    Rows are sorted over all partitions and written; the number of rows before each
    partition, a row for each partition, then completes the places within them.
    """
    sorted_ = df.orderBy(*sorts(order)) if order else df
    number = F.monotonically_increasing_id()
    held = written(sorted_.withColumn("__number", number))
    part = F.shiftright("__number", 33)
    own = F.col("__number").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = held.withColumn("__part", part).join(F.broadcast(before.select("__part", "__before")), "__part")
    return placed.withColumn(POSITION, F.coalesce("__before", F.lit(0)) + own).select(*df.columns, POSITION)
