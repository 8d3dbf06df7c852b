"""Predicates with two-valued logic over nullable columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_true(pred: Column) -> Column:
    """``pred``, where unknown counts as false."""
    return F.coalesce(pred, F.lit(False))


def not_(pred: Column) -> Column:
    """The rows that ``pred`` does not accept, unknown ones included."""
    return ~is_true(pred)


def equal(a: Column | str, b: Column | str) -> Column:
    """Equality under which null equals null."""
    return col(a).eqNullSafe(col(b))


def not_equal(a: Column | str, b: Column | str) -> Column:
    return ~col(a).eqNullSafe(col(b))


def contained(c: Column | str, values: Iterable) -> Column:
    """Membership in a local collection; a null in it matches null."""
    values = list(values)
    known = [v for v in values if v is not None]
    found = is_true(col(c).isin(known)) if known else F.lit(False)
    return found | col(c).isNull() if len(known) < len(values) else found


def contains_key(c: Column | str, mapping: dict) -> Column:
    return contained(c, mapping.keys())


def contains_value(c: Column | str, mapping: dict) -> Column:
    return contained(c, mapping.values())


def choose(condition: Column, then, otherwise) -> Column:
    return F.when(is_true(condition), then).otherwise(otherwise)


def value_or(c: Column | str, default) -> Column:
    return F.coalesce(col(c), F.lit(default) if not isinstance(default, Column) else default)
