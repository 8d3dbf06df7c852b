"""Entities: keys, relations, discriminators, and schema text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass(frozen=True)
class Relation:
    """Children of an entity; ``bridge`` makes it many-to-many: ``(table, own columns, other columns)``."""

    name: str
    child: str
    parent_key: tuple[str, ...]
    child_key: tuple[str, ...]
    bridge: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    single: bool = False


@dataclass(frozen=True)
class Converter:
    """A column's two-way mapping between model and stored values."""

    to_model: Callable[[Column], Column]
    to_stored: Callable[[Column], Column]


@dataclass
class Entity:
    name: str
    table: str
    key: tuple[str, ...] = ()
    relations: dict[str, Relation] = field(default_factory=dict)
    columns: tuple[str, ...] | None = None
    converters: dict[str, Converter] = field(default_factory=dict)
    discriminator: tuple[str, object] | None = None
    tenant: str | None = None

    def has_many(self, name: str, child: str, parent_key, child_key, single: bool = False) -> Entity:
        self.relations[name] = Relation(name, child, _names(parent_key), _names(child_key), single=single)
        return self

    def many_to_many(self, name: str, child: str, parent_key, child_key, bridge: str, own, other) -> Entity:
        self.relations[name] = Relation(name, child, _names(parent_key), _names(child_key), (bridge, _names(own), _names(other)))
        return self


def _names(x) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


def create_table_sql(name: str, schema: T.StructType) -> str:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE `{name}` ({columns}) USING parquet"


def schema_changes(old: T.StructType, new: T.StructType) -> list[tuple[str, str, str | None]]:
    """``(action, column, type)`` that turn ``old`` into ``new``: add, drop, alter."""
    was, now = {f.name: f for f in old}, {f.name: f for f in new}
    out = [("drop", n, None) for n in was if n not in now]
    out += [("add", n, now[n].dataType.simpleString()) for n in now if n not in was]
    out += [("alter", n, now[n].dataType.simpleString()) for n in now if n in was and (was[n].dataType, was[n].nullable) != (now[n].dataType, now[n].nullable)]
    return out
