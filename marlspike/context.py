"""The context: entities, filters that hold at every scan, tenants, points in time, cached results."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Entity
from .query import Query
from .sources.tables import Tables
from .temporal import History
from .udf import Translations


class NoHistory(ValueError, LookupError):
    """A point in time was asked of an entity that keeps no versions."""


class Context:
    """Resolves names to queries. Filters are applied where a table is scanned, so joins, subqueries and includes have them too."""

    def __init__(self, spark: SparkSession, tables: Tables | str | None = None, tenant: object = None, tenant_column: str | None = None, strict: bool = False, client_evaluation: str = "throw"):
        self.spark = spark
        self.tables = tables if isinstance(tables, Tables) else Tables(spark, tables)
        self.tenant, self.tenant_column, self.strict = tenant, tenant_column, strict
        if client_evaluation not in ("throw", "warn", "allow"):
            raise ValueError("client_evaluation is throw, warn or allow")
        self.client_evaluation = "throw" if strict else client_evaluation
        self.functions = Translations(strict)
        self.entities: dict[str, Entity] = {}
        self.filters: dict[str, list[Callable[[DataFrame], Column]]] = {}
        self.histories: dict[str, History] = {}
        self.tags: dict[str, datetime] = {}
        self._cached: dict[int, tuple[float, DataFrame, frozenset[str]]] = {}

    # model

    def entity(self, name: str, table: str | None = None, key=(), **more) -> Entity:
        key = (key,) if isinstance(key, str) else tuple(key)
        self.entities[name] = Entity(name, table or name, key, **more)
        return self.entities[name]

    def add_filter(self, name: str, predicate: Callable[[DataFrame], Column]) -> None:
        self.filters.setdefault(name, []).append(predicate)

    def add_history(self, name: str, history: History) -> None:
        self.histories[name] = history

    def tag(self, name: str, at: datetime) -> None:
        self.tags[name] = at

    # scans

    def scan(self, name: str, ignore_filters: bool = False, as_of: datetime | str | None = None) -> DataFrame:
        """A table with all that holds for it. The tenant's filter and a discriminator stay even if filters are ignored."""
        entity = self.entities.get(name) or Entity(name, name)
        if as_of is not None:
            if name not in self.histories:
                raise NoHistory(f"{name} has no history to read at {as_of}")
            df = self.histories[name].as_of(self.tags[as_of] if isinstance(as_of, str) else as_of)
        else:
            df = self.tables.read(entity.table)
        tenant_column = entity.tenant or self.tenant_column
        if tenant_column and tenant_column in df.columns:
            # without a tenant nothing is visible
            df = df.filter(F.col(tenant_column) == F.lit(self.tenant)) if self.tenant is not None else df.limit(0)
        if entity.discriminator:
            column, value = entity.discriminator
            df = df.filter(F.col(column) == F.lit(value))
        for column, converter in entity.converters.items():
            df = df.withColumn(column, converter.to_model(F.col(column)))
        if entity.columns:
            df = df.select(*entity.columns)
        for predicate in () if ignore_filters else self.filters.get(name, ()):
            df = df.filter(predicate(df))
        return df

    def query(self, name: str, ignore_filters: bool = False, as_of: datetime | str | None = None) -> Query:
        entity = self.entities.get(name)
        return Query(self.scan(name, ignore_filters, as_of), context=self, entity=name, key=entity.key if entity else (), ignore_filters=ignore_filters, moment=self.tags[as_of] if isinstance(as_of, str) else as_of, tables=frozenset({name, entity.table if entity else name}))

    set = query

    def derived(self, base: str, name: str, column: str, value: object) -> Query:
        """The rows of ``base`` that are of a derived type."""
        q = self.query(base)
        return q.where(F.col(column) == F.lit(value)).named(name)

    def from_sql(self, sql: str, *args, entity: str | None = None, **named) -> Query:
        """A SELECT as a source; the filters of ``entity`` hold for its rows."""
        if self.strict:
            raise PermissionError("raw SQL is off in strict contexts")
        df = self.spark.sql(sql, args=list(args) or named or None)
        column = (self.entities[entity].tenant if entity in self.entities else None) or self.tenant_column
        if column and column in df.columns:
            df = df.filter(F.col(column) == F.lit(self.tenant)) if self.tenant is not None else df.limit(0)
        for predicate in self.filters.get(entity, ()):
            df = df.filter(predicate(df))
        # any table may be behind raw SQL, so any change ends what was cached of it
        return Query(df, context=self, entity=entity, key=self.entities[entity].key if entity in self.entities else (), tables=frozenset({"*", entity or "*"}))

    def sql(self, sql: str, **named) -> DataFrame:
        """A SELECT as it is, without filters."""
        if self.strict:
            raise PermissionError("raw SQL is off in strict contexts")
        return self.spark.sql(sql, args=named or None)

    def execute_sql(self, sql: str, **named) -> list:
        """A statement that changes catalogue tables or views; what was cached of them is forgotten. Gives the rows it reports, if any."""
        out = self.sql(sql, **named).collect()
        for _, held, _ in self._cached.values():
            held.unpersist()
        self._cached.clear()
        return out

    def found(self, name: str, *key) -> DataFrame:
        """The row of a key, if it is there."""
        return self.query(name).where(*[F.col(k) == F.lit(v) for k, v in zip(self.entities[name].key, key, strict=True)]).first_rows()

    def find(self, name: str, *key):
        return self.found(name, *key).first()

    # results kept for a while

    def cached(self, df: DataFrame, seconds: float, tables: frozenset[str] = frozenset()) -> DataFrame:
        """``df`` persisted; an equal plan within ``seconds`` gets the same frame."""
        key, now = df.semanticHash(), time.monotonic()
        for k, (until, held, _) in list(self._cached.items()):
            if until <= now:
                held.unpersist()
                del self._cached[k]
        if key in self._cached and self._cached[key][1].sameSemantics(df):
            return self._cached[key][1]
        self._cached[key] = (now + seconds, df.persist(), tables)
        return self._cached[key][1]

    def changed(self, table: str) -> None:
        """Forget what was cached of ``table``."""
        for k, (_, held, tables) in list(self._cached.items()):
            if table in tables or "*" in tables:
                held.unpersist()
                del self._cached[k]


def compile_query(build: Callable[..., Query], size: int = 128) -> Callable[..., Query]:
    """A query with parameters: ``build(context, *args)``.

    The analysed query is kept for each context and arguments (the last ``size`` of them), so a
    repeated call does no more than run it. Changed tables, filters or tenants need a new context.
    """
    held: OrderedDict = OrderedDict()

    def run(context, *args):
        key = (id(context), args)
        if key not in held:
            held[key] = context, build(context, *args)  # with the context, so its id stays its own
            while len(held) > size:
                held.popitem(last=False)
        held.move_to_end(key)
        return held[key][1]

    return run
