"""The fluent query: a frame, the order its rows have, and where it comes from. Queries never change; each call gives a new one."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import streaming
from .expr import is_true, not_
from .functions.dates import by_instant
from .operators import grouping, include, joins, sequence, sets, windows
from .operators.ordering import Key, reverse, sorts


class NoElement(LookupError):
    """The sequence has no such row."""


class MoreThanOne(LookupError):
    """The sequence has several rows where one was asked for."""


def _keys(columns, descending: bool) -> tuple[Key, ...]:
    return tuple(c if isinstance(c, Key) else Key(c, descending) for c in columns)


EDGE = "__edge"


@dataclass(frozen=True)
class Query:
    """``rows`` is ``df`` and, after ``append`` or ``prepend``, a column that orders the added rows."""

    rows: DataFrame
    order: tuple[Key, ...] = ()
    context: object = None
    entity: str | None = None
    key: tuple[str, ...] = ()
    ignore_filters: bool = False
    moment: object = None
    label: str | None = field(default=None, compare=False)
    tables: frozenset[str] = frozenset()
    edges: int = 0
    #: After ``skip``: what it gave, and the rows, order and number it had.
    skipped: tuple | None = field(default=None, compare=False)

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(EDGE) if EDGE in self.rows.columns else self.rows

    def _with(self, df: DataFrame, *others: Query, **more) -> Query:
        """``others`` are the queries whose rows ``df`` has too: they are of the same point in time, and their tables count."""
        for other in others:
            self._same_moment(other)
        if EDGE not in df.columns:
            more["order"] = tuple(k for k in more.get("order", self.order) if k.column != EDGE)
        tables = self.tables.union(*(o.tables for o in others))
        return replace(self, rows=df, tables=tables, skipped=None, **more)

    def _same_moment(self, other: Query) -> None:
        """A statement has one point in time; a side without history has only the present, and fits to any."""
        mine, theirs = self.moment, other.moment
        versioned = [q for q in (self, other) if q.context is not None and q.tables & q.context.histories.keys()]
        if mine != theirs and (len(versioned) == 2 or (mine is not None and theirs is not None)):
            raise ValueError(f"one statement at two points in time: {mine} and {theirs}")

    def named(self, entity: str) -> Query:
        return replace(self, entity=entity)

    # modifiers

    def ignoring_filters(self) -> Query:
        """The same root without user filters; call it before other operators."""
        return self.context.query(self.entity, ignore_filters=True, as_of=self.moment)

    def as_of(self, moment) -> Query:
        """The same root at another point in time; one query has one point in time."""
        moment = self.context.tags[moment] if isinstance(moment, str) else moment
        if self.moment is not None and self.moment != moment:
            raise ValueError("a query has one point in time")
        return self.context.query(self.entity, self.ignore_filters, moment)

    def tag_with(self, text: str) -> Query:
        return replace(self, label=text)

    def as_no_tracking(self) -> Query:
        return self

    as_tracking = as_split_query = as_no_tracking

    def cacheable(self, seconds: float) -> Query:
        return self._with(self.context.cached(self.rows, seconds, self.tables))

    def to_query_string(self) -> str:
        return ("-- " + self.label + "\n" if self.label else "") + self.df._jdf.queryExecution().optimizedPlan().toString()

    # projection and filter

    def where(self, *predicates: Column) -> Query:
        df = self.rows
        for p in predicates:
            df = df.filter(p)
        return self._with(df)

    def select(self, *columns, **computed: Column) -> Query:
        """Projected columns; order keys that are no longer there end the order."""
        edge = [EDGE] if EDGE in self.rows.columns and "*" not in columns else []
        df = self.rows.select(*columns, *[c.alias(n) for n, c in computed.items()], *edge)
        kept = []
        for k in self.order:
            if k.column not in df.columns:
                break
            kept.append(k)
        return self._with(df, order=tuple(kept), key=self.key if set(self.key) <= set(df.columns) else ())

    def of_type(self, column: str, value) -> Query:
        return self.where(F.col(column) == F.lit(value))

    def cast_type(self, column: str, value) -> Query:
        """As ``of_type``, but a row of another type raises."""
        wrong = F.raise_error(F.concat(F.lit(f"not of type {value}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        return self.where(F.when(F.col(column).eqNullSafe(F.lit(value)), True).otherwise(wrong.cast("boolean")))

    # order

    def order_by(self, *columns, descending: bool = False) -> Query:
        return replace(self, order=_keys(columns, descending))

    def then_by(self, *columns, descending: bool = False) -> Query:
        return replace(self, order=self.order + _keys(columns, descending))

    def reverse(self) -> Query:
        return replace(self, order=reverse(self.total_order()))

    def total_order(self) -> tuple[Key, ...]:
        """The order, with the entity's key to break ties."""
        have = {k.column for k in self.order}
        return self.order + tuple(Key(k) for k in self.key if k not in have)

    def _need_order(self) -> tuple[Key, ...]:
        order = self.total_order()
        if not order:
            raise ValueError("this operator needs an order")
        return order

    # windows of the sequence

    def take(self, n: int) -> Query:
        if self.skipped and self.skipped[0] is self.rows and self.skipped[2] == self.total_order():
            _, rows, order, skip = self.skipped
            return self._with(sequence.page(rows, order, skip, n))
        return self._with(sequence.take(self.rows, self.total_order(), n))

    def skip(self, n: int) -> Query:
        order = self.total_order()
        out = self._with(sequence.skip(self.rows, order, n, self._unique()))
        return replace(out, skipped=(out.rows, self.rows, order, n))

    def _unique(self) -> bool:
        return bool(self.key) and set(self.key) <= set(self.rows.columns) and EDGE not in self.rows.columns

    def take_last(self, n: int) -> Query:
        return self._with(sequence.take_last(self.rows, self._need_order(), n))

    def skip_last(self, n: int) -> Query:
        return self._with(sequence.skip_last(self.rows, self._need_order(), n, self._unique()))

    def take_while(self, pred: Column | Callable[[Column], Column]) -> Query:
        """A callable also gets the place of the row."""
        order = self._need_order()
        return self._with(sequence.take_while(self.rows, order, pred) if isinstance(pred, Column) else sequence.indexed_while(self.rows, order, pred, False))

    def skip_while(self, pred: Column | Callable[[Column], Column]) -> Query:
        order = self._need_order()
        return self._with(sequence.skip_while(self.rows, order, pred) if isinstance(pred, Column) else sequence.indexed_while(self.rows, order, pred, True))

    def chunk(self, n: int) -> DataFrame:
        return sequence.chunk(self.rows, self._need_order(), n, self.df.columns)

    def zip(self, other: Query) -> DataFrame:
        self._same_moment(other)
        return sequence.zip_with(self.rows, self._need_order(), other.rows, other._need_order(), self.df.columns, other.df.columns)

    def sequence_equal(self, other: Query) -> bool:
        return self.differences(other).isEmpty()

    def differences(self, other: Query) -> DataFrame:
        """The places at which two sequences differ."""
        self._same_moment(other)
        return sequence.sequence_differences(self.rows, self._need_order(), other.rows, other._need_order(), self.df.columns, other.df.columns)

    def append(self, **values) -> Query:
        return self._edge(values, 1)

    def prepend(self, **values) -> Query:
        return self._edge(values, -1)

    def _edge(self, values: dict, side: int) -> Query:
        """The added row comes last or first whatever its values: a side column leads the order."""
        row = self.df.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in self.df.dtypes])
        df = self.rows if EDGE in self.rows.columns else self.rows.withColumn(EDGE, F.lit(0))
        end = side * (1 + sum(k.column == EDGE for k in self.order) + self.edges)
        order = self.order if self.order[:1] == (Key(EDGE),) else (Key(EDGE), *self.total_order())
        return self._with(df.unionByName(row.withColumn(EDGE, F.lit(end))), order=order, edges=self.edges + 1)

    # sets

    def distinct(self) -> Query:
        return self._with(self.df.distinct())

    def union(self, other: Query) -> Query:
        return self._with(self.df.union(sets.same_columns(self.df, other.df)).distinct(), other, key=())

    def concat(self, other: Query) -> Query:
        return self._with(self.df.union(sets.same_columns(self.df, other.df)), other, key=())

    def intersect(self, other: Query) -> Query:
        return self._with(self.df.intersect(sets.same_columns(self.df, other.df)), other)

    def except_(self, other: Query) -> Query:
        return self._with(self.df.subtract(sets.same_columns(self.df, other.df)), other)

    def distinct_by(self, *keys: str) -> Query:
        return self._with(sets.distinct_by(self.rows, self.total_order(), list(keys)))

    def except_by(self, other: Query, *keys: str) -> Query:
        return self._with(sets.except_by(self.rows, self.total_order(), list(keys), other.df), other)

    def intersect_by(self, other: Query, *keys: str) -> Query:
        return self._with(sets.intersect_by(self.rows, self.total_order(), list(keys), other.df), other)

    def union_by(self, other: Query, *keys: str) -> Query:
        order = tuple(k for k in self.total_order() if k.column != EDGE)
        return self._with(sets.union_by(self.df, order, other.df, list(keys)), other, key=())

    def default_if_empty(self, **default) -> Query:
        return self._with(sets.default_if_empty(self.df, **default))

    # joins

    def join(self, other: Query, left_keys, right_keys, how: str = "inner") -> DataFrame:
        self._same_moment(other)
        return joins.join(self.df, other.df, _list(left_keys), _list(right_keys), how)

    def left_join(self, other: Query, left_keys, right_keys) -> DataFrame:
        return self.join(other, left_keys, right_keys, "left")

    def cross(self, other: Query) -> DataFrame:
        self._same_moment(other)
        return self.df.alias("l").crossJoin(other.df.alias("r"))

    def select_many(self, other: Query, condition: Column, default_if_empty: bool = False) -> DataFrame:
        """Pairs that satisfy any condition over the aliases ``l`` and ``r``."""
        self._same_moment(other)
        return joins.theta_join(self.df, other.df, condition, "left" if default_if_empty else "inner")

    def join_below(self, other: Query, left_keys, right_keys, low: Column, high: Column) -> DataFrame:
        """Pairs of equal keys with ``low`` (over this query's columns) less than ``high`` (over the other's). For keys of many
        rows: ``select_many`` compares all rows of a key, in one task."""
        self._same_moment(other)
        return joins.below_join(self.df, other.df, _list(left_keys), _list(right_keys), low, high)

    def where_any(self, other: Query, left_keys, right_keys) -> Query:
        return self._with(joins.join(self.rows, other.df, _list(left_keys), _list(right_keys), "left_semi"), other)

    def where_none(self, other: Query, left_keys, right_keys) -> Query:
        return self._with(joins.join(self.rows, other.df, _list(left_keys), _list(right_keys), "left_anti"), other)

    def where_all(self, other: Query, left_keys, right_keys, pred: Column) -> Query:
        """Rows all of whose matches satisfy ``pred``."""
        return self.where_none(other.where(not_(pred)), left_keys, right_keys)

    def group_join(self, other: Query, left_keys, right_keys, fields: list[str], name: str = "items") -> Query:
        return self._with(joins.group_join(self.df, other.df, _list(left_keys), _list(right_keys), fields, name, [k.column for k in other.order] or None), other)

    def include(self, relation: str, fields: list[str] | None = None, where: Column | None = None, order: tuple[Key, ...] = (), take: int | None = None, skip: int = 0, then: Callable[[Query], Query] | None = None) -> Query:
        """A declared relation as a nested list; ``then`` shapes the children's query, including what they include."""
        r = self.context.entities[self.entity].relations[relation]
        children = self.context.query(r.child, self.ignore_filters, self.moment)
        if then is not None:
            children = then(children)
        more = {"where": where, "order": order, "take": take, "skip": skip}
        read = [children]
        if r.bridge:
            bridge, own, other = r.bridge
            read.append(self.context.query(bridge, self.ignore_filters, self.moment))
            df = include.include_many(self.df, read[1].df, children.df, list(r.parent_key), list(own), list(other), list(r.child_key), relation, fields or list(children.df.columns), **more)
        else:
            df = include.include(self.df, children.df, list(r.parent_key), list(r.child_key), relation, fields, **more)
        return self._with(df.withColumn(relation, F.get(relation, F.lit(0))) if r.single else df, *read)

    def flatten(self, relation: str, *fields: str, default_if_empty: bool = False) -> Query:
        """A row for each row that a declared relation gives, with its ``fields`` beside the columns here; parents without any stay on demand."""
        r = self.context.entities[self.entity].relations[relation]
        children = self.context.query(r.child, self.ignore_filters, self.moment)
        side = children.df.select(*[F.col(c).alias(f"__c{k}") for k, c in enumerate(r.child_key)], *fields)
        on = [self.df[a] == side[f"__c{k}"] for k, a in enumerate(r.parent_key)]
        joined = self.df.join(side, on, "left" if default_if_empty else "inner").drop(*[f"__c{k}" for k in range(len(on))])
        return self._with(joined, children, key=())

    def with_parent(self, relation: str, *fields: str, **renamed: str) -> Query:
        """Columns of the one row that a declared relation refers to, null where there is none: to filter, order or group by."""
        r = self.context.entities[self.entity].relations[relation]
        parent = self.context.query(r.child, self.ignore_filters, self.moment)
        wanted = [F.col(c).alias(c) for c in fields] + [F.col(c).alias(n) for n, c in renamed.items()]
        side = parent.df.select(*[F.col(c).alias(f"__p{k}") for k, c in enumerate(r.child_key)], *wanted)
        on = [self.df[a] == side[f"__p{k}"] for k, a in enumerate(r.parent_key)]
        return self._with(self.df.join(side, on, "left").drop(*[f"__p{k}" for k in range(len(on))]), parent)

    # groups and aggregates

    def group_by(self, *keys, **aggregates: Column) -> Query:
        """Keys and aggregates; null is a key like any other, and instants with an offset are keys by their instant."""
        keys = [by_instant(self.df, k) for k in keys]
        return self._with(self.df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]), order=(), key=())

    def groups(self, *keys: str, fields: list[str] | None = None) -> DataFrame:
        """Each key with the list of its rows, in order."""
        fields = fields or [c for c in self.df.columns if c not in keys]
        out = joins.gathered(self.rows, list(keys), fields, "items", [k.column for k in self.total_order()] or None)
        return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "items")

    def map_batches(self, body: Callable, schema: str) -> DataFrame:
        """A projection that only Python can compute, over pandas batches in the rows' partitions; the context's policy decides on it.

        ``Context(client_evaluation=...)``: ``throw`` (the default) refuses it, ``warn`` warns, ``allow`` is silent.
        """
        policy = self.context.client_evaluation if self.context is not None else "throw"
        if policy == "throw":
            raise PermissionError("this projection would leave the engine; see Context(client_evaluation=...)")
        if policy == "warn":
            warnings.warn("this projection is computed in Python", stacklevel=2)
        return self.df.mapInPandas(lambda batches: (body(b) for b in batches), schema)

    def nth_of_group(self, keys: list[str], n: int = 1) -> Query:
        return self._with(grouping.nth_of_group(self.rows, keys, self._need_order(), n))

    def aggregate(self, **aggregates: Column) -> DataFrame:
        return self.df.agg(*[a.alias(n) for n, a in aggregates.items()])

    def with_children(self, other: Query, key, child_key, **aggregates: Column) -> Query:
        return self._with(grouping.with_children(self.df, other.df, _list(key), _list(child_key), **aggregates), other)

    def count(self, where: Column | None = None) -> int:
        return self.aggregate(v=grouping.count(where)).first()["v"]

    def sum(self, x: Column):
        return self.aggregate(v=grouping.total(x)).first()["v"]

    def average(self, x: Column):
        """Raises on an empty sequence of values."""
        if (v := self.aggregate(v=F.avg(x)).first()["v"]) is None:
            raise NoElement("average of nothing")
        return v

    def min(self, x: Column):
        return self.aggregate(v=F.min(x)).first()["v"]

    def max(self, x: Column):
        return self.aggregate(v=F.max(x)).first()["v"]

    def any(self, pred: Column | None = None) -> bool:
        return not (self.df if pred is None else self.df.filter(pred)).isEmpty()

    def all(self, pred: Column) -> bool:
        return self.df.filter(not_(pred)).isEmpty()

    def contains(self, **values) -> bool:
        return self.any(is_true(_all(F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items())))

    # numbering

    def with_row_number(self, name: str = "row_number") -> Query:
        return self._with(windows.row_number(self.rows, self._need_order(), name))

    def with_rank(self, name: str = "rank") -> Query:
        return self._with(windows.rank(self.rows, self.order, name))

    def with_dense_rank(self, name: str = "dense_rank") -> Query:
        return self._with(windows.dense_rank(self.rows, self.order, name))

    def with_lag(self, value: Column, n: int = 1, default: Column | None = None, name: str = "lag") -> Query:
        return self._with(windows.lag(self.rows, self._need_order(), value, n, default, name))

    def with_lead(self, value: Column, n: int = 1, default: Column | None = None, name: str = "lead") -> Query:
        return self._with(windows.lead(self.rows, self._need_order(), value, n, default, name))

    # one row

    def first_rows(self, pred: Column | None = None, n: int = 1) -> DataFrame:
        out = sequence.take(self.rows if pred is None else self.rows.filter(pred), self.total_order(), n)
        return out.drop(EDGE)

    def first_or_default(self, pred: Column | None = None) -> Row | None:
        return self.first_rows(pred).first()

    def first(self, pred: Column | None = None) -> Row:
        return _some(self.first_or_default(pred))

    def single_or_default(self, pred: Column | None = None) -> Row | None:
        rows = self.first_rows(pred, 2).collect()
        if len(rows) > 1:
            raise MoreThanOne("more than one row")
        return rows[0] if rows else None

    def single(self, pred: Column | None = None) -> Row:
        return _some(self.single_or_default(pred))

    def last_or_default(self, pred: Column | None = None) -> Row | None:
        return replace(self, order=reverse(self._need_order())).first_or_default(pred)

    def last(self, pred: Column | None = None) -> Row:
        return _some(self.last_or_default(pred))

    def element(self, n: int) -> DataFrame:
        return self.skip(n).take(1).df

    def element_at_or_default(self, n: int) -> Row | None:
        return self.element(n).first() if n >= 0 else None

    def element_at(self, n: int) -> Row:
        return _some(self.element_at_or_default(n))

    def least_by(self, *columns: str) -> DataFrame:
        """The one row (or none) of least keys."""
        return replace(self, order=_keys(columns, False) + self.order).first_rows()

    def most_by(self, *columns: str) -> DataFrame:
        return replace(self, order=_keys(columns, True) + self.order).first_rows()

    def min_by(self, *columns: str) -> Row:
        return _some(self.least_by(*columns).first())

    def max_by(self, *columns: str) -> Row:
        return _some(self.most_by(*columns).first())

    # results

    def frame(self) -> DataFrame:
        """The rows in their order."""
        return (self.rows.orderBy(*sorts(self.order)) if self.order else self.rows).drop(EDGE)

    @contextmanager
    def _labelled(self):
        """Jobs within carry the label as their description; what it was comes back after them."""
        sc, name = self.rows.sparkSession.sparkContext, "spark.job.description"
        before = sc.getLocalProperty(name)
        if self.label:
            sc.setJobDescription(self.label)
        try:
            yield
        finally:
            sc.setLocalProperty(name, before)

    def to_list(self) -> list[Row]:
        with self._labelled():
            return self.frame().collect()

    to_array = to_list

    def to_dictionary(self, key: str, value: str | None = None) -> dict:
        out = {}
        for row in self.to_list():
            if row[key] in out:
                raise ValueError(f"key {row[key]!r} twice")
            out[row[key]] = row if value is None else row[value]
        return out

    def to_hash_set(self) -> set[Row]:
        return set(self.df.distinct().collect())

    def __iter__(self) -> Iterator[Row]:
        with self._labelled():
            yield from streaming.rows(self.frame())

    def __aiter__(self):
        return streaming.async_rows(self.frame())


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _some(row: Row | None) -> Row:
    if row is None:
        raise NoElement("no such row")
    return row


def _all(preds) -> Column:
    out = F.lit(True)
    for p in preds:
        out &= p
    return out
