"""The registry of named queries, and the context they run in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import Context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str, **more) -> Context:
    ctx = Context(spark, sf_dir, **more)
    ctx.entity("region", key="r_regionkey").has_many("nations", "nation", "r_regionkey", "n_regionkey")
    ctx.entity("nation", key="n_nationkey").has_many("customers", "customer", "n_nationkey", "c_nationkey").has_many("suppliers", "supplier", "n_nationkey", "s_nationkey")
    ctx.entity("customer", key="c_custkey").has_many("orders", "orders", "c_custkey", "o_custkey")
    ctx.entity("supplier", key="s_suppkey")
    ctx.entity("part", key="p_partkey").many_to_many("suppliers", "supplier", "p_partkey", "s_suppkey", "lineitem", "l_partkey", "l_suppkey")
    ctx.entity("orders", key="o_orderkey").has_many("lines", "lineitem", "o_orderkey", "l_orderkey").has_many("customer", "customer", "o_custkey", "c_custkey", single=True)
    ctx.entity("lineitem", key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    ctx.entity("events", key="event_id")
    ctx.entity("documents", key="doc_id")
    ctx.entity("labels", key="doc_id")
    ctx.entity("embeddings", key="vec_id")
    return ctx


def query(sql: str | None):
    """Register ``f(context)`` under its name, with its SQL."""

    def add(f: Callable[[Context], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(store(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def money(c: str) -> Column:
    """Exact to the cent, so that sums do not depend on their order."""
    return F.col(c).cast("decimal(18,2)")


def cents(c: str) -> Column:
    """Whole cents. Sums of them are as exact as those of ``money`` and far cheaper: a double becomes a decimal by way of its text."""
    return F.rint(F.col(c) * 100).cast("long").cast("decimal(18,0)")


def net_price() -> Column:
    """A line's price less its discount, in ten-thousandths."""
    price, rate = F.rint(F.col("l_extendedprice") * 100).cast("long"), F.rint(F.col("l_discount") * 100).cast("long")
    return (price * (F.lit(100).cast("long") - rate)).cast("decimal(18,0)")


def dbl(c: Column) -> Column:
    return c.cast("double")
