"""User functions: SQL bodies that the optimizer inlines, and Python bodies over whole batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Translations:
    """Functions and methods by name, and by type where several types have one: each becomes an expression of its arguments."""

    def __init__(self, strict: bool = False):
        self.strict, self.known = strict, {}

    def add(self, name: str, body: Callable[..., Column], kind: str | None = None) -> None:
        if self.strict:
            raise PermissionError("functions of one's own are off in strict contexts")
        self.known[name, kind] = body

    def call(self, name: str, *args, kind: str | None = None) -> Column:
        """The function of that type, or else the one of any type."""
        body = self.known.get((name, kind)) or self.known.get((name, None))
        if body is None:
            raise LookupError(f"no function {name} of {kind or 'any type'}")
        return body(*args)


def register_sql(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> Callable[..., Column]:
    """``register_sql(spark, "net", "price double, rate double", "double", "price * (1 - rate)")``."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return lambda *args: F.call_function(name, *args)


def register_vectorised(spark: SparkSession, name: str, body: Callable, returns: str) -> Callable[..., Column]:
    """A body over pandas series, also callable by name in SQL."""
    made = F.pandas_udf(body, returns)
    spark.udf.register(name, made)
    return made
