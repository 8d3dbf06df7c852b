"""Results row by row. There are no unbounded sources: a finite result is fetched partition by partition."""

from __future__ import annotations

from collections.abc import AsyncIterator, Iterator

from pyspark.sql import DataFrame, Row


def rows(df: DataFrame, prefetch: bool = False) -> Iterator[Row]:
    """Holds one partition of the result at a time."""
    yield from df.toLocalIterator(prefetchPartitions=prefetch)


async def async_rows(df: DataFrame) -> AsyncIterator[Row]:
    for row in rows(df):
        yield row
