"""Set-based writes: each gives the table as it would be, as a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import is_true, not_


def update(df: DataFrame, where: Column, **assignments: Column) -> DataFrame:
    """Rows that satisfy ``where`` get the assigned values, all computed from the old row."""
    hit = is_true(where)
    types = dict(df.dtypes)
    return df.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).cast(types[c]).alias(c) if c in assignments else F.col(c) for c in df.columns])


def one_per_key(source: DataFrame, key: list[str]) -> DataFrame:
    """``source`` if no key repeats in it; reading it raises otherwise. Null keys match nothing, so they may repeat."""
    plain = [c for c in source.columns if c not in key]
    row = F.any_value(F.struct(F.lit(True).alias("__there"), *[F.col(c) for c in plain])).alias("__row")
    grouped = source.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), row)
    wrong = F.raise_error(F.concat(F.lit("several rows for the key "), F.to_json(F.struct(*key))))
    checked = grouped.select(*key, F.when(F.col("__n") > 1, wrong).otherwise(F.col("__row")).alias("__row"))
    return checked.select(*[F.col(c) if c in key else F.col(f"__row.`{c}`").alias(c) for c in source.columns], F.col("__row.__there").alias("__there")).filter("__there").drop("__there")


def update_from(df: DataFrame, source: DataFrame, on: list[str], **assignments) -> DataFrame:
    """Rows with a match in ``source`` get values computed from its columns, named ``s.<column>``. Two matches for one row raise."""
    types = dict(df.dtypes)
    source = one_per_key(source, on)
    joined = df.alias("t").join(source.withColumn("__hit", F.lit(True)).alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "left")
    return joined.select(*[F.when(F.col("s.__hit"), assignments[c]).otherwise(F.col(f"t.{c}")).cast(types[c]).alias(c) if c in assignments else F.col(f"t.{c}") for c in df.columns])


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows of which ``where`` is unknown stay."""
    return df.filter(not_(where))


def delete_where_any(df: DataFrame, source: DataFrame, condition: Column) -> DataFrame:
    """Rows for which some row of ``source`` satisfies ``condition`` over the aliases ``t`` and ``s`` go."""
    return df.alias("t").join(source.alias("s"), condition, "left_anti")


def delete_window(df: DataFrame, window: DataFrame, key: list[str]) -> DataFrame:
    """Only the rows of a paged query go."""
    return df.join(window.select(*key).distinct(), key, "left_anti").select(*df.columns)


def delete_from(df: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    return df.join(source.select(*on), on, "left_anti")


def update_window(df: DataFrame, window: DataFrame, key: list[str], **assignments: Column) -> DataFrame:
    """Only the rows of a paged query change."""
    tagged = df.join(window.select(*key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return update(tagged, F.col("__hit"), **assignments).select(*df.columns)


def bulk_insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def bulk_update(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` that ``rows`` has a key of are replaced in the columns that ``rows`` has."""
    plain = [c for c in rows.columns if c not in key]
    return update_from(df, rows, key, **{c: F.col(f"s.{c}") for c in plain})


def bulk_delete(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return delete_from(df, keys, key)


def upsert(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` replace those of equal keys and follow the others. Keys that repeat in ``rows`` raise, null keys are always new."""
    fresh = rows.filter(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False))) if len(key) > 1 else rows.filter(F.col(key[0]).isNull())
    return df.join(rows.select(*key), key, "left_anti").select(*df.columns).unionByName(one_per_key(rows, key).select(*df.columns)).unionByName(fresh.select(*df.columns))


def cascade_delete(tables: dict[str, DataFrame], root: str, where: Column, links: list[tuple[str, str, list[str], list[str]]]) -> dict[str, DataFrame]:
    """Delete from ``root`` and down the links ``(parent, child, parent key, child key)``, which are in order from the root."""
    out = dict(tables)
    gone = {root: tables[root].filter(is_true(where))}
    out[root] = delete(tables[root], where)
    for parent, child, pk, ck in links:
        keys = gone[parent].select(*[F.col(p).alias(c) for p, c in zip(pk, ck)]).distinct()
        gone[child] = tables[child].join(keys, ck, "left_semi")
        out[child] = out[child].join(keys, ck, "left_anti")
    return out


def checked_update(df: DataFrame, rows: DataFrame, key: list[str], token: str) -> tuple[DataFrame, DataFrame]:
    """Update by key where the token still is the one that was read; also the rows that were in conflict."""
    now = df.select(*key, F.col(token).alias("__now"))
    known = rows.join(now, key, "left")
    good = known.filter(F.col("__now").eqNullSafe(F.col(token))).drop("__now")
    return bulk_update(df, good, key), known.filter(~F.col("__now").eqNullSafe(F.col(token))).drop("__now")
