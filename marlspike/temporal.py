"""History tables: versions of rows with half-open validity, and what is read from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FROM, TO, OPERATION, VERSION = "__ValidFrom", "__ValidTo", "__Operation", "__VersionId"
BOOKKEEPING = (FROM, TO, OPERATION, VERSION)
OPEN_END = datetime(9999, 12, 31)


class History:
    """A frame of versions: the entity's columns and the four of ``BOOKKEEPING``; deletions are versions with operation D."""

    def __init__(self, versions: DataFrame, key):
        self.versions = versions
        self.key = [key] if isinstance(key, str) else list(key)

    def _moment(self, t) -> Column:
        """A literal of the type of the validity columns, so that comparisons reach the scan."""
        return t if isinstance(t, Column) else F.lit(t).cast(dict(self.versions.dtypes)[TO])

    @property
    def columns(self) -> list[str]:
        return [c for c in self.versions.columns if c not in BOOKKEEPING]

    @classmethod
    def backfill(cls, current: DataFrame, key, since: datetime) -> History:
        """Open versions of all present rows."""
        number = F.xxhash64(*([key] if isinstance(key, str) else key))
        return cls(current.withColumns({FROM: F.lit(since).cast("timestamp"), TO: F.lit(OPEN_END).cast("timestamp"), OPERATION: F.lit("I"), VERSION: number}), key)

    def as_of(self, t) -> DataFrame:
        t = self._moment(t)
        return self.versions.filter((F.col(FROM) <= t) & (t < F.col(TO)) & (F.col(OPERATION) != "D")).select(*self.columns)

    def current(self) -> DataFrame:
        return self.versions.filter((F.col(TO) == self._moment(OPEN_END)) & (F.col(OPERATION) != "D")).select(*self.columns)

    def of(self, *key) -> DataFrame:
        """All versions of one key, oldest first."""
        match = [F.col(k) == F.lit(v) for k, v in zip(self.key, key, strict=True)]
        out = self.versions
        for m in match:
            out = out.filter(m)
        return out.orderBy(FROM, VERSION)

    def diff(self) -> DataFrame:
        """A row for each column that differs between neighbouring versions of a key: key, ``changed_at``, ``column``, ``old``, ``new``."""
        w = Window.partitionBy(*self.key).orderBy(FROM, VERSION)
        plain = [c for c in self.columns if c not in self.key]
        before = {f"__{c}": F.lag(F.col(c).cast("string")).over(w) for c in plain}
        rows = self.versions.withColumns(before | {"__n": F.row_number().over(w)}).filter("__n > 1")
        changes = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("old"), F.col(c).cast("string").alias("new")) for c in plain])
        differing = F.filter(changes, lambda x: ~x["old"].eqNullSafe(x["new"]))
        return rows.select(*self.key, F.col(FROM).alias("changed_at"), F.inline(differing))

    def restore(self, current: DataFrame, t, keys: DataFrame | None = None) -> DataFrame:
        """``current`` with the rows (of ``keys``) as they were at ``t``. Rows that are gone stay gone."""
        old = self.as_of(t)
        if keys is not None:
            old = old.join(keys.select(*self.key), self.key, "left_semi")
        plain = [c for c in self.columns if c not in self.key]
        old = old.select(*self.key, F.struct(*plain).alias("__old"))
        joined = current.join(old, self.key, "left")
        return joined.select(*[c if c in self.key else F.when(F.col("__old").isNotNull(), F.col("__old")[c]).otherwise(F.col(c)).alias(c) for c in current.columns])

    def prune(self, cutoff) -> History:
        """Without the versions that ended before ``cutoff``."""
        return History(self.versions.filter(F.col(TO) >= self._moment(cutoff)), self.key)
