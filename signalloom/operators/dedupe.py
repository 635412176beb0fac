"""Pick one row per key, and check that there is only one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """Raised when a table that must be unique on a key is not."""

    def __init__(self, keys: Sequence[str], rows: int):
        super().__init__(f"{rows} surplus row(s) on key ({', '.join(keys)})")
        self.rows = rows


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Column | None = None
) -> DataFrame:
    """Keep the row that sorts first within each key, among the rows for which ``keep`` holds.

    Written as an aggregate rather than a row number, so every map task folds its own copies
    before the shuffle: a key that holds a third of the input reaches the reducers as one row
    per task. Columns outside ``keys`` and ``order`` break the remaining ties, which makes the
    choice the same on every run. ``keep`` is part of the aggregate because a filter in front
    would have Spark compute the columns it uses twice.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)], *rest)
    first = (
        df.groupBy(*keys)
        .agg(F.min(row if keep is None else F.when(keep, row)).alias("_first"))
        .where(F.col("_first").isNotNull())
    )
    return first.select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def surplus_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row, one column ``dupes``: rows beyond the first of each key. NULL keys count as keys."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("dupes"))
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Blocking check: raise :class:`DuplicateKeys` unless ``keys`` identify rows."""
    surplus = surplus_rows(df, keys).first()["dupes"]
    if surplus:
        raise DuplicateKeys(keys, surplus)
