"""As-of join: for every left row the latest right row already known at that time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_validity(
    df: DataFrame, by: Sequence[str], valid_from: str, tie: Sequence[str] = ()
) -> DataFrame:
    """Add ``valid_to``: the moment the next row of the same key takes over, NULL for the last.

    Rows that start together get an empty interval except the last by ``tie``.
    """
    timeline = Window.partitionBy(*by).orderBy(valid_from, *tie)
    return df.withColumn("valid_to", F.lead(valid_from).over(timeline))


def asof_left(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    tie: Sequence[str] = (),
    strategy: str = "interval",
) -> DataFrame:
    """Left as-of join on equal ``by`` and ``right_on <= left_on``.

    ``interval`` turns the right side into validity intervals and joins on the key with the
    interval as residual. No side is forced to be broadcast: Spark does so when its size
    statistics allow it, and otherwise merges on ``by``, which a left side that comes out of a
    window on the same key does not pay a shuffle for.

    ``merge`` puts both sides on one timeline per key and carries the last right row forward.
    Use it when a key has very many right rows, since no left row is compared with more than one.
    """
    if strategy == "interval":
        return _asof_interval(left, right, by, left_on, right_on, tie)
    if strategy == "merge":
        return _asof_merge(left, right, by, left_on, right_on, tie)
    raise ValueError(f"unknown as-of strategy {strategy!r}")


def _asof_interval(left, right, by, left_on, right_on, tie):
    spans = with_validity(right.where(F.col(right_on).isNotNull()), by, right_on, tie)
    taken = [c for c in right.columns if c not in by]
    spans = spans.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        *[F.col(c).alias(f"_r_{c}") for c in taken],
        F.col("valid_to").alias("_valid_to"),
    )
    at = left[left_on]
    known = (spans[f"_r_{right_on}"] <= at) & (
        spans["_valid_to"].isNull() | (at < spans["_valid_to"])
    )
    for c in by:
        known = (left[c] == spans[f"_by_{c}"]) & known
    return left.join(spans, known, "left").select(
        *left.columns, *[F.col(f"_r_{c}").alias(c) for c in taken]
    )


def _asof_merge(left, right, by, left_on, right_on, tie):
    taken = [c for c in right.columns if c not in by]
    facts = right.where(F.col(right_on).isNotNull()).select(
        *by,
        F.col(right_on).alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(*[F.col(c) for c in tie], F.lit(0).alias("_pad")).alias("_tie"),
        F.struct(*taken).alias("_fact"),
    )
    rows = left.select(
        *by,
        F.col(left_on).alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_row"),
    )
    timeline = (
        Window.partitionBy(*by)
        .orderBy("_at", "_side", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = rows.unionByName(facts, allowMissingColumns=True).withColumn(
        "_known", F.last("_fact", ignorenulls=True).over(timeline)
    )
    return merged.where(F.col("_side") == 1).select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns],
        *[F.col(f"_known.{c}").alias(c) for c in taken],
    )
