"""Ranks within groups, for groups of any size.

A Spark window hands each group to one task. That is the shortest plan while groups are small;
callers name it as the strategy ``window``. The strategy ``sliced`` gives the same numbers for
groups of any size. Groups are counted first: one of up to ``SLICE_ROWS`` rows is a slice by itself and
is ranked where its rows meet. The rows of larger groups are range partitioned on (group, order), so
that a group is spread over many slices, each slice is counted, and a row's position is its place in
the slice plus the rows in earlier slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.session import stage

STRATEGIES = ("window", "sliced")

#: Rows that one task sorts as a slice. Groups with more are cut.
SLICE_ROWS = 1 << 18


def sliced(strategy: str) -> bool:
    """Whether a strategy, by name, is the one for groups of any size."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    return strategy == "sliced"


# ------------------------------------------------------------------ small groups: windows


def percent_ranks_by_window(
    df: DataFrame, group: Sequence[str], ranks: Mapping[str, str]
) -> DataFrame:
    """Add one percentile rank per ``{new column: measured column}``; NULLs stay unranked.

    All windows share the leading partition columns, so one shuffle on them serves every rank.
    """
    added = {}
    for name, measure in ranks.items():
        order = Window.partitionBy(*group, F.col(measure).isNull()).orderBy(measure)
        added[name] = F.when(F.col(measure).isNotNull(), F.percent_rank().over(order))
    return df.withColumns(added)


def ntile_by_window(
    df: DataFrame, group: Sequence[str], measure: str, tie: Sequence[str], buckets: int, name: str
) -> DataFrame:
    """Add the bucket number of ``measure`` within the group; NULLs get none."""
    order = Window.partitionBy(*group, F.col(measure).isNull()).orderBy(measure, *tie)
    return df.withColumn(
        name, F.when(F.col(measure).isNotNull(), F.ntile(buckets).over(order))
    )


# ------------------------------------------------------------------ any group: sorted slices


def _by_size(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that are one slice, and those of larger groups or None without any.

    The count reads the columns of ``group`` alone.
    """
    names = [f"_large{i}" for i in range(len(group))]
    large = (
        df.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)])
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > SLICE_ROWS)
        .drop("_rows")
    )
    if large.isEmpty():
        return df, None
    df, large = stage(df, "grouped"), stage(large, "large")
    same = F.lit(True)
    for c, n in zip(group, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def _sliced(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partition on (by, order) and freeze the slice number of every row.

    The slice number depends on task placement, so the table is staged before it is read twice.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(
        df.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )


def _cumulated(sliced: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column):
    """Add ``_before``, the weight of all rows sorting earlier in the group, and ``_total``."""
    sums = sliced.groupBy(*by, "_slice").agg(F.sum(weight).alias("_w"))
    earlier = (
        Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    # At most one row per slice and group.
    offsets = sums.select(
        *by,
        "_slice",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_w").over(whole).alias("_total"),
    )
    here = (
        Window.partitionBy(*by, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.join(offsets, [*by, "_slice"])
        .withColumn(
            "_before", F.col("_offset") + F.coalesce(F.sum(weight).over(here), F.lit(0))
        )
        .drop("_offset", "_slice")
    )


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence[str], position: str, size: str
) -> DataFrame:
    """Add each row's zero-based position in its group and the size of the group.

    ``order`` must identify rows within a group, and neither it nor ``by`` may be NULL.
    """
    df, large = _by_size(df, by)
    whole = Window.partitionBy(*by)
    small = df.withColumns(
        {
            position: (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint"),
            size: F.count(F.lit(1)).over(whole),
        }
    )
    if large is None:
        return small
    placed = _cumulated(_sliced(large, by, order), by, order, F.lit(1).cast("bigint"))
    return small.unionByName(placed.withColumnsRenamed({"_before": position, "_total": size}))


def _numbered(df: DataFrame, label: str) -> DataFrame:
    """Give every row a number, and freeze it: rows are found again by it, repeated ones too."""
    return stage(df.withColumn("_row", F.monotonically_increasing_id()), label)


def percent_ranks(df: DataFrame, group: Sequence[str], ranks: Mapping[str, str]) -> DataFrame:
    """:func:`percent_ranks_by_window` without the limit on the size of a group.

    The rows are stored, since they are counted first. A shuffle by group serves all measures of
    the groups that are one slice.
    """
    df, large = _by_size(stage(df, "ranked"), group)
    small = percent_ranks_by_window(df.repartition(*group), group, ranks)
    return small if large is None else small.unionByName(_percent_ranks_of_large(large, group, ranks))


def _percent_ranks_of_large(
    df: DataFrame, group: Sequence[str], ranks: Mapping[str, str]
) -> DataFrame:
    """Percentile ranks by sorted slices.

    All measures are ranked together in long form. Equal values are folded to one row with a
    count before they are sorted; the join back to a value that most rows share is skewed and
    left to the adaptive planner to split.
    """
    measures = list(dict.fromkeys(ranks.values()))
    df = _numbered(df, "ranked")
    ids = ["_row", *group]
    long = (
        df.select(*ids, *measures)
        .unpivot(ids, measures, "_measure", "_value")
        .where(F.col("_value").isNotNull())
    )
    # A NULL group (no sector) is a group of its own; joins need a value for it.
    long = long.withColumns({f"_g{i}": F.struct(F.col(c)) for i, c in enumerate(group)})
    by = ["_measure", *[f"_g{i}" for i in range(len(group))]]
    folded = long.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = _cumulated(_sliced(folded, by, ["_value"]), by, ["_value"], F.col("_n"))
    ranked = placed.select(
        *by,
        "_value",
        F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - 1))
        .otherwise(F.lit(0.0))
        .alias("_rank"),
    )
    wide = (
        long.join(ranked, [*by, "_value"])
        .groupBy("_row")
        .agg(
            *[
                F.max(F.when(F.col("_measure") == measure, F.col("_rank"))).alias(name)
                for name, measure in ranks.items()
            ]
        )
    )
    return df.join(wide, "_row", "left").drop("_row")


def ntile(
    df: DataFrame,
    group: Sequence[str],
    measure: str,
    tie: Sequence[str],
    buckets: int,
    name: str,
) -> DataFrame:
    """:func:`ntile_by_window` without the limit on the size of a group."""
    df, large = _by_size(df, group)
    small = ntile_by_window(df, group, measure, tie, buckets, name)
    if large is None:
        return small
    return small.unionByName(_ntile_of_large(large, group, measure, tie, buckets, name))


def _ntile_of_large(
    df: DataFrame,
    group: Sequence[str],
    measure: str,
    tie: Sequence[str],
    buckets: int,
    name: str,
) -> DataFrame:
    """Bucket numbers by sorted slices."""
    df = _numbered(df, "tiled")
    narrow = df.select("_row", *dict.fromkeys([*group, measure, *tie])).where(
        F.col(measure).isNotNull()
    )
    placed = positions(narrow, group, [measure, *tie, "_row"], "_at", "_size")
    low = F.floor(F.col("_size") / buckets)
    larger = F.col("_size") % buckets
    in_larger = larger * (low + 1)
    bucket = F.when(
        F.col("_at") < in_larger, F.floor(F.col("_at") / (low + 1))
    ).otherwise(larger + F.floor(F.try_divide(F.col("_at") - in_larger, low)))
    tiles = placed.select("_row", (bucket + 1).cast("int").alias(name))
    return df.join(tiles, "_row", "left").drop("_row")


def medians(
    df: DataFrame, by: Sequence[str], measure: str, tie: Sequence[str], name: str
) -> DataFrame:
    """Exact interpolated median per group, from the one or two middle rows.

    Unlike the built-in, which keeps all distinct values of a group in one buffer.
    """
    narrow = df.select(*dict.fromkeys([*by, measure, *tie])).where(F.col(measure).isNotNull())
    placed = positions(narrow, by, [measure, *tie], "_at", "_size")
    middle = F.col("_at").between(
        F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    )
    return placed.where(middle).groupBy(*by).agg(F.avg(measure).alias(name))
