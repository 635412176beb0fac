"""Table writes."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.sources.paths import delete, drop_partition, files_by_day, swap


@dataclass(frozen=True)
class RangeWrite:
    """What a range replace did."""

    written: int
    out_of_range: int
    emptied_days: int


def clustered_by_day(df: DataFrame, *within: str, days: int) -> DataFrame:
    """Lay the rows of ``days`` days out for writing, sorted so that file statistics prune.

    With at least a day for every writer, sampled ranges of (day, ``within``) spread the days evenly
    and split one that is far larger. With fewer, the adaptive planner gathers a small day into one
    file and splits a large one.
    """
    writers = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(writers, "date", *within) if days >= writers else df.hint("rebalance", "date")
    return placed.sortWithinPartitions("date", *within)


def constrained(df: DataFrame, schema: T.StructType, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` as it may be written: a NULL where ``schema`` has none, or a second row of a key, is an error.

    The checks are part of the job that writes: the rows of a key are numbered where they lie, or are
    moved together first where they don't, so nothing is read twice. The error fails the job before
    anything is committed, and the stored table stays as it was.
    """
    required = [f.name for f in schema if not f.nullable]
    columns = []
    for name in df.columns:
        broken = F.raise_error(F.lit(f"NULL in required column {name}")).cast(df.schema[name].dataType)
        columns.append(F.coalesce(F.col(name), broken).alias(name) if name in required else F.col(name))
    checked = df.select(*columns)
    if not keys:
        return checked
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    second = F.raise_error(F.concat(F.lit(f"second row of key ({', '.join(keys)}): "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    numbered = checked.withColumn("_nth", nth)
    first = keys[0]
    kind = df.schema[first].dataType
    return numbered.withColumn(first, F.when(F.col("_nth") == 1, F.col(first)).otherwise(second.cast(kind))).drop("_nth")


def store_clustered(df: DataFrame, table: str, by: Sequence[str], sort: Sequence[str], buckets: int, path: str | None = None) -> None:
    """A catalog table in ``buckets`` of ``by``, sorted within: joins and windows on ``by`` move nothing.

    Rows are placed by bucket first, so a bucket is one file. Tables that are joined need the same
    number of buckets.
    """
    writer = df.repartition(buckets, *by).write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, *by).sortBy(*by, *sort).saveAsTable(table)


def replace_table(df: DataFrame, path: str) -> None:
    """Full replace: written once, in the order of ``df``, beside the table, then put in its place.

    The new content may be derived from the old, and a failure while writing leaves the old. Only
    the two renames at the end are not one step; a reader may miss the table between them.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    mark = uuid.uuid4().hex
    try:
        df.write.mode("errorifexists").parquet(f"{base}__new-{mark}")
    except Exception:
        delete(spark, f"{base}__new-{mark}")
        raise
    swap(spark, base, f"{base}__new-{mark}", f"{base}__old-{mark}")


def write_daily(df: DataFrame, path: str) -> None:
    """Write ``date=`` folders, replacing the days present in ``df``, which are counted first."""
    days = df.agg(F.count_distinct("date")).first()[0]
    (
        clustered_by_day(df, days=days)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def write_quarter(df: DataFrame, path: str, quarter: str) -> None:
    """Write one ``quarter=`` folder, replacing it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/quarter={quarter}")


def write_quarters(df: DataFrame, path: str) -> None:
    """Write ``quarter=`` folders, replacing the quarters present in ``df``."""
    (
        df.hint("rebalance", "quarter")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("quarter")
        .parquet(path)
    )


def replace_partition(df: DataFrame, path: str, values: Mapping[str, str]) -> None:
    """Make one partition folder, named by ``values``, equal to ``df``."""
    folder = "/".join(f"{name}={value}" for name, value in values.items())
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{folder}")


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_range(
    df: DataFrame,
    path: str,
    start: date,
    end: date,
    sort: tuple[str, ...] = ("ticker",),
    placed: bool = False,
) -> RangeWrite:
    """Make the stored days from ``start`` to ``end`` equal to ``df``.

    Overwriting by partition leaves alone a stored day for which ``df`` has no rows, so such
    days are dropped afterwards: a rerun that loses a day removes it. Rows dated outside the
    range are not written here, since a rerun could not take them back; they are counted, and
    callers keep them elsewhere (:meth:`Warehouse.load_prices`).
    Running the same range twice gives the same table, also after a failure half way.

    ``placed`` says that each day's rows already share a partition, which saves the shuffle.
    """
    spark = df.sparkSession
    inside = F.coalesce(F.col("date").between(F.lit(start), F.lit(end)), F.lit(False))
    before = files_by_day(spark, path, start, end)
    laid_out = (
        df.sortWithinPartitions("date", *sort)
        if placed
        else clustered_by_day(df, *sort, days=(end - start).days + 1)
    )
    # Counted in the writing tasks, each of which counts once however often it is tried; further
    # up, rows are also seen by the sampling of ranges and by repeated stages.
    seen = Observation("range_write")
    counted = laid_out.observe(
        seen,
        F.sum(inside.cast("bigint")).alias("written"),
        F.sum((~inside).cast("bigint")).alias("out_of_range"),
    )
    (
        counted.where(inside)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )
    # A replaced day has new files; a day that kept its old ones got no rows this time.
    after = files_by_day(spark, path, start, end)
    stale = [day for day, files in before.items() if after.get(day) == files]
    for day in stale:
        drop_partition(spark, path, "date", day.isoformat())
    counts = seen.get
    return RangeWrite(counts["written"] or 0, counts["out_of_range"] or 0, len(stale))


def write_extracts(frames: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder per result, with a header, written by the executors.

    Rows keep the order of the frame across the part files. A small result comes as one file,
    since the adaptive planner joins small partitions.
    """
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")
