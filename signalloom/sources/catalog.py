"""Tables of the session's catalog, replaced in one step by a change of their location."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.sources.paths import delete, drop_partition, partition_values


def _text(value: str) -> str:
    """``value`` as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_table(spark: SparkSession, table: str, schema: T.StructType, path: str) -> None:
    """A Parquet table and its database, unless they exist; repeating it changes nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    columns = (f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)}) USING parquet LOCATION {_text(path)}")


def location(spark: SparkSession, table: str) -> str | None:
    """Where the files of a table are; None without such a table."""
    if not spark.catalog.tableExists(table):
        return None
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return told.where(F.col("col_name") == "Location").first()["data_type"]


def read(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """A catalog table as it is now, or an empty one of the same layout before its first load.

    The frame keeps the version it was made with, through the next replace of the table.
    """
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], schema)
    return spark.table(table).select(*schema.names)


def switch_table(df: DataFrame, table: str, path: str) -> None:
    """Full replace of ``database.table``: a new version below ``path``, then one change in the catalog.

    A reader sees the old version or the new, never none. The new one may be derived from the old; a
    failure while writing leaves the old. The version just replaced is kept for those that still
    read it, earlier ones are deleted. One writer a table at a time: versions of a writer that broke off
    are deleted too.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    before = location(spark, table)
    if before is not None:
        was = [(f.name, f.dataType) for f in spark.table(table).schema]
        if was != (now := [(f.name, f.dataType) for f in df.schema]):
            raise ValueError(f"{table} has columns {was}, not {now}")
    version = uuid.uuid4().hex
    new = f"{base}/version={version}"
    try:
        df.write.mode("errorifexists").parquet(new)
    except Exception:
        delete(spark, new)
        raise
    if before is None:
        create_table(spark, table, df.schema, new)
    else:
        spark.sql(f"ALTER TABLE {table} SET LOCATION {_text(new)}")
    spark.catalog.refreshTable(table)
    kept = {version, (before or "").rstrip("/").rsplit("=", 1)[-1]}
    for other in partition_values(spark, base, "version"):
        if other not in kept:
            drop_partition(spark, base, "version", other)
