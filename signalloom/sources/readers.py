"""Scans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.sources.paths import exists


def read_daily(
    spark: SparkSession,
    base: str,
    start: date | None = None,
    end: date | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet under ``date=YYYY-MM-DD`` folders; a range opens only the folders inside it.

    Without a ``schema`` the layout is taken from the files.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(base)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    return df


def read_quarters(
    spark: SparkSession, base: str, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet under ``quarter=`` folders, columns matched by name across quarters.

    With a ``schema``, columns a quarter lacks read as NULL. Without one the layouts of all files
    are merged, which opens every footer first.
    """
    reader = spark.read.option("basePath", base)
    if schema is None:
        return reader.option("mergeSchema", True).parquet(base)
    return reader.schema(schema).parquet(base)


def read_tab_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-delimited text with a header; every column stays text.

    A quote may wrap a field that holds a tab; a stray quote inside a field is kept as is.
    """
    return (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )


def read_tab_rows(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of tab-delimited text, as :func:`read_tab_text`, and the ``line`` of those it cannot read.

    A row with more or fewer fields than the header is no row of the table. With ``multiline`` a quoted
    field may hold line breaks; a file is then read by one task, so it is for files of a task's size.
    Without, the lines of such a row come out as unreadable, but for one that has the right width by itself.
    """
    names = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path).columns
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_line", T.StringType())])
    rows = (
        spark.read.schema(schema)
        .options(sep="\t", header=True, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE")
        # Every field is looked at, whichever are asked for, or a short row would pass as a whole one.
        .options(columnNameOfCorruptRecord="_line", columnPruning=False)
        .csv(path)
    )
    # Spark does not read the line alone: a field is asked for with it.
    rows = rows.where(F.length(F.coalesce(names[0], F.lit(""))) >= 0)
    bad = rows.where(F.col("_line").isNotNull())
    return rows.where(F.col("_line").isNull()).drop("_line"), bad.select(F.col("_line").alias("line"))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one of the same layout before its first load."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def with_text_column(df: DataFrame, name: str) -> DataFrame:
    """Add an all-NULL text column where older files lack it."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast("string"))
