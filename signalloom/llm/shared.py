"""Reading tables, stored intermediates and what the operators have in common.

Intermediates are Parquet tables in the shared folder that the session names in
``spark.checkpoint.dir``; where it names none, as in tests, they go below the warehouse. They cut
lineage on storage that outlives executors. An operator drops those it no longer needs; what a
returned frame still reads is deleted when the application ends.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than ASCII white space, which is what ``bytes.split`` cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


class Scratch:
    """A folder of stored intermediates, deleted at the end of the application at the latest."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; ``name`` is new or was dropped before."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete stored tables, or the whole folder. Works on any Hadoop file system."""
        context = self.spark.sparkContext
        if context._jsc is None or context._gateway is None:
            return
        try:
            for name in names or ("",):
                path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:
            if names:
                raise
            # At the end of the application the JVM may have gone first, and the folder with it.


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand Python workers at most ``rows`` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
