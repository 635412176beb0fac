"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

# Settings the library is written against. Everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the library defaults to a session builder."""
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_staged").rstrip("/")


_fresh: dict[str, SparkSession] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses, deleted by :func:`drop_staged` or
    when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _fresh[path] = spark
    return path


def drop_staged(*paths: str) -> None:
    """Delete staged tables, all of them if none is named. Nothing built on them may run later."""
    for path in paths or tuple(_fresh):
        context = _fresh.pop(path).sparkContext
        if context._jsc is not None:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging() -> Iterator[None]:
    """A scope that deletes what was staged inside it, also on failure."""
    before = set(_fresh)
    try:
        yield
    finally:
        if new := [p for p in _fresh if p not in before]:
            drop_staged(*new)


def _at_exit() -> None:
    with suppress(Exception):  # the JVM may have gone first
        drop_staged()


atexit.register(_at_exit)


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``by`` a column, in a folder per value.

    Cuts lineage on reliable storage: a lost executor re-reads files instead of re-running
    the plan, and values that depend on task placement are frozen.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.mode("errorifexists").partitionBy(*([by] if by else [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
