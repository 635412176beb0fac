"""File-system calls through the session's own Hadoop client, so any cluster store works."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import SparkSession


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, text: str) -> bool:
    path, fs = _path(spark, text)
    return fs.exists(path)


def partition_values(spark: SparkSession, base: str, column: str) -> list[str]:
    """Values of the first-level partition folders of a table."""
    path, fs = _path(spark, base)
    if not fs.exists(path):
        return []
    prefix = f"{column}="
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def partition_dates(spark: SparkSession, base: str, start: date, end: date) -> list[date]:
    """Dates of ``date=`` folders between two days, both included."""
    days = (date.fromisoformat(v) for v in partition_values(spark, base, "date"))
    return [d for d in days if start <= d <= end]


def files_by_day(spark: SparkSession, base: str, start: date, end: date) -> dict[date, frozenset[str]]:
    """Names of the files in the ``date=`` folders between two days, from one listing of the table."""
    found: dict[date, set[str]] = {}
    if not exists(spark, base):
        return {}
    files = spark.read.schema("one int").parquet(base).inputFiles()
    for day, name in re.findall(r"/date=(\d{4}-\d\d-\d\d)/([^/\n]*)", "\n".join(files)):
        if start <= (when := date.fromisoformat(day)) <= end:
            found.setdefault(when, set()).add(name)
    return {when: frozenset(names) for when, names in found.items()}


def swap(spark: SparkSession, base: str, new: str, old: str) -> None:
    """Put the folder ``new`` in the place of ``base``, which is deleted by way of ``old``."""
    path, fs = _path(spark, base)
    if fs.exists(path) and not fs.rename(path, _path(spark, old)[0]):
        raise OSError(f"cannot rename {base}")
    if not fs.rename(_path(spark, new)[0], path):
        raise OSError(f"cannot rename {new}")
    fs.delete(_path(spark, old)[0], True)


def delete(spark: SparkSession, text: str) -> None:
    """Delete a folder, if it is there."""
    path, fs = _path(spark, text)
    fs.delete(path, True)


def drop_partition(spark: SparkSession, base: str, column: str, value: str) -> None:
    path, fs = _path(spark, f"{base.rstrip('/')}/{column}={value}")
    fs.delete(path, True)
