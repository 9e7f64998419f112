"""Tables published by version: a reader sees the old table or the new one, never a half of each.

Every version is a folder of its own; a marker, an empty file named by the number, is made when
the folder is whole. Making a file is atomic in every store, a rename is not, so nothing is ever
moved or overwritten. Readers take the highest number with a marker; a writer that dies leaves a
folder without one, which nobody reads. Of two writers of one version the second fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_MARKERS = "_published"


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    system, named = _store(spark, path)
    folder = named(path)
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    return _numbers(spark, f"{path}/{_MARKERS}", "")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the newest version; ``path`` itself if nothing was published by version."""
    known = versions(spark, path)
    return f"{path}/version={known[-1]}" if known else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> int:
    """Lets ``write`` fill a new folder, then makes it the current version; returns its number."""
    taken = [*_numbers(spark, path, "version="), *versions(spark, path)]
    number = max(taken, default=-1) + 1
    write(f"{path}/version={number}")
    system, named = _store(spark, path)
    system.create(named(f"{path}/{_MARKERS}/{number}"), False).close()
    return number


def retire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the newest ``keep`` versions, markers first, and unpublished older folders."""
    if keep < 1:
        raise ValueError("the current version stays")
    system, named = _store(spark, path)
    known = versions(spark, path)
    for number in known[:-keep]:
        system.delete(named(f"{path}/{_MARKERS}/{number}"), False)
    for number in _numbers(spark, path, "version="):
        if known[-keep:] and number < known[-keep:][0] or (number < known[-1] and number not in known):
            system.delete(named(f"{path}/version={number}"), True)
