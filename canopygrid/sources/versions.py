"""Folders that are replaced as a whole without a moment in which nothing is there.

A new state is written beside the old one, under the next number, and counts
from the moment its mark is put down, the last thing done. A run that ends in
between leaves the old state as the current one. Two versions are kept, so that
readers of the one before may finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

MARKS = "_versions"
KEPT = 2


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, oldest first."""
    fs, place = _place(spark, f"{path}/{MARKS}")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n) for n in names if n.isdigit())


def folder(path: str, number: int) -> str:
    # The underscore keeps it out of what reads the whole path.
    return f"{path}/_version-{number}"


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest complete version; None before the first."""
    known = numbers(spark, path)
    return folder(path, known[-1]) if known else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = KEPT) -> str:
    """Let ``write`` fill a new folder, make it the current version and drop those before the last ``keep``.

    Where two writers meet, the second one's mark is refused.
    """
    known = numbers(spark, path)
    number = (known[-1] if known else 0) + 1
    made = folder(path, number)
    fs, place = _place(spark, made)
    fs.delete(place, True)  # of a run that did not end
    write(made)
    fs.create(_place(spark, f"{path}/{MARKS}/{number}")[1], False).close()
    for old in known[: max(0, len(known) + 1 - keep)]:
        fs.delete(_place(spark, f"{path}/{MARKS}/{old}")[1], False)
        fs.delete(_place(spark, folder(path, old))[1], True)
    return made
