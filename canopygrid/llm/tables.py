"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.session import shared_folder


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Python workers live through all stages: what they free goes back to the machine.
FREED = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; Python workers on this machine can import the library wherever the session was started."""
    environment = spark.sparkContext.environment
    for variable, value in FREED.items():
        environment.setdefault(variable, value)
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Texts and sets differ much in size: batches for Python end at so many bytes, whatever their rows.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
# What a table was shuffled for goes from the disks once it is written, not when the driver happens to collect garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[list[str]] = []


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches that go to Python within are bounded in bytes; a smaller bound that is set stays."""
    before = spark.conf.get(BATCH_CONF, None)
    if before and before.isdigit() and int(before) <= BATCH_BYTES:
        yield
        return
    with _setting(spark, BATCH_CONF, str(BATCH_BYTES)):
        yield


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at the end, but for those stored to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, purpose: str, keep: bool = False) -> DataFrame:
    """The rows written to the cluster's shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not the work so far.
    Within ``scratch`` the table goes at its end, with ``keep`` at that of the
    next outer one, if any.
    """
    path = shared_folder(df.sparkSession, purpose)
    with small_batches(df.sparkSession), _setting(df.sparkSession, CLEANED, "true"):
        df.write.parquet(path)
    open_ones = _scratch[:-1] if keep else _scratch
    if open_ones:
        open_ones[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Tables of numbers up to so many rows are sent to every task.
SENT = 1 << 19


def sent(rows: DataFrame) -> DataFrame:
    """A stored table of numbers; a join sends it to every task where it is small, so that the other side stays where it is."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def with_ids(docs: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``column`` is among ``ids`` (one column, a table that stays); a null one is where there is one.

    64 neighbouring whole numbers are the bits of one row, so that the ids of
    very many documents are sent to these. Where ids lie too far apart for that, both sides are shuffled.
    """
    (name,) = ids.columns
    if docs.schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
        number = F.col(name).cast("long")
        place = lambda n: n.bitwiseAND(F.lit(63)).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), place(number))
        words = ids.groupBy(F.shiftright(number, 6).alias("_word")).agg(F.coalesce(F.bit_or(one), F.lit(-1)).alias("_bits"))
        words = stored(words, "ids", keep=True)
        if words.count() <= SENT:
            own = docs[column].cast("long")
            held = F.call_function("shiftright", words["_bits"], place(own)).bitwiseAND(F.lit(1)) == 1
            same = F.shiftright(own, 6).eqNullSafe(words["_word"]) & F.coalesce(held, F.lit(True))
            return docs.join(F.broadcast(words), same, "left_semi")
    return docs.join(ids, docs[column].eqNullSafe(ids[name]), "left_semi")


def utf8(column: str = "text") -> Column:
    """A text's bytes; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def carried(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Whole rows as one column ``kept``, and only the named columns beside it: no name of theirs is in the way.

    ``select("kept.*")`` brings the rows back.
    """
    return docs.select(F.struct("*").alias("kept"), *columns)
