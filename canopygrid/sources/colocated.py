"""Facts and traits stored so that a tile's cells and its traits lie in buckets of the same number.

Joined by area, tile and position, both are read bucket by bucket and no fact
moves. Tables are Spark's bucketed tables, by (aoi, tile); their files lie in
``folder``, or in the warehouse without one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.model import TILE

BUCKETS = 256
# Facts to a bucket, which one task sorts.
ROWS = 1 << 18
PLACE = ("aoi", "tile")
CELL = ("row", "col")
# Lets a join on (aoi, tile, row, col) keep the buckets of (aoi, tile); hot tiles are what the number of buckets is for.
SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def tile_number(tile: int = TILE) -> Column:
    """One number per storage tile of a grid up to 2^20 tiles wide."""
    return (F.floor(F.col("row") / tile) * (1 << 20) + F.floor(F.col("col") / tile)).cast("long")


def bucket_count(facts: DataFrame, least: int = BUCKETS, rows: int = ROWS) -> int:
    """``least`` buckets, doubled until there are no more than ``rows`` facts to one on average; for all tables joined."""
    found, many = facts.count(), least
    while found > many * rows:
        many *= 2
    return many


def write_bucketed(
    df: DataFrame, table: str, *, buckets: int = BUCKETS, tile: int = TILE, folder: str | None = None, partitions: Sequence[str] = ()
) -> None:
    """Replace the table ``table`` by ``df`` (aoi, row, col and more) in buckets by area and tile.

    Rows are dealt to as many tasks as there are buckets first, so each bucket
    is one file (a partition). Tables to be joined need the same number of
    buckets and the same ``tile``.
    """
    writer = (
        df.withColumn("tile", tile_number(tile))
        .repartition(buckets, *PLACE)
        .write.mode("overwrite")
        .bucketBy(buckets, *PLACE)
        .sortBy(*PLACE, *CELL)
    )
    if partitions:
        writer = writer.partitionBy(*partitions)
    if folder:
        writer = writer.option("path", folder)
    writer.saveAsTable(table)


def colocated_join(spark: SparkSession, facts: DataFrame, traits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trait columns of each fact, by area, tile and position; both read from tables of ``write_bucketed``.

    Sets the session's ``SETTING``, which the plan is made under.
    """
    spark.conf.set(SETTING, "false")
    keys = [*PLACE, *CELL]
    return facts.join(traits.select(*keys, *columns).hint("merge"), keys)
