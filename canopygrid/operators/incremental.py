"""Composites, baselines and monthly medians kept up to date: what is new or changed is read, nothing else.

Kept state lies in a folder of its own. What it was made from is a small table
beside it, replaced as a version (``sources.versions``) after everything else,
so a run that ends early leaves the state it found; its rows are not part of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.model import TILE
from canopygrid.operators.composites import CELL, LAYER, max_composite
from canopygrid.sources import versions

# Scenes taken in at a time; only their names come to the driver.
SCENES = 500


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    folder = versions.current(spark, path)
    return spark.read.parquet(folder) if folder else None


def _either(values: Sequence, column: str) -> Column:
    """Plain values, so that partitions are left out when the read is planned."""
    return F.col(column).isin(*sorted(set(values)))


# -- maximum composites -------------------------------------------------------


def extend_composites(
    store: DataFrame, scenes: DataFrame, path: str, period: Sequence[str] = ("year",), *, batch: int = SCENES, tile: int = TILE
) -> int:
    """Take the ``scenes`` (aoi, year, scene_id) that are not yet in into the composites kept under ``path``.

    ``store`` holds scene cells by aoi, year and scene_id as partitions, of
    which those of new scenes alone are read. The highest value per cell of a
    batch of scenes is written as a part of its own, a file for each area and
    period unless it is large, sorted by tile; nothing kept is read or
    rewritten. Returns the number of scenes taken in.
    """
    spark, taken = store.sparkSession, 0
    keys = ["aoi", "year", "scene_id"]
    while True:
        known = _known(spark, f"{path}/scenes")
        new = scenes.select(*keys).distinct()
        new = new.join(known, keys, "left_anti") if known is not None else new
        rows = new.orderBy(*keys).limit(batch).collect()
        if not rows:
            return taken
        names = spark.createDataFrame(rows, new.schema)
        cells = store.filter(_either([r.scene_id for r in rows], "scene_id") & _either([r.year for r in rows], "year"))
        cells = cells.filter(_either([r.aoi for r in rows], "aoi")).join(F.broadcast(names), keys, "left_semi")
        part = f"batches/{uuid.uuid4().hex}"
        layers = ["aoi", *period]
        # A directory per tile would be as many files as the grid has tiles, each batch anew.
        highest = max_composite(cells, period).hint("rebalance", *layers)
        highest = highest.sortWithinPartitions(*layers, *[F.floor(F.col(c) / tile) for c in CELL], *CELL)
        highest.write.partitionBy(*layers).parquet(f"{path}/{part}")
        now = names.withColumn("part", F.lit(part))
        versions.publish(spark, f"{path}/scenes", (now if known is None else known.unionByName(now)).write.parquet)
        taken += len(rows)


def kept_composites(spark: SparkSession, path: str) -> DataFrame | None:
    """The composites of all scenes taken in; None before the first.

    The parts are combined as they are read, the highest value of a cell
    before the shuffle; ``compact`` makes one part of them.
    """
    known = _known(spark, f"{path}/scenes")
    if known is None:
        return None
    # A row per part, of which every compaction leaves one.
    parts = sorted(r.part for r in known.select("part").distinct().collect())
    made = [spark.read.parquet(f"{path}/{p}" if "/" in p else f"{path}/parts/{p}").drop("tile") for p in parts]
    if len(made) == 1:
        return made[0]
    union = made[0]
    for other in made[1:]:
        union = union.unionByName(other)
    keys = [c for c in union.columns if c != "value"]
    return union.groupBy(*keys).agg(F.max("value").alias("value"))


def compact(spark: SparkSession, path: str, *, tile: int = TILE) -> None:
    """One part in place of many, by tile. The parts it is made from stay for readers of the version before, until the next time."""
    known = _known(spark, f"{path}/scenes")
    if known is None:
        return
    part = f"parts/{uuid.uuid4().hex}"
    whole = kept_composites(spark, path).withColumn(
        "tile", F.concat_ws("_", *[F.floor(F.col(c) / tile).cast("string") for c in CELL])
    )
    period = [c for c in whole.columns if c not in (*LAYER, *CELL, "value", "tile")]
    whole = whole.hint("rebalance", "aoi", *period, "tile")
    whole.write.partitionBy("aoi", *period, "tile").parquet(f"{path}/{part}")
    versions.publish(spark, f"{path}/scenes", known.withColumn("part", F.lit(part)).write.parquet)


# -- baselines ---------------------------------------------------------------

# Sums of decimals are exact, so a year that is taken out again leaves nothing behind.
VALUE = "decimal(24, 18)"


def moments(annual: DataFrame, sign: int = 1, cell: Sequence[str] = CELL) -> DataFrame:
    """Sum and number of the annual values of each cell, negative ones to take them out."""
    return annual.groupBy(*LAYER, *cell).agg(
        F.sum(F.col("value").cast(VALUE) * sign).cast("decimal(38, 18)").alias("total"),
        (F.count("value") * sign).alias("n_years"),
    )


def merged_moments(*parts: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    union = parts[0]
    for other in parts[1:]:
        union = union.unionByName(other)
    summed = union.groupBy(*LAYER, *cell).agg(
        F.sum("total").cast("decimal(38, 18)").alias("total"), F.sum("n_years").alias("n_years")
    )
    return summed.filter("n_years > 0")


def baseline_of(kept: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """The mean that the moments stand for."""
    mean = F.col("total").cast("double") / F.col("n_years")
    return kept.select(*LAYER, *cell, mean.alias("baseline"), "n_years")


def sync_baseline(annual: DataFrame, years: DataFrame, path: str) -> tuple[int, int]:
    """Bring the moments kept under ``path`` to exactly the ``years`` (aoi, year); gives how many came and went.

    Years that are new, or were classed into the baseline, are added, years
    that were classed out of it are taken out; of ``annual`` (by aoi and year
    as partitions) those alone are read. Both are years of areas, so their
    list is short. A year whose own composite has changed is to be taken out
    with the old composite first.
    """
    spark, keys = annual.sparkSession, ["aoi", "year"]
    folder = versions.current(spark, path)
    years = years.select(*keys).distinct()
    before = spark.read.parquet(f"{folder}/years") if folder else years.limit(0)
    came = years.join(before, keys, "left_anti").collect()
    went = before.join(years, keys, "left_anti").collect()
    if folder and not came and not went:
        return 0, 0
    parts = [spark.read.parquet(f"{folder}/moments")] if folder else [moments(annual.limit(0))]
    for sign, own in ((1, came), (-1, went)):
        if own:
            read = annual.filter(_either([r.year for r in own], "year") & _either([r.aoi for r in own], "aoi"))
            names = F.broadcast(spark.createDataFrame(own, years.schema))
            parts.append(moments(read.join(names, keys, "left_semi"), sign))

    def write(made: str) -> None:
        merged_moments(*parts).write.parquet(f"{made}/moments")
        years.write.parquet(f"{made}/years")

    versions.publish(spark, path, write)
    return len(came), len(went)


def kept_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    folder = versions.current(spark, path)
    return baseline_of(spark.read.parquet(f"{folder}/moments")) if folder else None


# -- results by month ----------------------------------------------------------

MONTH = ("aoi", "year", "month")


def fingerprints(scenes: DataFrame, parameters: str, tag: Sequence[str] = ()) -> DataFrame:
    """A digest per (aoi, year, month) of its scenes, of what ``tag`` says of each, and of the parameters.

    A month of an area has a few dozen scenes.
    """
    scene = F.to_json(F.struct("scene_id", *tag))
    listed = F.array_join(F.array_sort(F.collect_set(scene)), "\n")
    return scenes.groupBy(*MONTH).agg(F.sha2(F.concat(F.lit(parameters + "\n"), listed), 256).alias("fingerprint"))


def sync_months(
    scenes: DataFrame, make: Callable[[Column], DataFrame], path: str, parameters: str, tag: Sequence[str] = ()
) -> int:
    """Bring results kept by (aoi, year, month) under ``path`` up to date; gives the number of months worked out.

    ``make`` takes a filter on aoi, year and month and gives the rows of those
    months. It is asked for months whose scenes, tags or ``parameters``
    differ from those the kept rows were made from; with none it is not
    called, and no band is read. Months without scenes any more go.
    """
    spark, keys = scenes.sparkSession, [*MONTH]
    wanted = fingerprints(scenes, parameters, tag)
    known = _known(spark, f"{path}/months")
    known = wanted.limit(0).withColumn("part", F.lit("")) if known is None else known
    fresh = known.join(wanted, [*keys, "fingerprint"], "left_semi")
    stale = wanted.join(known, [*keys, "fingerprint"], "left_anti").collect()
    if not stale and fresh.count() == known.count():
        return 0
    part = uuid.uuid4().hex
    now = spark.createDataFrame(stale, wanted.schema).withColumn("part", F.lit(part))
    if stale:
        asked = _either([r.aoi for r in stale], "aoi") & _either([r.year for r in stale], "year") & _either([r.month for r in stale], "month")
        rows = make(asked).join(F.broadcast(now.select(*keys)), keys, "left_semi")
        rows.write.parquet(f"{path}/parts/{part}")
    versions.publish(spark, f"{path}/months", fresh.select(*now.columns).unionByName(now).write.parquet)
    return len(stale)


def kept_months(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept rows of all months."""
    known = _known(spark, f"{path}/months")
    if known is None:
        return None
    union = None
    for part in sorted(r.part for r in known.select("part").distinct().collect()):
        own = spark.read.parquet(f"{path}/parts/{part}").withColumn("part", F.lit(part))
        union = own if union is None else union.unionByName(own)
    return None if union is None else union.join(known, [*MONTH, "part"], "left_semi").drop("part")
