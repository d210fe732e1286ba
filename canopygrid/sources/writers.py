"""Writers for cell stores, manifests, inventories and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.model import MANIFEST_ENTRY, TILE
from canopygrid.session import shared_folder
from canopygrid.sources import versions

STORE_PARTITIONS = ("sensor", "aoi", "index_name", "year")


def store_partitions(cells: DataFrame) -> tuple[str, ...]:
    """Composites lie by series and year, or month of it; scene cells by scene within the year."""
    for unit in ("scene_id", "month"):
        if unit in cells.columns:
            return (*STORE_PARTITIONS, unit)
    return STORE_PARTITIONS


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_cells(cells: DataFrame, path: str, *, mode: str = "overwrite", tile: int = TILE) -> None:
    """Cell store clustered by storage tile: composites by series and year, scene cells by scene too.

    Rows are rebalanced on the partition and sorted by tile: large partitions
    are split over several tasks, small ones share one and are a file each. The composites of a year or month,
    or the scenes, that ``cells`` has are replaced; all others stay.
    """
    parts = store_partitions(cells)
    tiled = cells.withColumns(
        {
            "tile_row": F.floor(F.col("row") / tile).cast("int"),
            "tile_col": F.floor(F.col("col") / tile).cast("int"),
        }
    )
    (
        tiled.hint("rebalance", *parts)
        .sortWithinPartitions(*parts, "tile_row", "tile_col", "row", "col")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def merge_cells(cells: DataFrame, path: str, *, tile: int = TILE) -> None:
    """Add cells to a store: those of the same partition and position are replaced, the rest of it stays.

    Only partitions that ``cells`` touches are read and rewritten, by way of
    the shared folder. Giving the same cells twice changes nothing.
    """
    spark = cells.sparkSession
    old = _stored(spark, path)
    if old is not None:
        parts = list(store_partitions(cells))
        before = old.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in cells.schema.fields])
        before = before.join(cells.select(*parts).distinct(), parts, "left_semi")
        rest = before.join(cells.select(*parts, "row", "col"), [*parts, "row", "col"], "left_anti")
        merged = shared_folder(spark, "cells-merged")
        cells.unionByName(rest).write.parquet(merged)
        cells = spark.read.schema(cells.schema).parquet(merged)
    write_cells(cells, path, tile=tile)


def write_catalog(layers: DataFrame, path: str) -> None:
    """Tags of composite layers (scene count, platforms, valid share), a row per layer.

    The layers that ``layers`` has are replaced, by sensor, area, index, year
    and month as far as it tells them apart; all others keep their tags.
    """
    parts = [c for c in (*STORE_PARTITIONS, "month") if c in layers.columns]
    layers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def manifest_documents(scenes: DataFrame) -> DataFrame:
    """One {scene_id: entry} document per scene; null keys are left out."""
    names = [f.name for f in MANIFEST_ENTRY if f.name in scenes.columns]
    return scenes.select(
        F.to_json(F.create_map("scene_id", F.struct(*names))).alias("value")
    )


def write_manifest(scenes: DataFrame, path: str) -> None:
    """Manifest as text, a document per line, so that no task holds all scenes; a new version of the folder."""
    documents = manifest_documents(scenes)
    versions.publish(scenes.sparkSession, path, lambda made: documents.write.text(made))


def update_manifest(scenes: DataFrame, path: str) -> None:
    """Add or replace the entries of ``scenes``; entries of other scenes stay as they are.

    The old version is read while the new one is written, and stays the
    current one until that is whole.
    """
    from canopygrid.sources.readers import read_manifest

    if versions.current(scenes.sparkSession, path) is None:
        write_manifest(scenes, path)
        return
    names = ["scene_id", *[f.name for f in MANIFEST_ENTRY]]
    old = read_manifest(scenes.sparkSession, path, lines=True).select(*names)
    rest = old.join(scenes.select("scene_id"), "scene_id", "left_anti")
    new = scenes.select(*[n for n in names if n in scenes.columns])
    write_manifest(new.unionByName(rest, allowMissingColumns=True), path)


def inventory_documents(groups: DataFrame, code: str = "forest_group") -> DataFrame:
    """One {code: {label, pixels, km2}} document per group."""
    return groups.select(
        F.to_json(
            F.create_map(
                F.col(code).cast("string"),
                F.struct("label", F.col("px").alias("pixels"), "km2"),
            )
        ).alias("value")
    )


def write_inventory(groups: DataFrame, path: str) -> None:
    inventory_documents(groups).write.mode("overwrite").text(path)


def result_table(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Fixed column order, fractions rounded."""
    types = dict(df.dtypes)
    return df.select(
        *[F.round(c, digits).alias(c) if types[c] in ("double", "float") else F.col(c) for c in columns]
    )


def write_table(df: DataFrame, path: str, columns: Sequence[str], *, form: str = "parquet", digits: int = 6) -> None:
    writer = result_table(df, columns, digits).write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")
