"""Readers for cell stores, manifests, catalogs and small tables.

``parse_*`` work on a DataFrame of text rows, so they take a file, a table
column or a stream alike; ``read_*`` add the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.functions.bands import nan_to_null
from canopygrid.model import INVENTORY_ENTRY, MANIFEST_ENTRY, STAC_ITEM, YEAR_CLASS
from canopygrid.sources import versions


def layer_cells(store: DataFrame, sensor: str, aoi: str, index_name: str) -> DataFrame:
    """Cells of one layer series; the filters are on partition columns."""
    return store.filter(
        (F.col("sensor") == sensor) & (F.col("aoi") == aoi) & (F.col("index_name") == index_name)
    ).withColumn("value", nan_to_null(F.col("value")))


def read_cells(spark: SparkSession, path: str, sensor: str, aoi: str, index_name: str) -> DataFrame:
    return layer_cells(spark.read.parquet(path), sensor, aoi, index_name)


def trait_cells(traits: DataFrame) -> DataFrame:
    """Static cell properties; NaN, as rasters mark flat or missing ground, becomes null."""
    real = {f.name for f in traits.schema.fields if f.dataType.typeName() in ("double", "float")}
    return traits.select(*[nan_to_null(F.col(c)).alias(c) if c in real else F.col(c) for c in traits.columns])


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    return trait_cells(spark.read.parquet(path))


def parse_manifest(documents: DataFrame, column: str = "value") -> DataFrame:
    """Scene rows from manifest documents {scene_id: {filename, date, ...}}.

    Any number of documents, each with one scene or many.
    """
    entries = F.from_json(column, T.MapType(T.StringType(), MANIFEST_ENTRY))
    return documents.select(F.explode(entries).alias("scene_id", "meta")).select(
        "scene_id",
        "meta.*",
        F.to_timestamp_ntz(F.regexp_replace("meta.date", r"(Z|[+-]\d\d:\d\d)$", "")).alias("obs_ts"),
    )


def read_manifest(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """One document per file, or with ``lines`` one per line as ``write_manifest`` leaves it, of the current version."""
    if lines:
        path = versions.current(spark, path) or path
    return parse_manifest(spark.read.text(path, wholetext=not lines))


def stored_scenes(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """Manifest scenes whose layer file exists."""
    return manifest.join(outputs.select("filename"), "filename", "left_semi")


def stac_columns(items: DataFrame) -> DataFrame:
    """Flat scene columns of STAC items; missing properties are null."""
    p = F.col("properties")
    return items.select(
        F.col("id").alias("scene_id"),
        F.to_timestamp_ntz(F.regexp_replace(p["datetime"], r"(Z|[+-]\d\d:\d\d)$", "")).alias("obs_ts"),
        p["eo:cloud_cover"].alias("cloud_cover"),
        p["platform"].alias("platform"),
        p["landsat:wrs_path"].alias("wrs_path"),
        p["landsat:wrs_row"].alias("wrs_row"),
        F.col("bbox")[0].alias("x_min"),
        F.col("bbox")[1].alias("y_min"),
        F.col("bbox")[2].alias("x_max"),
        F.col("bbox")[3].alias("y_max"),
        "assets",
    )


def parse_stac_items(documents: DataFrame, column: str = "value") -> DataFrame:
    return stac_columns(documents.select(F.from_json(column, STAC_ITEM).alias("item")).select("item.*"))


def read_stac_items(spark: SparkSession, path: str) -> DataFrame:
    """Item JSON files, one item per line or file."""
    return stac_columns(spark.read.schema(STAC_ITEM).option("multiLine", True).json(path))


def parse_year_class(lines: DataFrame, column: str = "value") -> DataFrame:
    """aoi, year, classification, usdm_net_score from CSV lines; a header line is skipped."""
    return (
        lines.filter(~F.col(column).startswith("aoi,"))
        .select(F.from_csv(column, YEAR_CLASS.simpleString()[len("struct<") : -1].replace(":", " ")).alias("r"))
        .select("r.*")
    )


def read_year_class(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(YEAR_CLASS).option("header", True).csv(path)


def parse_inventory(documents: DataFrame, column: str = "value") -> DataFrame:
    """(code, label, pixels, km2) from inventory documents {code: {...}}."""
    entries = F.from_json(column, T.MapType(T.StringType(), INVENTORY_ENTRY))
    return documents.select(F.explode(entries).alias("key", "entry")).select(
        F.col("key").cast("int").alias("code"), "entry.*"
    )


def read_inventory(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    return parse_inventory(spark.read.text(path, wholetext=not lines))


def aoi_vertices(vertices: DataFrame, landscape_id: str) -> DataFrame:
    """Outline of one area; running it without any such area fails."""
    wanted = vertices.filter(F.col("landscape_id") == landscape_id)
    # One row saying whether anything was found, joined to keep the plan lazy.
    found = wanted.agg(F.count("*").alias("__n")).select(
        F.when(F.col("__n") > 0, F.lit(landscape_id))
        .otherwise(F.raise_error(F.lit(f"no area named {landscape_id}")).cast("string"))
        .alias("landscape_id")
    )
    return found.join(wanted, "landscape_id")
