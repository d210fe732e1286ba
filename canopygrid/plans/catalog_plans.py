"""Registered queries: sources, sinks and the scene catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.functions import labels, naming
from canopygrid.model import INDICES, MANIFEST_ENTRY
from canopygrid.operators import catalog, composites, grid, strata
from canopygrid.plans import fixtures as fx
from canopygrid.session import shared_folder
from canopygrid.sources import readers, writers

CLOUD_MAX = 40


def named_stac(spark: SparkSession, sf: str) -> DataFrame:
    return fx.stac(spark, sf).withColumns(
        {"day": naming.day_text(F.col("obs_ts")), "tile": naming.tile_id(F.col("scene_id"))}
    )


# -- sources and sinks --------------------------------------------------------


def scan_cells(spark, sf):
    store = fx.cells(spark, sf).withColumn("sensor", F.lit("sentinel-2"))
    out = readers.layer_cells(store, "sentinel-2", "north", "NDVI")
    return out.select("aoi", "index_name", "year", "month", "row", "col", F.round("value", 6).alias("value"))


def scan_manifest(spark, sf):
    entries = fx.manifest(spark, sf).select(
        F.concat_ws("_", "index_name", F.col("item").cast("string")).alias("scene_id"),
        "filename",
        F.concat(F.col("day"), F.lit("T00:00:00+00:00")).alias("__d"),
        "cloud_cover",
    ).withColumn(
        "date",
        F.concat_ws("-", F.substring("__d", 1, 4), F.substring("__d", 5, 2), F.substring("__d", 7, 99)),
    )
    documents = writers.manifest_documents(entries.select("scene_id", "filename", "date", "cloud_cover"))
    scenes = readers.stored_scenes(readers.parse_manifest(documents), fx.outputs(spark, sf))
    return scenes.select(
        "scene_id", "filename", F.date_format("obs_ts", "yyyy-MM-dd").alias("date"), "cloud_cover"
    ).orderBy("date", "scene_id")


def scan_stac_items(spark, sf):
    s = fx.stac(spark, sf)
    items = s.select(
        F.to_json(
            F.struct(
                F.col("scene_id").alias("id"),
                F.array("x_min", "y_min", "x_max", "y_max").alias("bbox"),
                F.struct(
                    F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
                    F.col("cloud_cover").alias("eo:cloud_cover"),
                    "platform",
                    F.col("wrs_path").alias("landsat:wrs_path"),
                    F.col("wrs_row").alias("landsat:wrs_row"),
                ).alias("properties"),
                F.create_map(
                    F.lit("red"),
                    F.struct(F.concat(F.lit("red/"), F.col("item").cast("string")).alias("href")),
                ).alias("assets"),
            )
        ).alias("value")
    )
    return readers.parse_stac_items(items).select(
        "scene_id",
        F.date_format("obs_ts", "yyyy-MM-dd").alias("date"),
        "cloud_cover",
        "platform",
        "wrs_path",
        "wrs_row",
        "x_min",
        "y_max",
        F.col("assets")["red"]["href"].alias("red_href"),
    )


def scan_year_class(spark, sf):
    rows = fx.year_class(spark, sf).select("aoi", "year", "classification", "usdm_net_score")
    lines = rows.select(F.to_csv(F.struct(*rows.columns)).alias("value"))
    return readers.parse_year_class(lines)


def scan_labels(spark, sf):
    t = fx.traits(spark, sf)
    parts = [
        labels.with_label(strata.class_counts(t, kind), kind, kind).select(
            F.lit(kind).alias("kind"), F.col(kind).alias("code"), "label", "px"
        )
        for kind in ("forest_group", "forest_type", "ecozone")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scan_inventory(spark, sf):
    groups = strata.forest_group_strata(fx.traits(spark, sf), min_px=50)
    return (
        readers.parse_inventory(writers.inventory_documents(groups))
        .select("code", "label", "pixels", F.round("km2", 6).alias("km2"))
        .orderBy("code")
    )


def scan_aoi(spark, sf):
    return readers.aoi_vertices(fx.vertices(spark, sf), "landscape south").select(
        "landscape_id", "aoi", "ring", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


def sink_cells(spark, sf):
    """Annual layers of every series and their tags, written and read back."""
    path, tags = shared_folder(spark, "cells"), shared_folder(spark, "layers")
    annual = composites.max_composite_wide(fx.wide_cells(spark, sf)).withColumn("sensor", F.lit("sentinel-2"))
    writers.write_cells(annual, path, tile=16)
    back = spark.read.parquet(path)
    scenes = fx.obs(spark, sf).select("aoi", "scene_id", "platform", "year").distinct()
    writers.write_catalog(
        composites.composite_metadata(back, scenes, fx.grid_cells(spark, sf)), tags
    )
    return (
        back.join(spark.read.parquet(tags).select("aoi", "index_name", "year", "scene_count"), ["aoi", "index_name", "year"])
        .select("aoi", "index_name", "year", "row", "col", F.round("value", 6).alias("value"), "scene_count")
    )


def sink_manifest(spark, sf):
    """Entries of all scenes, then a third of them once more; read back with every field."""
    path = shared_folder(spark, "manifest")
    item = F.col("item")
    day = [F.substring("day", a, n) for a, n in ((1, 4), (5, 2), (7, 2))]
    entries = fx.manifest(spark, sf).select(
        "item",
        F.concat_ws("_", "index_name", item.cast("string")).alias("scene_id"),
        "filename",
        F.concat_ws("-", *day).alias("date"),
        "cloud_cover",
        (item % 100 / 100).alias("clear_frac"),
        (item % 7 / 10).alias("snow_frac"),
        F.lit("first").alias("processed"),
    )
    writers.update_manifest(entries, path)
    again = entries.filter(item % 3 == 0).withColumns({"cloud_cover": F.lit(None).cast("double"), "processed": F.lit("again")})
    writers.update_manifest(again, path)
    return readers.read_manifest(spark, path, lines=True).select("scene_id", *[f.name for f in MANIFEST_ENTRY])


def sink_inventory(spark, sf):
    path = shared_folder(spark, "inventory")
    writers.write_inventory(strata.forest_group_strata(fx.traits(spark, sf), min_px=50), path)
    return readers.read_inventory(spark, path, lines=True).select(
        "code", "label", "pixels", F.round("km2", 6).alias("km2")
    )


def sink_table(spark, sf):
    path = shared_folder(spark, "table")
    stats = composites.anomaly_stats(composites.anomaly(composites.max_composite_wide(fx.wide_cells(spark, sf))))
    columns = ["aoi", "index_name", "year", "n_px", "mean_anomaly", "min_anomaly", "max_anomaly"]
    writers.write_table(stats, path, columns)
    return spark.read.parquet(path)


def incremental_skip(spark, sf):
    requested = fx.layers(spark, sf, ("year", "month"))
    existing = requested.filter(F.col("month") % 4 != 0)
    return catalog.incremental_skip(requested, existing, ["aoi", "index_name", "year", "month"])


# -- scene catalog ------------------------------------------------------------


def day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def windows(spark, sf):
    bounds = fx.stac(spark, sf).agg(
        F.date_add(F.to_date(F.min("obs_ts")), 13).alias("start"), F.to_date(F.max("obs_ts")).alias("end")
    )
    return catalog.search_windows(bounds)


def search_windows(spark, sf):
    return windows(spark, sf).select(day("win_start"), day("win_end"))


def search_windows_calendar(spark, sf):
    bounds = fx.stac(spark, sf).agg(
        F.year(F.min("obs_ts")).alias("first_year"), F.year(F.max("obs_ts")).alias("last_year")
    )
    return catalog.search_windows_calendar(bounds, "2001-05-01").select(day("win_start"), day("win_end"))


def window_assign(spark, sf):
    return catalog.window_assign(fx.stac(spark, sf), windows(spark, sf)).select(
        "item", day("win_start"), day("win_end")
    )


def scene_union(spark, sf):
    s = fx.stac(spark, sf)
    return catalog.scene_union(
        catalog.cloud_filter(s, CLOUD_MAX).select("item", "platform"),
        catalog.platform_filter(s).select("item", "platform"),
    )


def footprint_intersects(spark, sf):
    areas = grid.canonical_grid(fx.vertices(spark, sf), 1.0)
    return catalog.footprint_intersects(fx.stac(spark, sf), areas, bucket=16.0).select("item", "aoi")


def footprint_polygons(spark, sf):
    """Footprints that meet an area as polygons, behind a test of the buckets that both lie in."""
    return catalog.shapes_intersect(fx.footprint_shapes(spark, sf), fx.vertices(spark, sf), 5.0).select("item", "aoi")


def cloud_filter(spark, sf):
    return catalog.cloud_filter(fx.stac(spark, sf), CLOUD_MAX).select("item", "cloud_cover")


def platform_filter(spark, sf):
    return catalog.platform_filter(fx.stac(spark, sf)).select("item", "platform")


def date_range_filter(spark, sf):
    return catalog.date_range_filter(fx.stac(spark, sf), "1996-03-01", "1999-12-31").select(
        "item", naming.day_text(F.col("obs_ts")).alias("day")
    )


def tile_id(spark, sf):
    return named_stac(spark, sf).select("item", "scene_id", F.col("tile").alias("tile_id"))


def path_row(spark, sf):
    path, row = F.col("wrs_path"), F.col("wrs_row")
    return fx.stac(spark, sf).select(
        "item",
        naming.path_row(path, row).alias("path_row"),
        naming.path_row_display(path, row).alias("path_row_text"),
    )


def scene_dedup(spark, sf):
    return fx.scenes_s2(spark, sf).select("item", "day", F.col("tile").alias("tile_id"))


def scene_dedup_path_row(spark, sf):
    s = catalog.platform_filter(catalog.cloud_filter(fx.stac(spark, sf), CLOUD_MAX))
    s = s.withColumns(
        {"day": naming.day_text(F.col("obs_ts")), "path_row": naming.path_row(F.col("wrs_path"), F.col("wrs_row"))}
    )
    return catalog.scene_dedup(s, "path_row").select("item", "day", "path_row")


def cache_inventory(spark, sf):
    return catalog.cache_inventory(fx.scenes_s2(spark, sf), fx.outputs(spark, sf), INDICES)


def cache_audit(spark, sf):
    return catalog.cache_audit(fx.scenes_s2(spark, sf), fx.outputs(spark, sf), INDICES).select(
        "index_name", "day", F.col("tile").alias("tile_id"), "cloud_cover", "status"
    )


def manifest_heal(spark, sf):
    return catalog.manifest_heal(
        fx.scenes_s2(spark, sf), fx.outputs(spark, sf), fx.manifest(spark, sf), INDICES
    )


def manifest_rebuild(spark, sf):
    names = F.array(*[F.lit(i) for i in INDICES])
    wanted = fx.scenes(spark, sf).withColumn("index_name", F.explode(names))
    return catalog.manifest_rebuild(wanted, fx.cells(spark, sf), fx.grid_cells(spark, sf)).select(
        "aoi", "index_name", "scene_id", "valid_px", F.round("veg_coverage", 6).alias("veg_coverage"), "missing"
    )


def year_floor(spark, sf):
    s = fx.stac(spark, sf).withColumn("year", F.year("obs_ts"))
    return catalog.year_floor(s, 1997).select("item", "year")


def available_years(spark, sf):
    names = fx.layers(spark, sf, ("year", "month")).select(
        F.when(F.col("month") == 2, F.lit("overview")).otherwise(naming.layer_name(F.col("year"), F.col("month"))).alias("name")
    )
    return catalog.available_years(names, 1997)


def scene_group_year(spark, sf):
    s = fx.scenes_s2(spark, sf).withColumn("year", F.year("obs_ts"))
    return catalog.scene_groups(s, ["year"]).select("year", "rank", "item", "day", "tile")


def scene_group_month(spark, sf):
    s = fx.scenes_s2(spark, sf).withColumns({"year": F.year("obs_ts"), "month": F.month("obs_ts")})
    return catalog.scene_groups(s, ["year", "month"]).select("year", "month", "rank", "item", "day", "tile")


QUERIES = {
    f.__name__: f
    for f in (
        scan_cells, scan_manifest, scan_stac_items, scan_year_class, scan_labels, scan_inventory, scan_aoi,
        sink_cells, sink_manifest, sink_inventory, sink_table, incremental_skip,
        search_windows, search_windows_calendar, window_assign, scene_union, footprint_intersects,
        footprint_polygons,
        cloud_filter, platform_filter, date_range_filter, tile_id, path_row, scene_dedup, scene_dedup_path_row,
        cache_inventory, cache_audit, manifest_heal, manifest_rebuild, year_floor, available_years,
        scene_group_year, scene_group_month,
    )
}
