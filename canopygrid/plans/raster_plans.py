"""Registered queries: pixel functions, grids, terrain, strata and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.functions import naming, terrain
from canopygrid.model import INDICES, LANDSAT, SENTINEL2, Grid
from canopygrid.operators import composites, grid, incremental, pixels, strata
from canopygrid.plans import fixtures as fx
from canopygrid.session import shared_folder
from canopygrid.sources import writers

KEYS = list(fx.CELL_KEYS)
# Smallest number of cells a class or band needs on the small test grids.
MIN_CLASS_PX = 50


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


# -- pixel functions ----------------------------------------------------------


def _scaled(sensor, df, digits):
    """All digits the raw numbers give, so that rounding meets no ties."""
    names = ("blue", "red", "nir", "swir")
    return df.select(*KEYS, *[F.round(B.reflectance(sensor, F.col(b)), digits).alias(b) for b in names])


def scale_s2(spark, sf):
    return _scaled(SENTINEL2, fx.obs(spark, sf), 9)


def scale_landsat(spark, sf):
    return _scaled(LANDSAT, fx.obs_landsat(spark, sf), 12)


def _all_valid(sensor):
    return B.all_of([B.valid_band(sensor, F.col(b)) for b in B.bands_for(INDICES)])


def valid_dn(spark, sf):
    return fx.obs(spark, sf).select(*KEYS, _all_valid(SENTINEL2).alias("valid"))


def valid_reflectance(spark, sf):
    return fx.obs_landsat(spark, sf).select(*KEYS, _all_valid(LANDSAT).alias("valid"))


def scl_mask(spark, sf):
    return fx.obs(spark, sf).select(*KEYS, "scl", B.clear_of_cloud(SENTINEL2, F.col("scl")).alias("clear"))


def qa_bitmask(spark, sf):
    return fx.obs_landsat(spark, sf).select(*KEYS, "qa", B.clear_of_cloud(LANDSAT, F.col("qa")).alias("clear"))


def _one_index(name):
    """The index of both sensors' bands, before masking."""

    def query(spark, sf):
        parts = []
        for sensor, df in ((SENTINEL2, fx.obs(spark, sf)), (LANDSAT, fx.obs_landsat(spark, sf))):
            scaled = {b: B.reflectance(sensor, F.col(b)) for b in B.bands_for([name])}
            parts.append(
                df.select(F.lit(sensor.name).alias("sensor"), *KEYS, r6(B.index_expression(name, scaled), "value"))
            )
        return parts[0].unionByName(parts[1])

    query.__name__ = name.lower()
    return query


ndvi, ndmi, evi = (_one_index(name) for name in INDICES)


def index_dispatch(spark, sf):
    """Two indices, each needing only its own bands."""
    return pixels.index_cells(
        fx.obs_landsat(spark, sf), LANDSAT, KEYS, ["NDVI", "EVI"], validity_scope="own_bands"
    ).withColumn("value", F.round("value", 6))


def flagged_obs(spark, sf, source=fx.obs):
    """Observations with whether their cell lies inside the area."""
    return grid.with_aoi_flag(source(spark, sf), fx.vertices(spark, sf), fx.GRID)


def combined_mask(spark, sf):
    out = pixels.with_indices(flagged_obs(spark, sf), SENTINEL2, in_aoi=F.col("in_aoi"))
    return out.select(*KEYS, *[r6(i) for i in INDICES])


def aoi_mask(spark, sf):
    return grid.with_aoi_flag(fx.area_cells(spark, sf), fx.vertices(spark, sf), fx.GRID).select(
        "aoi", "row", "col", "in_aoi"
    )


def inside_area(spark, sf, tile=16):
    """Observations inside their area, from a store in tiles: those outside are not read."""
    store = shared_folder(spark, "tiled")
    tiled = fx.obs(spark, sf).select(*KEYS, "nir").withColumns(grid.tile_columns(tile))
    tiled.repartition("tile_row", "tile_col").write.partitionBy("tile_row", "tile_col").parquet(store)
    outlines, kept = fx.vertices(spark, sf), shared_folder(spark, "tiles")
    grid.aoi_tiles(outlines, fx.GRID, tile).write.parquet(kept)
    inside = grid.inside_area(spark.read.parquet(store), outlines, fx.GRID, tile, spark.read.parquet(kept))
    return inside.select(*KEYS, r6("nir"))


def class_fill_outside(spark, sf):
    return pixels.class_fill_outside(flagged_obs(spark, sf), SENTINEL2).select(*KEYS, "scl")


def snow_fraction(spark, sf):
    areas = grid.aoi_pixels(fx.vertices(spark, sf), fx.GRID)
    out = pixels.scene_fractions(flagged_obs(spark, sf), areas, SENTINEL2)
    qa = pixels.scene_fractions(flagged_obs(spark, sf, fx.obs_landsat), areas, LANDSAT)
    keep = ["aoi", "scene_id", "area_px", "snow_px", "snow_frac"]
    return (
        out.select(F.lit(SENTINEL2.name).alias("sensor"), *keep)
        .unionByName(qa.select(F.lit(LANDSAT.name).alias("sensor"), *keep))
    )


def clear_fraction(spark, sf):
    areas = grid.aoi_pixels(fx.vertices(spark, sf), fx.GRID)
    out = pixels.scene_fractions(flagged_obs(spark, sf), areas, SENTINEL2)
    qa = pixels.scene_fractions(flagged_obs(spark, sf, fx.obs_landsat), areas, LANDSAT)
    keep = ["aoi", "scene_id", "area_px", "clear_px"]
    return (
        out.select(F.lit(SENTINEL2.name).alias("sensor"), *keep, "clear_frac")
        .unionByName(qa.select(F.lit(LANDSAT.name).alias("sensor"), *keep, F.col("valid_frac").alias("clear_frac")))
    )


def valid_predicate(spark, sf):
    odd = (
        F.when(F.col("scl") == 5, F.lit(float("nan")))
        .when(F.col("scl") == 6, F.lit(float("inf")))
        .otherwise(F.col("nir"))
    )
    df = fx.obs(spark, sf).select("aoi", "year", odd.alias("v"))
    return df.groupBy("aoi", "year").agg(
        F.count(B.nan_to_null(F.col("v"))).alias("n_not_nan"), F.count_if(B.finite(F.col("v"))).alias("n_finite")
    )


# -- grid and terrain ---------------------------------------------------------

UTM = Grid(x_min=300000.0, y_max=4300000.0, width=fx.WIDTH, height=None, dx=10.0, dy=10.0)


def _coarser(g, factor):
    return Grid(g.x_min, g.y_max, g.width // factor, None, g.dx * factor, g.dy * factor)


def canonical_grid(spark, sf):
    out = grid.canonical_grid(fx.vertices(spark, sf), 0.7)
    return out.select("aoi", *[r6(c) for c in ("x_min", "x_max", "y_min", "y_max", "dx", "dy")], "width", "height")


def aoi_area(spark, sf):
    return grid.aoi_area(fx.vertices(spark, sf)).select("aoi", F.round("area_km2", 9).alias("area_km2"))


def bbox_share(spark, sf):
    flagged = grid.with_aoi_flag(fx.area_cells(spark, sf), fx.vertices(spark, sf), fx.GRID)
    return grid.bbox_share(flagged).select("aoi", "n_cells", "n_inside", r6("inside_share"))


def cell_centers(spark, sf):
    return grid.cell_centers(fx.traits(spark, sf).select("row", "col"), UTM)


def regrid_nearest(spark, sf):
    """Ecozones on a grid of three times the cell size."""
    source = fx.traits(spark, sf)
    target = source.filter((F.col("row") % 3 == 0) & (F.col("col") % 3 == 0)).select(
        F.floor(F.col("row") / 3).cast("int").alias("row"), F.floor(F.col("col") / 3).cast("int").alias("col")
    )
    return grid.regrid_nearest(target, source, _coarser(UTM, 3), UTM, "ecozone").select("row", "col", "ecozone")


def regrid_bilinear(spark, sf):
    """Elevation on a grid of half the cell size."""
    fine = Grid(UTM.x_min, UTM.y_max, UTM.width * 2, None, UTM.dx / 2, UTM.dy / 2)
    return grid.resample_bilinear(fx.traits(spark, sf), fine, UTM, "elevation").select("row", "col", r6("elevation"))


def dem_mosaic(spark, sf):
    t = fx.traits(spark, sf)
    west = t.filter("col < 30").select("row", "col", "elevation")
    east = t.filter("col >= 20").select("row", "col", (F.col("elevation") + F.col("slope")).alias("elevation"))
    return grid.dem_mosaic(west, east).select("row", "col", r6("elevation"))


def _terrain(spark, sf, **options):
    return grid.slope_aspect(fx.traits(spark, sf).select("row", "col", "elevation"), **options)


def gradient_xy(spark, sf):
    return grid.gradient_xy(fx.traits(spark, sf).select("row", "col", "elevation"), tile=16).select(
        "row", "col", r6("dx"), r6("dy")
    )


def slope(spark, sf):
    return _terrain(spark, sf).select("row", "col", r6("slope"))


def aspect(spark, sf):
    return _terrain(spark, sf, spacing=1000.0).select("row", "col", r6("aspect"))


def raster_stats(spark, sf):
    out = grid.raster_stats(fx.traits(spark, sf), "elevation", value_range=(0.0, 3000.0))
    return out.select(
        "n_cells", "n_valid", *[r6(c) for c in ("min", "max", "mean", "p25", "p50", "p75", "valid_share")], "has_negative"
    )


def alignment_check(spark, sf):
    """One layer per brand, some of them off the grid of the table."""
    t = fx.traits(spark, sf)
    number = F.regexp_extract("layer", r"(\d+)$", 1).cast("int")
    header = [
        F.lit(fx.WIDTH).alias("width"),
        (F.max("row") + 1).alias("height"),
        F.lit(0.0).alias("x_min"),
        (F.max("row") + 1).cast("double").alias("y_max"),
    ]
    expected = t.agg(*header).select(
        F.explode(F.array(F.lit("north"), F.lit("south"))).alias("aoi"), F.lit(32617).alias("epsg"), F.lit(10.0).alias("res"), "width", "height", "x_min", "y_max"
    )
    layers = t.groupBy("layer").agg(*header).select(
        F.when(number % 2 == 0, "north").otherwise("south").alias("aoi"),
        "layer",
        F.when(number % 7 != 0, F.when(number % 5 == 0, 4326).otherwise(32617)).alias("epsg"),
        (10.0 + (number % 3) * 0.008).alias("res"),
        "width",
        "height",
        (F.col("x_min") + F.when(number % 4 == 0, 5.0).otherwise(0.0)).alias("x_min"),
        "y_max",
    )
    return grid.alignment_check(layers, expected).select("layer", "issues", "n_issues")


# -- strata -------------------------------------------------------------------


def aspect_strata(spark, sf):
    return fx.traits(spark, sf).select("row", "col", terrain.aspect_side(F.col("aspect")).alias("side"))


def aspect_strata_slope5(spark, sf):
    side = terrain.aspect_side(F.col("aspect"), F.col("slope"), 5.0)
    return fx.traits(spark, sf).select("row", "col", side.alias("side"))


def steep_mask(spark, sf):
    return fx.traits(spark, sf).select("row", "col", terrain.steep(F.col("slope")).alias("steep"))


def elev_bands_fixed(spark, sf):
    return fx.traits(spark, sf).select("row", "col", terrain.elevation_class(F.col("elevation")).alias("band"))


def elev_bands_positive(spark, sf):
    shifted = F.col("elevation") - 80
    return fx.traits(spark, sf).select(
        "row", "col", terrain.elevation_class(shifted, positive_low=True).alias("band")
    )


def elev_bands_uniform(spark, sf):
    return strata.elevation_bands(fx.traits(spark, sf), 200, MIN_CLASS_PX)


def forest_group_strata(spark, sf):
    return strata.forest_group_strata(fx.traits(spark, sf), MIN_CLASS_PX).withColumn("km2", F.round("km2", 6))


def skipped_groups(spark, sf):
    return strata.skipped_groups(fx.traits(spark, sf), MIN_CLASS_PX).withColumn("km2", F.round("km2", 6))


def ecozone_strata(spark, sf):
    return strata.ecozone_strata(fx.traits(spark, sf))


def mask_coverage(spark, sf):
    return strata.mask_coverage(fx.traits(spark, sf), strata.terrain_masks()).withColumn("km2", F.round("km2", 6))


def mask_overlap_audit(spark, sf):
    out = strata.mask_overlap_audit(fx.traits(spark, sf))
    return out.select(*[r6(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _histogram(df):
    return df.withColumns({"km2": F.round("km2", 6), "pct": F.round("pct", 6)})


def class_histogram(spark, sf):
    return _histogram(strata.class_histogram(fx.traits(spark, sf), "forest_group", "forest_group"))


def class_topk(spark, sf):
    return _histogram(strata.class_topk(fx.traits(spark, sf), "forest_type", "forest_type"))


# -- composites ---------------------------------------------------------------


def annual(spark, sf):
    return composites.max_composite_wide(fx.wide_cells(spark, sf))


def monthly(spark, sf):
    return composites.max_composite_wide(fx.wide_cells(spark, sf), ("year", "month"))


def annual_max(spark, sf):
    return annual(spark, sf).withColumn("value", F.round("value", 6))


def annual_max_kept(spark, sf):
    """The same kept up to date: half of the scenes, then those that have come since."""
    store, path = shared_folder(spark, "scenes"), shared_folder(spark, "composites")
    writers.write_cells(fx.cells(spark, sf).withColumn("sensor", F.lit(SENTINEL2.name)), store, tile=16)
    cells, scenes = spark.read.parquet(store), fx.scenes(spark, sf)
    incremental.extend_composites(cells, scenes.filter("month % 2 = 0"), path, tile=16)
    incremental.extend_composites(cells, scenes, path, tile=16)
    kept = incremental.kept_composites(spark, path)
    return kept.select("aoi", "index_name", "year", "row", "col", r6("value"))


def monthly_max(spark, sf):
    return monthly(spark, sf).withColumn("value", F.round("value", 6))


def composite_drop_empty(spark, sf):
    """Months with a scene, and whether a composite is left after masking."""
    wanted = fx.layers(spark, sf, ("year", "month"))
    made = monthly(spark, sf).groupBy("aoi", "index_name", "year", "month").agg(
        F.count("*").alias("valid_px")
    )
    return wanted.join(made, ["aoi", "index_name", "year", "month"])


def composite_metadata(spark, sf):
    scenes = fx.obs(spark, sf).select("aoi", "scene_id", "platform", "year").distinct()
    return composites.composite_metadata(annual(spark, sf), scenes, fx.grid_cells(spark, sf)).withColumn(
        "valid_pct", F.round("valid_pct", 6)
    )


def baseline_mean(spark, sf):
    return composites.baseline_mean(annual(spark, sf)).withColumn("baseline", F.round("baseline", 6))


def baseline_neutral(spark, sf):
    return composites.baseline_neutral(annual(spark, sf), fx.year_class(spark, sf)).withColumn(
        "baseline", F.round("baseline", 6)
    )


def baseline_neutral_kept(spark, sf):
    """The same by moments: of all years, from which those of other classes are taken out again."""
    layers, path = shared_folder(spark, "annual"), shared_folder(spark, "baseline")
    annual(spark, sf).write.partitionBy("aoi", "year").parquet(layers)
    stored, classes = spark.read.parquet(layers), fx.year_class(spark, sf)
    incremental.sync_baseline(stored, stored.select("aoi", "year"), path)
    incremental.sync_baseline(stored, classes.filter("classification = 'neutral'"), path)
    return incremental.kept_baseline(spark, path).withColumn("baseline", F.round("baseline", 6))


def anomaly(spark, sf):
    """Against the mean of the neutral years."""
    out = composites.anomaly(annual(spark, sf), fx.year_class(spark, sf))
    return out.select("aoi", "index_name", "year", "row", "col", r6("baseline"), r6("anomaly"))


def anomaly_stats(spark, sf):
    out = composites.anomaly_stats(composites.anomaly(annual(spark, sf)))
    return out.select("aoi", "index_name", "year", "n_px", r6("mean_anomaly"), r6("min_anomaly"), r6("max_anomaly"))


def acquired_date(spark, sf):
    """Layer names of every month and year, some malformed."""
    months = fx.layers(spark, sf, ("year", "month"))
    made = naming.layer_name(F.col("year"), F.col("month"))
    names = months.select(
        F.when(F.col("month") == 3, F.concat(made, F.lit(".tif")))
        .when(F.col("month") == 5, F.concat(F.col("year").cast("string"), F.lit("_13")))
        .when(F.col("month") == 8, F.lit("mosaic"))
        .when(F.col("month") == 9, naming.layer_name(F.col("year")))
        .otherwise(made)
        .alias("name")
    ).distinct()
    date = naming.acquired_date(F.col("name"))
    return names.select("name", F.date_format(date, "yyyy-MM-dd").alias("acquired")).orderBy("acquired", "name")


QUERIES = {
    f.__name__: f
    for f in (
        scale_s2, scale_landsat, valid_dn, valid_reflectance, scl_mask, qa_bitmask, ndvi, ndmi, evi,
        index_dispatch, combined_mask, aoi_mask, inside_area, class_fill_outside, snow_fraction, clear_fraction, valid_predicate,
        canonical_grid, aoi_area, bbox_share, cell_centers, regrid_nearest, regrid_bilinear, dem_mosaic,
        gradient_xy, slope, aspect, raster_stats, alignment_check,
        aspect_strata, aspect_strata_slope5, steep_mask, elev_bands_fixed, elev_bands_positive, elev_bands_uniform,
        forest_group_strata, skipped_groups, ecozone_strata, mask_coverage, mask_overlap_audit, class_histogram,
        class_topk,
        annual_max, annual_max_kept, monthly_max, composite_drop_empty, composite_metadata, baseline_mean, baseline_neutral,
        baseline_neutral_kept,
        anomaly, anomaly_stats, acquired_date,
    )
}
