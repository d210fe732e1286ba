"""Registered queries: zonal percentiles, time series and cross-tabulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopygrid.model import INDICES, LANDSAT, SENTINEL2
from canopygrid.operators import composites, crosstab, incremental, pixels, strata, trend, zonal
from canopygrid.plans import fixtures as fx
from canopygrid.plans.raster_plans import MIN_CLASS_PX, monthly
from canopygrid.session import shared_folder
from canopygrid.sources import colocated

# Smallest number of cells per scene and stratum on the small test scenes.
MIN_PIXELS = 30
SCENE = list(zonal.SCENE)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scene_p(spark, sf, percentiles=(95, 99, 100), *, indices=INDICES, min_pixels=MIN_PIXELS, method="binned"):
    """Percentiles per scene and ecozone; masks are those of all indices whichever are kept."""
    zoned = fx.zoned_cells(spark, sf).filter(F.col("index_name").isin(*indices))
    return zonal.zonal_percentiles(zoned, ["ecozone"], percentiles, min_pixels=min_pixels, method=method)


def zonal_percentiles(spark, sf):
    return rounded(scene_p(spark, sf))


def colocated_cells(spark, sf, tile=16, buckets=8):
    """Index cells with each area's own zones: bands and zones stored by tile, and joined where they lie."""
    names, bands = [], fx.obs(spark, sf)
    buckets = colocated.bucket_count(bands, buckets)
    for what, df in (("bands", bands), ("zones", fx.area_traits(spark, sf).filter(F.col("ecozone").isin(1, 2, 3)))):
        folder = shared_folder(spark, what)
        names.append(f"{what}_{folder[-32:]}")
        colocated.write_bucketed(df, names[-1], buckets=buckets, tile=tile, folder=folder)
    bands, zones = (spark.table(n) for n in names)
    return pixels.index_cells(colocated.colocated_join(spark, bands, zones, ["ecozone"]), SENTINEL2, (*fx.CELL_KEYS, "ecozone"))


def zonal_percentiles_colocated(spark, sf):
    return rounded(zonal.zonal_percentiles(colocated_cells(spark, sf), ["ecozone"], min_pixels=MIN_PIXELS))


def zonal_whole_aoi(spark, sf):
    return rounded(zonal.zonal_whole_aoi(fx.cells(spark, sf), (75, 95)))


def peak_productivity(spark, sf):
    return rounded(zonal.peak_productivity(scene_p(spark, sf), fx.traits(spark, sf)))


def peak_productivity_landsat(spark, sf):
    """The same of the other sensor, whose scenes keep fewer cells."""
    zoned = fx.zoned_cells(spark, sf, LANDSAT)
    scenes = zonal.zonal_percentiles(zoned, ["ecozone"], min_pixels=5)
    return rounded(zonal.peak_productivity(scenes, fx.traits(spark, sf)))


def peak_summary_wide(spark, sf):
    tidy = zonal.peak_productivity(scene_p(spark, sf), fx.traits(spark, sf))
    return zonal.summary_wide(tidy, ["aoi", "ecozone", "pixel_count"], ["p95", "p99", "p100"])


def ecological_space(spark, sf):
    scenes = scene_p(spark, sf, (95,), indices=("NDVI", "NDMI"))
    tidy = zonal.mean_over_scenes(scenes, ["aoi", "index_name", "ecozone"], (95,))
    return rounded(zonal.index_pairs(tidy, ["aoi", "ecozone"]))


def curves(spark, sf, min_pixels=MIN_PIXELS):
    return zonal.seasonal_curves(scene_p(spark, sf, (95, 100), min_pixels=min_pixels))


def seasonal_curves(spark, sf, min_pixels=MIN_PIXELS):
    return rounded(curves(spark, sf, min_pixels))


def seasonal_scene_count(spark, sf):
    return zonal.seasonal_scene_count(curves(spark, sf))


def seasonal_band(spark, sf):
    return rounded(zonal.seasonal_band(curves(spark, sf)))


def seasonal_sync(spark, sf):
    return rounded(zonal.index_pairs(curves(spark, sf), ["aoi", "month", "ecozone"]))


def response(spark, sf):
    return zonal.drought_response(scene_p(spark, sf), fx.year_class(spark, sf))


def drought_response(spark, sf):
    return rounded(response(spark, sf))


def drought_scene_counts(spark, sf):
    return zonal.drought_scene_counts(fx.scenes(spark, sf), fx.year_class(spark, sf))


def unclassified_scenes(spark, sf):
    return zonal.unclassified_scenes(fx.scenes(spark, sf), fx.year_class(spark, sf))


def drought_space(spark, sf):
    return rounded(zonal.drought_space(response(spark, sf)))


def drought_table_wide(spark, sf):
    return zonal.summary_wide(
        response(spark, sf), ["aoi", "classification", "ecozone"], ["n_scenes", "p95", "p99", "p100"]
    )


def year_class_summary(spark, sf):
    return trend.year_class_summary(fx.year_class(spark, sf))


def season_partition(spark, sf):
    return zonal.season_partition(fx.scenes(spark, sf))


def moisture_amplitude(spark, sf):
    per_scene = scene_p(spark, sf, (95,), indices=("NDMI",))
    return rounded(zonal.moisture_amplitude(per_scene, fx.scenes(spark, sf)))


def medians(spark, sf):
    return zonal.zonal_median_monthly(monthly(spark, sf), fx.area_traits(spark, sf), min_pixels=MIN_PIXELS)


def zonal_median_monthly(spark, sf):
    return rounded(medians(spark, sf))


def zonal_median_monthly_kept(spark, sf):
    """Kept by month: all months, then those of one changed scene, then what is kept."""
    path = shared_folder(spark, "medians")
    cells, traits = fx.wide_cells(spark, sf), fx.area_traits(spark, sf)

    def make(months):
        composite = composites.max_composite_wide(cells.filter(months), ("year", "month"))
        return zonal.zonal_median_monthly(composite, traits, min_pixels=MIN_PIXELS)

    scenes = fx.scenes(spark, sf).withColumn("processed", F.lit(1))
    parameters = f"median, {MIN_PIXELS} cells"
    incremental.sync_months(scenes, make, path, parameters, ["processed"])
    redone = F.when((F.col("scene_id") == 199703) & (F.col("aoi") == "north"), 2).otherwise(1)
    incremental.sync_months(scenes.withColumn("processed", redone), make, path, parameters, ["processed"])
    return rounded(incremental.kept_months(spark, path))


def season_mean(spark, sf):
    """Mean of the monthly medians of December, counted for the year after."""
    return rounded(zonal.season_means(medians(spark, sf), (12,), "december", year_shift=1))


def amplitude(spark, sf):
    return zonal.seasonal_amplitude(medians(spark, sf), fx.layers(spark, sf))


def seasonal_amplitude(spark, sf):
    return rounded(amplitude(spark, sf))


def amplitude_trend(spark, sf):
    out = trend.linear_trend(amplitude(spark, sf), "amplitude")
    return rounded(out.select("aoi", "index_name", "ecozone", "year", "n_years", "slope", "fitted"))


def yearly(spark, sf):
    return trend.longterm_trend(scene_p(spark, sf, (95,)), fx.layers(spark, sf))


def longterm_trend(spark, sf):
    return rounded(yearly(spark, sf))


def trend_range(spark, sf):
    return rounded(trend.trend_range(yearly(spark, sf)))


def rolling_mean_5(spark, sf):
    return rounded(trend.rolling_mean(yearly(spark, sf)))


def trend_year_class(spark, sf):
    return trend.trend_year_class(fx.layers(spark, sf), fx.year_class(spark, sf))


def elevation_gradient(spark, sf):
    traits = fx.traits(spark, sf)
    banded = zonal.in_elevation_bands(fx.obs(spark, sf), traits, min_band_px=MIN_CLASS_PX)
    cells = pixels.index_cells(banded, SENTINEL2, (*fx.CELL_KEYS, "lo"))
    return rounded(zonal.elevation_gradient(cells, traits, min_band_px=MIN_CLASS_PX, min_pixels=5))


def with_aspect(spark, sf):
    return fx.cells_with(spark, sf, ["aspect"])


def series(spark, sf):
    return zonal.aspect_series(
        zonal.whole_and_sides(with_aspect(spark, sf), (75,), min_pixels=MIN_PIXELS)
    )


def aspect_series(spark, sf):
    return rounded(series(spark, sf).drop("diff"))


def aspect_diff(spark, sf):
    return rounded(series(spark, sf).select(*SCENE, "diff"))


def aspect_diff_both(spark, sf):
    return rounded(zonal.aspect_diff_both(with_aspect(spark, sf), min_pixels=MIN_PIXELS))


def summary(spark, sf):
    return zonal.series_summary(series(spark, sf), ["whole", "south", "north", "diff"])


def aspect_summary(spark, sf):
    return rounded(summary(spark, sf))


def aspect_verdict(spark, sf):
    out = zonal.aspect_verdict(summary(spark, sf), threshold=0.005)
    return rounded(out.select("aoi", "index_name", "diff_mean", "verdict"))


def strata_percentiles(spark, sf):
    return rounded(zonal.whole_and_sides(with_aspect(spark, sf), (50, 75, 90), min_pixels=MIN_PIXELS))


def by_elevation(spark, sf):
    cells = fx.cells_with(spark, sf, ["elevation"])
    return zonal.zonal_percentiles(
        zonal.by_elevation_class(cells), ["stratum"], (50, 75, 90), min_pixels=5, inclusive=False
    )


def elevation_percentiles(spark, sf):
    return rounded(by_elevation(spark, sf))


def elevation_diff(spark, sf):
    diffs = zonal.elevation_diff(by_elevation(spark, sf), (50, 75, 90))
    return rounded(zonal.series_summary(diffs, ["diff"], ["aoi", "index_name", "percentile"]))


def elevation_diff_series(spark, sf):
    return rounded(zonal.elevation_diff(by_elevation(spark, sf), (50, 75, 90)))


# -- cross-tabulations --------------------------------------------------------


def known_groups(spark, sf):
    return strata.forest_group_strata(fx.traits(spark, sf), MIN_CLASS_PX).select(F.col("forest_group").alias("code"))


def crosstab_counts(spark, sf):
    return rounded(crosstab.crosstab_counts(fx.traits(spark, sf), "forest_group"))


def _composition(spark, sf):
    return rounded(
        crosstab.composition(fx.traits(spark, sf), "forest_group", "forest_group", known_groups(spark, sf))
    )


def composition_pct(spark, sf):
    return _composition(spark, sf).filter(F.col("label") != "Other/unknown")


def other_unknown(spark, sf):
    return _composition(spark, sf).filter(F.col("label") == "Other/unknown")


DELTA = ["code", "label", "south_px", "north_px", "south_pct", "north_pct", "delta", "flag"]
SHARES = ["code", "label", "whole_px", "south_pct", "north_pct"]


def composition_delta(spark, sf):
    out = crosstab.composition_delta(fx.traits(spark, sf), "forest_group", "forest_group", known_groups(spark, sf), 1)
    return rounded(out.select(*DELTA))


def species_delta(spark, sf):
    return rounded(crosstab.species_delta(fx.traits(spark, sf), min_px=MIN_CLASS_PX, flag_above=1).select(*DELTA))


def subset_delta(spark, sf):
    return rounded(crosstab.subset_delta(fx.traits(spark, sf), flag_above=1).select(*DELTA))


def ecozone_by_aspect(spark, sf):
    return rounded(crosstab.ecozone_by_aspect(fx.traits(spark, sf)))


def ecozone_aspect_delta(spark, sf):
    return rounded(crosstab.ecozone_aspect_delta(fx.traits(spark, sf), 1).select(*DELTA))


def ecozone_by_forest(spark, sf):
    return rounded(crosstab.ecozone_by_forest(fx.traits(spark, sf), known_groups(spark, sf)))


def forest_by_ecozone(spark, sf):
    return rounded(crosstab.forest_by_ecozone(fx.traits(spark, sf), known_groups(spark, sf)))


def group_pct_by_aspect(spark, sf):
    return rounded(crosstab.group_pct_by_aspect(fx.traits(spark, sf)).select(*SHARES))


def topk_species_by_aspect(spark, sf):
    return rounded(crosstab.topk_species_by_aspect(fx.traits(spark, sf)).select(*SHARES))


def class_contrast(spark, sf):
    return rounded(crosstab.class_contrast(fx.traits(spark, sf)).select(*SHARES))


QUERIES = {
    f.__name__: f
    for f in (
        zonal_percentiles, zonal_percentiles_colocated, zonal_whole_aoi, peak_productivity, peak_productivity_landsat, peak_summary_wide, ecological_space,
        seasonal_curves, seasonal_scene_count, seasonal_band, seasonal_sync, drought_response,
        drought_scene_counts, unclassified_scenes, drought_space, drought_table_wide, year_class_summary,
        season_partition, moisture_amplitude, zonal_median_monthly, zonal_median_monthly_kept, season_mean, seasonal_amplitude,
        amplitude_trend, longterm_trend, trend_range, rolling_mean_5, trend_year_class, elevation_gradient,
        aspect_series, aspect_diff, aspect_diff_both, aspect_summary, aspect_verdict, strata_percentiles,
        elevation_percentiles, elevation_diff, elevation_diff_series,
        crosstab_counts, composition_pct, other_unknown, composition_delta, species_delta, subset_delta,
        ecozone_by_aspect, ecozone_aspect_delta, ecozone_by_forest, forest_by_ecozone, group_pct_by_aspect,
        topk_species_by_aspect, class_contrast,
    )
}
