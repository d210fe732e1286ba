"""Zonal percentiles per scene and their means over scenes.

Two levels throughout: percentiles of the cells of one (scene, stratum), then
plain means over scenes by month, season, year, class or band.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions import terrain
from canopygrid.functions.quantiles import grouped_percentiles, percentile_name
from canopygrid.model import ECOZONES, INDICES
from canopygrid.operators import strata as S

LAYER = ("aoi", "index_name")
SCENE = ("aoi", "index_name", "scene_id", "year", "month")
CELL = ("row", "col")

MONTHS = tuple(range(1, 13))
GROWING = (4, 5, 6, 7, 8, 9)
DORMANT = (11, 12, 1, 2, 3)
CLASSES = ("wet", "neutral", "dry")


def framed(means: DataFrame, keys: Sequence[str], **dims: Sequence) -> DataFrame:
    """All combinations of the fixed values ``dims`` within each of ``keys``, missing ones null and n_scenes 0.

    The keys, such as areas and indices, are those of the rows. A group holds
    at most one row per combination, so it is opened up in place.
    """
    others = [c for c in means.columns if c not in (*keys, *dims)]
    row = F.struct(F.struct(*dims).alias("key"), F.struct(*others).alias("value"))
    out = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(row)).alias("__rows"))
    for name, values in dims.items():
        kind = means.schema[name].dataType
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    value = F.try_element_at("__rows", F.struct(*dims))
    columns = [value[c].alias(c) if c != "n_scenes" else F.coalesce(value[c], F.lit(0)).alias(c) for c in others]
    return out.select(*keys, *dims, *columns)


def with_traits(
    cells: DataFrame, traits: DataFrame, columns: Sequence[str], cell: Sequence[str] | None = None
) -> DataFrame:
    """Stratum columns of each cell, by position, and by area where each has traits of its own.

    Traits without an aoi column are of one grid that all areas share. A plain
    equi-join: Spark broadcasts a trait table it measures as small and
    otherwise sorts and merges, splitting hot cells.
    """
    cell = list(cell or (*_area(traits), *CELL))
    if missing := set(cell) - set(cells.columns):
        raise ValueError(f"cells lack {sorted(missing)} to tell their traits by")
    return cells.join(traits.select(*cell, *columns), cell)


def in_ecozones(cells: DataFrame, traits: DataFrame, cell: Sequence[str] | None = None) -> DataFrame:
    zones = traits.filter(F.col("ecozone").isin(*ECOZONES))
    return with_traits(cells, zones, ["ecozone"], cell)


def zonal_percentiles(
    cells: DataFrame,
    stratum: Sequence[str] = ("ecozone",),
    percentiles: Sequence[float] = (95, 99, 100),
    *,
    min_pixels: int = 100,
    inclusive: bool = True,
    method: str = "binned",
    scene: Sequence[str] = SCENE,
) -> DataFrame:
    """Percentiles of the valid cells of every scene and stratum."""
    return grouped_percentiles(
        cells,
        [*scene, *stratum],
        "value",
        percentiles,
        min_count=min_pixels,
        inclusive=inclusive,
        method=method,
    )


# Strata of slope sides: the parts each is made of, null for every cell.
SIDES = {"whole": None, "south": ("south",), "north": ("north",)}


def strata_percentiles(
    cells: DataFrame,
    part: str,
    strata: Mapping[str, Sequence[str] | None],
    percentiles: Sequence[float],
    *,
    min_pixels: int = 100,
    inclusive: bool = False,
    method: str = "binned",
    scene: Sequence[str] = SCENE,
) -> DataFrame:
    """Percentiles of strata that may contain each other, such as a whole area and parts of it.

    ``part`` is the finest class of a cell; counts of the parts add up to
    those of a stratum, so that a cell is read and moved once for all of them.
    The whole area needs any cell, other strata more than ``min_pixels`` (or as
    many, when ``inclusive``).
    """
    found = grouped_percentiles(
        cells, scene, "value", percentiles, min_count=0, inclusive=False, method=method, part=part, strata=strata
    )
    everything = [name for name, parts in strata.items() if parts is None]
    enough = F.col("n") >= min_pixels if inclusive else F.col("n") > min_pixels
    return found.filter(F.col("stratum").isin(*everything) | enough)


def whole_and_sides(
    cells: DataFrame, percentiles: Sequence[float], *, min_pixels: int = 100, method: str = "binned"
) -> DataFrame:
    """Percentiles of the whole area (any cell) and of each side (more than ``min_pixels``); needs an aspect column."""
    sided = cells.withColumn("side", terrain.aspect_side(F.col("aspect"))).drop("aspect")
    return strata_percentiles(sided, "side", SIDES, percentiles, min_pixels=min_pixels, method=method)


def zonal_whole_aoi(cells: DataFrame, percentiles: Sequence[float] = (75,), *, method: str = "binned") -> DataFrame:
    return zonal_percentiles(cells, [], percentiles, min_pixels=0, inclusive=False, method=method)


def mean_over_scenes(scenes: DataFrame, keys: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """Mean of the scene percentiles and number of contributing scenes."""
    names = [percentile_name(p) for p in percentiles]
    return scenes.groupBy(*keys).agg(
        F.count("*").alias("n_scenes"), *[F.avg(name).alias(name) for name in names]
    )


# -- peak productivity --------------------------------------------------------


def _area(df: DataFrame) -> list[str]:
    """Traits of several areas carry an aoi column and are matched on it."""
    return ["aoi"] if "aoi" in df.columns else []


def ecozone_pixels(traits: DataFrame) -> DataFrame:
    return traits.filter(F.col("ecozone").isin(*ECOZONES)).groupBy(*_area(traits), "ecozone").agg(
        F.count("*").alias("pixel_count")
    )


def peak_productivity(scenes: DataFrame, traits: DataFrame, percentiles: Sequence[float] = (95, 99, 100)) -> DataFrame:
    """Mean scene percentiles per area, index and ecozone, with the zone's size.

    Zones that the traits have and no scene covers are null with 0 scenes.
    """
    means = mean_over_scenes(scenes, [*LAYER, "ecozone"], percentiles)
    return framed(means, LAYER, ecozone=ECOZONES).join(ecozone_pixels(traits), [*_area(traits), "ecozone"])


def summary_wide(
    tidy: DataFrame, keys: Sequence[str], columns: Sequence[str], indices: Sequence[str] = INDICES
) -> DataFrame:
    """One row per ``keys`` and a column per index and statistic, to 6 decimals."""
    one = lambda c: F.first(F.round(F.col(c), 6) if c != "n_scenes" else F.col(c)).alias(c)
    return tidy.groupBy(*keys).pivot("index_name", list(indices)).agg(*[one(c) for c in columns])


def index_pairs(tidy: DataFrame, keys: Sequence[str], value: str = "p95") -> DataFrame:
    """NDVI and NDMI side by side; keys lacking either are dropped."""
    return (
        tidy.groupBy(*keys)
        .pivot("index_name", ["NDVI", "NDMI"])
        .agg(F.first(value))
        .select(*keys, F.col("NDVI").alias("ndvi"), F.col("NDMI").alias("ndmi"))
        .filter("ndvi IS NOT NULL AND ndmi IS NOT NULL")
    )


# -- seasons ------------------------------------------------------------------


def seasonal_curves(
    scenes: DataFrame,
    percentiles: Sequence[float] = (95, 100),
) -> DataFrame:
    """Mean scene percentiles per calendar month and ecozone, years pooled; empty months are null.

    Every area and index of the scenes is listed.
    """
    means = mean_over_scenes(scenes, [*LAYER, "month", "ecozone"], percentiles)
    return framed(means, LAYER, month=MONTHS, ecozone=ECOZONES)


def seasonal_scene_count(curves: DataFrame) -> DataFrame:
    """Scenes behind a month: the most any ecozone had."""
    return curves.groupBy(*LAYER, "month").agg(F.max("n_scenes").alias("n_scenes"))


def seasonal_band(curves: DataFrame, low: str = "p95", high: str = "p100") -> DataFrame:
    return curves.filter(F.col(low).isNotNull() & F.col(high).isNotNull())


def season_of(month: Column) -> Column:
    """'growing' April-September, 'dormant' November-March, 'excluded' October."""
    return (
        F.when(month.isin(*GROWING), F.lit("growing"))
        .when(month.isin(*DORMANT), F.lit("dormant"))
        .otherwise(F.lit("excluded"))
    )


def season_partition(scenes: DataFrame) -> DataFrame:
    """Scenes per area and season."""
    return scenes.groupBy("aoi", season_of(F.col("month")).alias("season")).agg(
        F.count("*").alias("n_scenes")
    )


def moisture_amplitude(scene_p95: DataFrame, scenes: DataFrame) -> DataFrame:
    """Growing minus dormant mean p95 per ecozone, all zones listed; null when a season has none.

    Scene counts cover all scenes of a season, contributing or not.
    """
    season = season_of(F.col("month"))
    means = framed(scene_p95.groupBy("aoi", "ecozone").agg(
        F.avg(F.when(season == "growing", F.col("p95"))).alias("growing_p95"),
        F.avg(F.when(season == "dormant", F.col("p95"))).alias("dormant_p95"),
    ), ["aoi"], ecozone=ECOZONES)
    counts = scenes.groupBy("aoi").agg(
        F.count_if(season == "growing").alias("growing_scenes"),
        F.count_if(season == "dormant").alias("dormant_scenes"),
    )
    return means.join(counts, "aoi").withColumn(
        "amplitude", F.col("growing_p95") - F.col("dormant_p95")
    )


# -- moisture classes of years ------------------------------------------------


def with_year_class(scenes: DataFrame, year_class: DataFrame) -> DataFrame:
    """Scenes of classified years."""
    return scenes.join(year_class.select("aoi", "year", "classification"), ["aoi", "year"])


def drought_response(
    scenes: DataFrame,
    year_class: DataFrame,
    percentiles: Sequence[float] = (95, 99, 100),
) -> DataFrame:
    """Mean scene percentiles per moisture class and ecozone; missing combinations are null.

    Every area and index with a classified scene is listed.
    """
    keys = [*LAYER, "classification", "ecozone"]
    means = mean_over_scenes(with_year_class(scenes, year_class), keys, percentiles)
    return framed(means, LAYER, classification=CLASSES, ecozone=ECOZONES)


def drought_scene_counts(scenes: DataFrame, year_class: DataFrame) -> DataFrame:
    """All scenes of a class, and its years, whether or not a stratum qualified."""
    per_year = with_year_class(scenes, year_class).groupBy("aoi", "classification", "year").agg(
        F.count("*").alias("n")
    )
    return per_year.groupBy("aoi", "classification").agg(
        F.sum("n").alias("n_scenes"),
        # One entry a year.
        F.array_join(F.array_sort(F.collect_list("year")).cast("array<string>"), ",").alias("years"),
    )


def unclassified_scenes(scenes: DataFrame, year_class: DataFrame) -> DataFrame:
    """Scenes per area whose year has no class."""
    return (
        scenes.join(year_class.select("aoi", "year"), ["aoi", "year"], "left_anti")
        .groupBy("aoi")
        .agg(F.count("*").alias("n_scenes"))
    )


def drought_space(response: DataFrame) -> DataFrame:
    """(NDVI, NDMI) points per area and ecozone in the order wet, neutral, dry."""
    order = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("classification"))
    return index_pairs(response, ["aoi", "ecozone", "classification"]).withColumn(
        "step", order.cast("int")
    )


# -- elevation ----------------------------------------------------------------


def in_elevation_bands(
    cells: DataFrame, traits: DataFrame, *, width: int = 200, min_band_px: int = 5000, cell: Sequence[str] | None = None
) -> DataFrame:
    """Cells of the bands with enough ground, with the band's lower end ``lo``; raw bands go in before rows triple."""
    band = [*_area(traits), "lo"]
    bands = S.elevation_bands(traits, width, min_band_px, _area(traits))
    banded = traits.withColumn("lo", terrain.elevation_band(F.col("elevation"), width))
    return with_traits(cells, banded.join(bands.select(*band), band, "left_semi"), ["lo"], cell)


def elevation_gradient(
    banded: DataFrame,
    traits: DataFrame,
    *,
    width: int = 200,
    min_band_px: int = 5000,
    min_pixels: int = 200,
    method: str = "binned",
) -> DataFrame:
    """Mean scene p95 per elevation band: one row per area and band, a column per index.

    ``banded`` are index cells with the column ``lo`` of ``in_elevation_bands``
    for the same width and ``min_band_px``. Bands with enough ground are
    listed for every area with scenes, null where none qualifies.
    """
    bands = S.elevation_bands(traits, width, min_band_px, _area(traits))
    scenes = zonal_percentiles(banded, ["lo"], (95,), min_pixels=min_pixels, method=method)
    means = mean_over_scenes(scenes, [*LAYER, "lo"], (95,))
    wide = means.groupBy("aoi", "lo").pivot("index_name", list(INDICES)).agg(F.first("p95"))
    values = [F.col(i).alias(f"{i}_p95") for i in INDICES]
    if "aoi" in bands.columns:
        return bands.join(wide, ["aoi", "lo"], "left").select("aoi", "lo", "hi", "mid", "n_px", *values)
    # A row per area with what it has by band, beside a row with the list of bands, which is spread to all of them.
    entry = F.struct(F.col("lo"), F.struct(*INDICES))
    areas = wide.groupBy("aoi").agg(F.map_from_entries(F.collect_list(entry)).alias("__found"), F.lit(True).alias("__area"))
    listed = bands.agg(F.collect_list(F.struct(*bands.columns)).alias("__bands"))
    every = F.first("__bands", ignorenulls=True).over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    opened = (
        areas.unionByName(listed, allowMissingColumns=True)
        .withColumn("__bands", every)
        .filter("__area")
        .select("aoi", "__found", F.inline("__bands"))
    )
    own = F.try_element_at("__found", F.col("lo"))
    return opened.select("aoi", "lo", "hi", "mid", "n_px", *[own[i].alias(f"{i}_p95") for i in INDICES])


def by_elevation_class(cells: DataFrame) -> DataFrame:
    """Cells by low, mid and high ground; needs an elevation column."""
    return (
        cells.withColumn("stratum", terrain.elevation_class(F.col("elevation"), positive_low=True))
        .filter(F.col("stratum").isNotNull())
        .drop("elevation")
    )


# -- contrasts between strata -------------------------------------------------


def strata_wide(scene_p: DataFrame, strata: Sequence[str], value: str, scene: Sequence[str] = SCENE) -> DataFrame:
    """One row per scene and a column per stratum."""
    return scene_p.groupBy(*scene).pivot("stratum", list(strata)).agg(F.first(value))


def aspect_series(scene_p75: DataFrame) -> DataFrame:
    """Whole, south and north p75 of each scene and south minus north."""
    return strata_wide(scene_p75, ["whole", "south", "north"], "p75").withColumn(
        "diff", F.col("south") - F.col("north")
    )


def aspect_diff_both(cells: DataFrame, *, min_pixels: int = 100, method: str = "binned") -> DataFrame:
    """South minus north p75 per scene, null unless both sides have ``min_pixels`` or more."""
    side = terrain.aspect_side(F.col("aspect"))
    sided = cells.withColumn("stratum", side).drop("aspect").filter(F.col("stratum").isin("south", "north"))
    sides = zonal_percentiles(sided, ["stratum"], (75,), min_pixels=min_pixels, method=method)
    return strata_wide(sides, ["south", "north"], "p75").select(
        *SCENE, (F.col("south") - F.col("north")).alias("diff")
    )


def series_summary(series: DataFrame, columns: Sequence[str], keys: Sequence[str] = LAYER) -> DataFrame:
    """Mean and population deviation of each column over scenes, nulls left out."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return series.groupBy(*keys).agg(*stats)


def aspect_verdict(summary: DataFrame, threshold: float = 0.05) -> DataFrame:
    d = F.col("diff_mean")
    verdict = F.when(d < -threshold, "LOWER").when(d > threshold, "HIGHER").otherwise("NONE")
    return summary.withColumn("verdict", F.when(d.isNotNull(), verdict))


def percentiles_long(scene_p: DataFrame, percentiles: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """A row per percentile instead of a column."""
    names = [percentile_name(p) for p in percentiles]
    return scene_p.unpivot(list(keys), names, "percentile", "value")


def elevation_diff(scene_p: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """High minus low ground per scene and percentile."""
    long = percentiles_long(scene_p, percentiles, [*SCENE, "stratum"])
    return (
        strata_wide(long, ["low", "high"], "value", [*SCENE, "percentile"])
        .withColumn("diff", F.col("high") - F.col("low"))
        .filter(F.col("diff").isNotNull())
    )


def season_means(monthly: DataFrame, months: Sequence[int], name: str, *, year_shift: int = 0) -> DataFrame:
    """Mean of the monthly medians of some months; ``year_shift`` moves them to another year."""
    return (
        monthly.filter(F.col("month").isin(*months))
        .groupBy(*LAYER, (F.col("year") + year_shift).alias("year"), "ecozone")
        .agg(F.avg("p50").alias(name))
    )


def zonal_median_monthly(
    monthly_max: DataFrame,
    traits: DataFrame,
    *,
    min_pixels: int = 100,
    cell: Sequence[str] | None = None,
    method: str = "binned",
) -> DataFrame:
    """Median of each monthly composite per ecozone, of each area's own zones where traits have an aoi column."""
    return zonal_percentiles(
        in_ecozones(monthly_max, traits, cell),
        ["ecozone"],
        (50,),
        min_pixels=min_pixels,
        method=method,
        scene=[*LAYER, "year", "month"],
    )


def seasonal_amplitude(medians: DataFrame, layers: DataFrame) -> DataFrame:
    """Summer minus winter median per ecozone and year.

    Winter is the mean of last December and of the January-February mean, or
    the one of them that exists. ``layers`` lists (aoi, index_name, year) to
    report; values without data are null.
    """
    keys = [*LAYER, "year", "ecozone"]
    frame = layers.select(*LAYER, "year").withColumn(
        "ecozone", F.explode(F.array(*[F.lit(z) for z in ECOZONES]))
    )
    # One pass and one shuffle: a December counts for the year after.
    season = (
        F.when(F.col("month").isin(6, 7, 8), F.lit("summer"))
        .when(F.col("month") == 12, F.lit("december"))
        .when(F.col("month").isin(1, 2), F.lit("start"))
    )
    mean_of = lambda s: F.avg(F.when(F.col("season") == s, F.col("p50"))).alias(s)
    seasons = (
        medians.withColumn("season", season)
        .filter(F.col("season").isNotNull())
        .withColumn("year", F.when(F.col("month") == 12, F.col("year") + 1).otherwise(F.col("year")))
        .groupBy(*keys)
        .agg(mean_of("summer"), mean_of("december"), mean_of("start"))
    )
    winter = F.coalesce((F.col("december") + F.col("start")) / 2, F.col("december"), F.col("start"))
    return (
        frame.join(seasons, keys, "left")
        .withColumn("winter", winter)
        .withColumn("amplitude", F.col("summer") - F.col("winter"))
        .select(*keys, "summer", "winter", "amplitude")
    )
