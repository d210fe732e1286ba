"""Strata of cells: slope sides, elevation bands, forest groups, ecozones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.functions import labels, terrain
from canopygrid.model import ECOZONES

# Area of a 10 m cell.
CELL_KM2 = 10 * 10 / 1e6


def cell_km2(resolution: float = 10.0) -> float:
    return resolution * resolution / 1e6


def terrain_masks() -> dict[str, Column]:
    """Mask tests on aspect, slope, elevation and ecozone columns."""
    side = terrain.aspect_side(F.col("aspect"))
    elevation = terrain.elevation_class(F.col("elevation"))
    masks = {
        "south_facing": side == "south",
        "north_facing": side == "north",
        "steep_slopes": terrain.steep(F.col("slope")),
        "elev_low": elevation == "low",
        "elev_mid": elevation == "mid",
        "elev_high": elevation == "high",
    }
    masks.update({f"ecozone_{code}": F.col("ecozone") == code for code in ECOZONES})
    return masks


def mask_coverage(cells: DataFrame, masks: Mapping[str, Column], km2: float = CELL_KM2) -> DataFrame:
    """Cell count and area per mask, all masks in one pass."""
    counted = cells.agg(*[F.count_if(test).alias(name) for name, test in masks.items()])
    return counted.unpivot([], list(masks), "mask", "px").withColumn("km2", F.col("px") * km2)


def mask_overlap_audit(cells: DataFrame, min_slope: float | None = None) -> DataFrame:
    """South and north counts, their overlap, and aspect and slope range of each."""
    aspect, slope = B.nan_to_null(F.col("aspect")), B.nan_to_null(F.col("slope"))
    steep_enough = F.lit(True) if min_slope is None else slope >= min_slope
    south = aspect.between(135, 225) & steep_enough
    north = ((aspect >= 315) | (aspect <= 45)) & steep_enough
    out = [F.count_if(south & north).alias("overlap_px")]
    for name, test in (("south", south), ("north", north)):
        a = F.when(test & B.finite(aspect), aspect)
        s = F.when(test & B.finite(slope), slope)
        out += [
            F.count_if(test).alias(f"{name}_px"),
            F.min(a).alias(f"{name}_aspect_min"),
            F.max(a).alias(f"{name}_aspect_max"),
            F.min(s).alias(f"{name}_slope_min"),
            F.max(s).alias(f"{name}_slope_max"),
            F.avg(s).alias(f"{name}_slope_mean"),
        ]
    return cells.agg(*out)


def elevation_bands(
    cells: DataFrame, width: int = 200, min_px: int = 5000, keys: Sequence[str] = ()
) -> DataFrame:
    """Uniform bands with enough cells: lo, hi, mid, n_px.

    Bands end below the highest elevation rounded up to the width, so a top
    elevation that is an exact multiple of the width lies in no band.
    """
    keys = list(keys)
    counts = (
        cells.filter(B.finite(F.col("elevation")))
        .groupBy(*keys, terrain.elevation_band(F.col("elevation"), width).alias("lo"))
        .agg(F.count("*").alias("n_px"), F.max("elevation").alias("__top"))
    )
    # A handful of rows per key: one per band.
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    end = F.ceil(F.max("__top").over(every) / width) * width
    return (
        counts.withColumn("__end", end)
        .filter((F.col("lo") < F.col("__end")) & (F.col("n_px") >= min_px))
        .select(*keys, "lo", (F.col("lo") + width).alias("hi"), (F.col("lo") + width / 2).alias("mid"), "n_px")
    )


def class_counts(cells: DataFrame, code: str) -> DataFrame:
    """Cells per class code; masked (null) cells are left out."""
    return cells.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("px"))


def forest_group_strata(cells: DataFrame, min_px: int = 10000, km2: float = CELL_KM2) -> DataFrame:
    """Forest groups with enough cells; non-forest is no group."""
    return labels.with_label(
        class_counts(cells, "forest_group").filter((F.col("forest_group") != 0) & (F.col("px") >= min_px)),
        "forest_group",
        "forest_group",
    ).withColumn("km2", F.col("px") * km2)


def skipped_groups(cells: DataFrame, min_px: int = 10000, km2: float = CELL_KM2) -> DataFrame:
    """Forest groups with too few cells for a stratum."""
    return labels.with_label(
        class_counts(cells, "forest_group").filter((F.col("forest_group") != 0) & (F.col("px") < min_px)),
        "forest_group",
        "forest_group",
    ).withColumn("km2", F.col("px") * km2)


def in_strata(cells: DataFrame, strata: DataFrame, code: str) -> DataFrame:
    """Cells whose code is one of the strata."""
    return cells.join(strata.select(code), code, "left_semi")


def ecozone_strata(cells: DataFrame) -> DataFrame:
    """Ecozones that occur, with their cell counts."""
    return labels.with_label(
        class_counts(cells, "ecozone").filter(F.col("ecozone").isin(*ECOZONES)), "ecozone", "ecozone"
    )


def class_histogram(cells: DataFrame, code: str, kind: str, km2: float = CELL_KM2) -> DataFrame:
    """Every code with count, area, share of all cells, label and whether it is known."""
    every = Window.partitionBy(F.lit(0))  # one row per code
    counts = class_counts(cells, code).withColumn("__all", F.sum("px").over(every))
    return (
        labels.with_label(counts, kind, code)
        .withColumn("km2", F.col("px") * km2)
        .withColumn("pct", F.col("px") * 100.0 / F.col("__all"))
        .withColumn("known", labels.is_known(kind, F.col(code)))
        .drop("__all")
    )


def class_topk(cells: DataFrame, code: str, kind: str, k: int = 15, km2: float = CELL_KM2) -> DataFrame:
    """The ``k`` most frequent codes."""
    return (
        class_histogram(cells, code, kind, km2).orderBy(F.col("px").desc(), F.col(code)).limit(k)
    )
