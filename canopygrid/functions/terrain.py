"""Terrain classes and slope angles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopygrid.functions.bands import nan_to_null


def slope_degrees(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def aspect_degrees(
    dx: Column, dy: Column, slope: Column, *, flat_below: float = 2.0, convention: str = "upslope"
) -> Column:
    """Compass bearing of the slope, null on nearly flat ground.

    ``dy`` grows southward with the row number. "upslope" gives the bearing
    towards higher ground, "downslope" the direction the slope faces.
    """
    if convention not in ("upslope", "downslope"):
        raise ValueError(f"unknown convention {convention!r}")
    bearing = F.lit(90.0) - F.degrees(F.atan2(-dy, dx))
    bearing = F.when(bearing < 0, bearing + 360.0).otherwise(bearing)
    if convention == "downslope":
        bearing = (bearing + 180.0) % 360.0
    return F.when(slope >= flat_below, bearing)


def aspect_side(aspect: Column, slope: Column | None = None, min_slope: float | None = None) -> Column:
    """'south' in [135, 225], 'north' from 315 through 45, else 'neither', as without an aspect (null or NaN)."""
    aspect = nan_to_null(aspect)
    steep = F.lit(True) if min_slope is None else F.coalesce(nan_to_null(slope) >= min_slope, F.lit(False))
    return (
        F.when(steep & aspect.between(135, 225), F.lit("south"))
        .when(steep & ((aspect >= 315) | (aspect <= 45)), F.lit("north"))
        .otherwise(F.lit("neither"))
    )


def steep(slope: Column, above: float = 15.0) -> Column:
    """False without a slope."""
    return F.coalesce(nan_to_null(slope) > above, F.lit(False))


def elevation_class(
    elevation: Column, low_below: float = 175.0, high_from: float = 300.0, *, positive_low: bool = False
) -> Column:
    """'low', 'mid' or 'high'; null without elevation.

    ``positive_low`` keeps only ground above zero in the low class.
    """
    elevation = nan_to_null(elevation)
    low = elevation < low_below
    if positive_low:
        low = low & (elevation > 0)
    return (
        F.when(low, F.lit("low"))
        .when((elevation >= low_below) & (elevation < high_from), F.lit("mid"))
        .when(elevation >= high_from, F.lit("high"))
    )


def elevation_band(elevation: Column, width: int = 200) -> Column:
    """Lower bound of the uniform band a cell lies in; null without elevation."""
    return (F.floor(nan_to_null(elevation) / width) * width).cast("int")
