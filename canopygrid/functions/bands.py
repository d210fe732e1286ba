"""Band algebra and quality tests as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopygrid.model import INDEX_BANDS, Sensor


def all_of(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(lambda a, b: a & b, tests[1:], tests[0])


def finite(value: Column) -> Column:
    """True for real numbers; null, NaN and the infinities are not."""
    return (
        value.isNotNull()
        & ~F.isnan(value)
        & (F.abs(value) != F.lit(float("inf")))
    )


def nan_to_null(value: Column) -> Column:
    """Missing cells are null from here on: max, avg and percentile skip them."""
    return F.when(~F.isnan(value), value)


def reflectance(sensor: Sensor, dn: Column, offset: float | None = None) -> Column:
    """Raw number to reflectance; values outside the sensor's range become null.

    ``offset`` replaces the sensor's own additive term, e.g. for a later
    processing baseline.
    """
    shift = sensor.offset if offset is None else offset
    # A scale of 1/n is written as a division to keep the last digit exact.
    inverse = round(1 / sensor.scale)
    scaled = dn / F.lit(float(inverse)) if 1 / inverse == sensor.scale else dn * F.lit(sensor.scale)
    if shift:
        scaled = scaled + F.lit(shift)
    if sensor.reflectance is None:
        return scaled
    low, high = sensor.reflectance
    return F.when((scaled >= low) & (scaled <= high), scaled)


def valid_band(sensor: Sensor, dn: Column) -> Column:
    """Is one raw band value usable? Kept bare, so that as a filter it reaches the scan."""
    if sensor.dn_open is not None:
        low, high = sensor.dn_open
        return (dn > low) & (dn < high)
    return finite(reflectance(sensor, dn))


def clear_of_cloud(sensor: Sensor, quality: Column) -> Column:
    """False where the class or a flag bit marks cloud or snow."""
    if sensor.dropped_classes:
        return ~quality.isin(*sensor.dropped_classes)
    bits = sum(1 << bit for bit in sensor.dropped_bits)
    return quality.bitwiseAND(F.lit(bits)) == 0


def is_snow(sensor: Sensor, quality: Column) -> Column:
    if sensor.snow_class is not None:
        return quality == sensor.snow_class
    return quality.bitwiseAND(F.lit(1 << sensor.snow_bit)) != 0


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def ndmi(nir: Column, swir: Column) -> Column:
    return F.try_divide(nir - swir, nir + swir)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    """Clipped to [-1, 1]; a zero denominator clips by the sign, 0/0 and any missing band are null."""
    top = F.lit(2.5) * (nir - red)
    below = nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0)
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(top, below)))
    return F.when(below != 0, clipped).when((below == 0) & (top != 0), F.signum(top))


def bands_for(indices: Iterable[str]) -> list[str]:
    """Bands the indices read together, in name order."""
    unknown = [name for name in indices if name not in INDEX_BANDS]
    if unknown:
        raise ValueError(f"unknown index {unknown[0]!r}; valid: {sorted(INDEX_BANDS)}")
    return sorted({band for name in indices for band in INDEX_BANDS[name]})


def index_expression(name: str, band: dict[str, Column]) -> Column:
    bands_for([name])
    if name == "NDVI":
        return ndvi(band["nir"], band["red"])
    if name == "NDMI":
        return ndmi(band["nir"], band["swir"])
    return evi(band["nir"], band["red"], band["blue"])
