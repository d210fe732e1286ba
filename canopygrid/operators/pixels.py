"""Raw bands to masked index cells, and what share of a scene is usable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.model import INDICES, Sensor


# Cells of a tile counted in one bitmap, high and wide: the 32,768 bits that Spark's bitmaps have.
BITMAP = (128, 256)


def usable(
    sensor: Sensor, indices: Sequence[str] = INDICES, *, in_aoi: Column | None = None
) -> Column:
    """Clear of cloud and snow, every band of ``indices`` valid, inside the area."""
    tests = [B.clear_of_cloud(sensor, F.col(sensor.quality))]
    tests += [B.valid_band(sensor, F.col(band)) for band in B.bands_for(indices)]
    if in_aoi is not None:
        tests.append(in_aoi)
    return B.all_of(tests)


def _index_values(sensor: Sensor, indices: Sequence[str], offset: float | None) -> dict[str, Column]:
    scaled = {
        band: B.reflectance(sensor, F.col(band), offset) for band in B.bands_for(indices)
    }
    return {name: B.index_expression(name, scaled) for name in indices}


def with_indices(
    df: DataFrame,
    sensor: Sensor,
    indices: Sequence[str] = INDICES,
    *,
    in_aoi: Column | None = None,
    validity_scope: str = "requested",
    offset: float | None = None,
) -> DataFrame:
    """One column per index, null where the cell is not usable.

    With ``validity_scope`` "requested" a cell needs all bands of all requested
    indices; with "own_bands" only those the index itself reads.
    """
    values = _index_values(sensor, indices, offset)
    scope = {"requested": lambda _: indices, "own_bands": lambda name: [name]}[validity_scope]
    return df.withColumns(
        {
            name: F.when(usable(sensor, scope(name), in_aoi=in_aoi), value)
            for name, value in values.items()
        }
    )


def index_cells(
    df: DataFrame,
    sensor: Sensor,
    keys: Sequence[str],
    indices: Sequence[str] = INDICES,
    *,
    in_aoi: Column | None = None,
    validity_scope: str = "requested",
    offset: float | None = None,
) -> DataFrame:
    """Long form: ``keys``, index_name, value; cells without a value are absent.

    Rows triple here: join strata and take maxima before.
    """
    wide = wide_cells(df, sensor, keys, indices, in_aoi=in_aoi, validity_scope=validity_scope, offset=offset)
    return to_long(wide, keys, indices)


def to_long(wide: DataFrame, keys: Sequence[str], indices: Sequence[str] = INDICES) -> DataFrame:
    entries = [F.struct(F.lit(name).alias("index_name"), F.col(name).alias("value")) for name in indices]
    return wide.select(*keys, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def wide_cells(
    df: DataFrame,
    sensor: Sensor,
    keys: Sequence[str],
    indices: Sequence[str] = INDICES,
    *,
    in_aoi: Column | None = None,
    validity_scope: str = "requested",
    offset: float | None = None,
) -> DataFrame:
    """``keys`` and a column per index.

    Where all indices share one mask it is a plain filter on the bands, ahead
    of the arithmetic.
    """
    if validity_scope == "requested":
        kept = df.filter(usable(sensor, indices, in_aoi=in_aoi))
        wide = kept.withColumns(_index_values(sensor, indices, offset))
    else:
        wide = with_indices(
            df, sensor, indices, in_aoi=in_aoi, validity_scope=validity_scope, offset=offset
        )
    return wide.select(*keys, *indices)


def class_fill_outside(df: DataFrame, sensor: Sensor, in_aoi: str = "in_aoi") -> DataFrame:
    """Quality class as stored: 0 outside the area."""
    q = sensor.quality
    return df.withColumn(q, F.when(F.col(in_aoi), F.col(q)).otherwise(F.lit(0)))


def scene_fractions(
    df: DataFrame,
    areas: DataFrame,
    sensor: Sensor,
    scene: Sequence[str] = ("aoi", "scene_id"),
    indices: Sequence[str] = INDICES,
    in_aoi: str = "in_aoi",
    cell: Sequence[str] = ("row", "col"),
) -> DataFrame:
    """Snow and clear share of the whole area's cells per scene, to 4 decimals.

    ``areas`` (aoi, area_px) has each area's number of cells, observed or not.
    A cell counts once however often a scene observes it. Snow is counted
    before masking. An area without cells gives null.

    Cells are counted in bitmaps, one per scene and tile of ``BITMAP`` cells:
    what tasks have seen of a tile is two bitmaps of 4 KB, which are united
    after the shuffle; no row is shuffled for a cell.
    """
    inside = F.col(in_aoi)
    snow = inside & B.is_snow(sensor, F.col(sensor.quality))
    clear = usable(sensor, indices, in_aoi=inside)
    (row, col), (height, width) = cell, BITMAP
    place = (F.pmod(F.col(row), F.lit(height)) * width + F.pmod(F.col(col), F.lit(width))).cast("long")
    tile = [F.floor(F.col(row) / height).alias("__tr"), F.floor(F.col(col) / width).alias("__tc")]
    seen = lambda test: F.bitmap_construct_agg(F.when(test, place))
    # Rows are sorted for the bitmaps: by a number first, which compares faster than names.
    order = F.xxhash64(*scene, *tile).alias("__order")
    tiles = df.groupBy(order, *scene, *tile).agg(seen(snow).alias("snow"), seen(clear).alias("clear"))
    return (
        tiles.groupBy(*scene)
        .agg(F.sum(F.bitmap_count("snow")).alias("snow_px"), F.sum(F.bitmap_count("clear")).alias("clear_px"))
        .join(areas, "aoi", "left")
        .withColumn("area_px", F.coalesce("area_px", F.lit(0).cast("bigint")))
        .withColumn("snow_frac", F.round(F.try_divide("snow_px", "area_px"), 4))
        .withColumn(sensor.fraction_column, F.round(F.try_divide("clear_px", "area_px"), 4))
    )
