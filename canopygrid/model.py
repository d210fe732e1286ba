"""Table schemas, sensors and grids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Side of a storage tile in cells; tiles cluster the cell store.
TILE = 256

INDICES = ("NDVI", "NDMI", "EVI")
AOIS = ("north", "south")
ECOZONES = (1, 2, 3)

# Bands every index reads.
INDEX_BANDS = {
    "NDVI": ("red", "nir"),
    "NDMI": ("nir", "swir"),
    "EVI": ("blue", "red", "nir"),
}


@dataclass(frozen=True)
class Sensor:
    """How raw numbers of one sensor become reflectance and which are dropped.

    ``dn_open`` is the open interval raw values must lie in; ``reflectance``
    the closed interval scaled values must lie in, others become null.
    """

    name: str
    resolution: float
    scale: float
    offset: float
    dn_open: tuple[float, float] | None
    reflectance: tuple[float, float] | None
    quality: str
    dropped_classes: tuple[int, ...] = ()
    dropped_bits: tuple[int, ...] = ()
    snow_class: int | None = None
    snow_bit: int | None = None
    year_floor: int = 2017
    fraction_column: str = "clear_frac"


SENTINEL2 = Sensor(
    name="sentinel-2",
    resolution=10.0,
    scale=1 / 10000.0,
    offset=0.0,
    dn_open=(0.0, 10000.0),
    reflectance=None,
    quality="scl",
    dropped_classes=(8, 9, 10, 11),
    snow_class=11,
    year_floor=2017,
)

LANDSAT = Sensor(
    name="landsat",
    resolution=30.0,
    scale=0.0000275,
    offset=-0.2,
    dn_open=None,
    reflectance=(0.0, 1.0),
    quality="qa",
    dropped_bits=(1, 2, 3, 5),
    snow_bit=5,
    year_floor=1984,
    fraction_column="valid_frac",
)


@dataclass(frozen=True)
class Grid:
    """Regular north-up grid; row 0 is the northern edge.

    ``height`` None leaves the number of rows open.
    """

    x_min: float
    y_max: float
    width: int
    height: int | None
    dx: float
    dy: float


# One scene of a manifest. Which keys are present differs by sensor and by
# how the entry came about; absent keys read as null.
MANIFEST_ENTRY = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("cloud_cover", T.DoubleType()),
        T.StructField("clear_frac", T.DoubleType()),
        T.StructField("valid_frac", T.DoubleType()),
        T.StructField("snow_frac", T.DoubleType()),
        T.StructField("veg_coverage", T.DoubleType()),
        T.StructField("platform", T.StringType()),
        T.StructField("path_row", T.StringType()),
        T.StructField("processed", T.StringType()),
        T.StructField("rebuilt", T.StringType()),
    ]
)

STAC_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField(
            "properties",
            T.StructType(
                [
                    T.StructField("datetime", T.StringType()),
                    T.StructField("eo:cloud_cover", T.DoubleType()),
                    T.StructField("platform", T.StringType()),
                    T.StructField("landsat:wrs_path", T.StringType()),
                    T.StructField("landsat:wrs_row", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "assets",
            T.MapType(T.StringType(), T.StructType([T.StructField("href", T.StringType())])),
        ),
    ]
)

YEAR_CLASS = T.StructType(
    [
        T.StructField("aoi", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("classification", T.StringType()),
        T.StructField("usdm_net_score", T.DoubleType()),
    ]
)

INVENTORY_ENTRY = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("pixels", T.LongType()),
        T.StructField("km2", T.DoubleType()),
    ]
)
