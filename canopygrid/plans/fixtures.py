"""Raster-shaped views of the given tables.

``part`` is a grid 50 cells wide (one row per cell), ``lineitem`` the band
observations of its cells, ``orders`` a scene catalog. Column pruning and
filters pass through to the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.functions import naming
from canopygrid.model import INDICES, LANDSAT, SENTINEL2, Grid
from canopygrid.operators import catalog, pixels, zonal
from canopygrid.sources import scene_table

WIDTH = 50
SCENE_KEYS = ("aoi", "scene_id", "year", "month")
CELL_KEYS = (*SCENE_KEYS, "row", "col")
BANDS = ("blue", "red", "nir", "swir", "scl", "qa")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _case(column: str, values: dict, otherwise) -> Column:
    out = F
    for key, value in values.items():
        out = out.when(F.col(column) == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def _row(key: str) -> Column:
    return F.floor(F.col(key) / WIDTH).cast("int")


def _col(key: str) -> Column:
    return (F.col(key) % WIDTH).cast("int")


def traits(spark: SparkSession, sf: str) -> DataFrame:
    """Dense static grid."""
    size = F.col("p_size")
    slope = (size % 30).cast("double")
    return table(spark, sf, "part").select(
        _row("p_partkey").alias("row"),
        _col("p_partkey").alias("col"),
        (size * 40).cast("double").alias("elevation"),
        slope.alias("slope"),
        F.when(slope >= 2, ((F.col("p_partkey") * 37) % 360).cast("double")).alias("aspect"),
        (size % 4).cast("int").alias("ecozone"),
        F.when(size == 13, F.lit(900))
        .otherwise(
            _case(
                "p_type",
                {"ECONOMY": 0, "STANDARD": 500, "MEDIUM": 400, "PROMO": 100, "LARGE": 800},
                998,
            )
        )
        .cast("int")
        .alias("forest_group"),
        F.when(size % 7 == 0, 0).when(size % 11 == 0, 999).otherwise(500 + size % 17).cast("int").alias("forest_type"),
        F.col("p_brand").alias("layer"),
    )


def area_traits(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of each area on its own grid: the southern one is laid out from the other side."""
    zones = traits(spark, sf).select("row", "col", "ecozone")
    mirrored = zones.select("row", (WIDTH - 1 - F.col("col")).alias("col"), "ecozone")
    return zones.withColumn("aoi", F.lit("north")).unionByName(mirrored.withColumn("aoi", F.lit("south")))


# Header of the static grid: unit cells, row 0 at the top, as many rows as there are.
GRID = Grid(x_min=0.0, y_max=0.0, width=WIDTH, height=None, dx=1.0, dy=1.0)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Band observations; a scene is a month of one area."""
    line = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    ts = F.col("l_shipdate")
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.when(F.col("s_nationkey") % 2 == 0, "north").otherwise("south").alias("aoi"),
        (F.year(ts) * 100 + F.month(ts)).alias("scene_id"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        _row("l_partkey").alias("row"),
        _col("l_partkey").alias("col"),
        (F.col("l_extendedprice") / 10).alias("nir"),
        (F.col("l_quantity") * 100).alias("red"),
        (F.col("l_tax") * 10000).alias("swir"),
        (F.col("l_discount") * 10000).alias("blue"),
        (F.col("l_linenumber") + 4).cast("int").alias("scl"),
        F.expr("shiftleft(1, l_linenumber - 1)").alias("qa"),
        F.when(F.col("l_linestatus") == "F", "landsat-5").otherwise("landsat-8").alias("platform"),
    )


def obs_landsat(spark: SparkSession, sf: str) -> DataFrame:
    """The same observations in the other sensor's raw number range."""
    return obs(spark, sf).withColumns(
        {
            "nir": F.col("nir") * 5,
            "red": F.col("red") * 8,
            "swir": F.col("swir") * 30 + 7000,
            "blue": F.col("blue") * 20 + 7000,
        }
    )


def cells(spark: SparkSession, sf: str, indices=INDICES, **options) -> DataFrame:
    """Long index cells of the optical sensor."""
    return pixels.index_cells(obs(spark, sf), SENTINEL2, CELL_KEYS, indices, **options)


def wide_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same, a column per index."""
    return pixels.wide_cells(obs(spark, sf), SENTINEL2, CELL_KEYS)


def cells_with(spark: SparkSession, sf: str, columns, sensor=SENTINEL2) -> DataFrame:
    """Long index cells with columns of their traits, joined to the bands before rows triple."""
    source = obs if sensor is SENTINEL2 else obs_landsat
    joined = zonal.with_traits(source(spark, sf), traits(spark, sf), columns)
    return pixels.index_cells(joined, sensor, (*CELL_KEYS, *columns))


def zoned_cells(spark: SparkSession, sf: str, sensor=SENTINEL2) -> DataFrame:
    """Long index cells of the ecozones, the zones joined likewise."""
    source = obs if sensor is SENTINEL2 else obs_landsat
    return pixels.index_cells(
        zonal.in_ecozones(source(spark, sf), traits(spark, sf)), sensor, (*CELL_KEYS, "ecozone")
    )


def cells_landsat(spark: SparkSession, sf: str, indices=INDICES, **options) -> DataFrame:
    return pixels.index_cells(obs_landsat(spark, sf), LANDSAT, CELL_KEYS, indices, **options)


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of each area, whether or not a cell is usable: the table that is written when bands come in."""
    return scene_table.of_bands(spark, sf, lambda: obs(spark, sf))


def layers(spark: SparkSession, sf: str, keys=("year",)) -> DataFrame:
    """(aoi, index_name, period) with a scene."""
    names = F.array(*[F.lit(i) for i in INDICES])
    return (
        scenes(spark, sf)
        .select("aoi", *keys)
        .distinct()
        .withColumn("index_name", F.explode(names))
        .select("aoi", "index_name", *keys)
    )


def stac(spark: SparkSession, sf: str) -> DataFrame:
    """Scene catalog with duplicates, unknown cloud cover and awkward ids."""
    key, cust, ts = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    tile = F.concat(F.lit("T17SP"), F.substring(F.lit("ABCD"), (cust % 4 + 1).cast("int"), F.lit(1)))
    return table(spark, sf, "orders").select(
        key.alias("item"),
        ts.alias("obs_ts"),
        F.when(key % 17 != 0, (cust % 100).cast("double")).alias("cloud_cover"),
        F.when(key % 23 == 0, F.lit("S2A_MSIL2A_NOTILE"))
        .when(key % 29 == 0, F.lit("S2A_MSIL2A_T17SPAXX_T17S"))
        .when(key % 31 == 0, F.concat(F.lit("S2A_T1_MSIL2A_"), tile, F.lit("_T18TWL")))
        .otherwise(F.concat(F.lit("S2A_MSIL2A_"), F.year(ts).cast("string"), F.lit("_"), tile))
        .alias("scene_id"),
        _case("o_orderstatus", {"F": "landsat-5", "O": "landsat-8"}, "landsat-4").alias("platform"),
        F.when(key % 19 != 0, (16 + cust % 3).cast("string")).alias("wrs_path"),
        (34 + cust % 2).cast("string").alias("wrs_row"),
        (cust % 97).cast("double").alias("x_min"),
        (cust % 97 + 10).cast("double").alias("x_max"),
        (-(key % 89) - 10).cast("double").alias("y_min"),
        (-(key % 89)).cast("double").alias("y_max"),
    )


# Corners of a footprint in tenths of its box: a square with a wedge cut out from below, and a hole in every fifth.
FOOTPRINT = ((0, 0), (4, 0), (5, 8), (6, 0), (10, 0), (10, 10), (0, 10), (0, 0))
FOOTPRINT_HOLE = ((1, 4), (4, 4), (4, 9), (1, 9), (1, 4))


def footprint_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints of the scene catalog as polygons in the areas' coordinates, concave and some with a hole: a row each."""
    boxes = stac(spark, sf).select(
        "item", (F.col("x_min") / 2).alias("x0"), (F.col("y_min") / 2).alias("y0"), (F.col("x_max") - F.col("x_min")).alias("w")
    )
    # A third is small enough to lie within an area, or its hole.
    size = F.when(F.col("item") % 3 == 0, F.col("w") / 40).otherwise(F.col("w") / 10)
    corner = lambda ring, seq, x, y: F.struct(
        F.lit(ring).alias("ring"), F.lit(seq).alias("seq"), (F.col("x0") + x * size).alias("x"), (F.col("y0") + y * size).alias("y")
    )
    rings = F.array(*[corner(0, i, *c) for i, c in enumerate(FOOTPRINT)])
    hole = F.array(*[corner(1, i, *c) for i, c in enumerate(FOOTPRINT_HOLE)])
    both = F.when(F.col("item") % 5 == 0, F.concat(rings, hole)).otherwise(rings)
    return boxes.select("item", both.alias("corners"))


def footprints(spark: SparkSession, sf: str) -> DataFrame:
    """The same, a row per corner."""
    return footprint_shapes(spark, sf).select("item", F.inline("corners"))


def scenes_s2(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered catalog, one item per day and tile."""
    items = stac(spark, sf).withColumns(
        {"day": naming.day_text(F.col("obs_ts")), "tile": naming.tile_id(F.col("scene_id"))}
    )
    return catalog.scene_dedup(catalog.cloud_filter(items))


def _two_thirds(spark: SparkSession, sf: str, keep: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("index_name"), F.lit(k).alias("k")) for k, name in enumerate(INDICES)])
    return (
        scenes_s2(spark, sf)
        .select("item", "day", "tile", "cloud_cover", F.inline(pairs))
        .filter(keep)
        .withColumn("filename", naming.layer_file(F.col("index_name"), F.col("day"), F.col("tile")))
    )


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Layer files that exist: about two of three."""
    return _two_thirds(spark, sf, (F.col("item") + F.col("k")) % 3 != 0)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest entries: about four of five, not the same as the files."""
    return _two_thirds(spark, sf, (F.col("item") * 7 + F.col("k")) % 5 != 0)


def year_class(spark: SparkSession, sf: str) -> DataFrame:
    """Moisture class of the years with a scene; every fourth year fits no class and has no row."""
    shift = F.when(F.col("aoi") == "north", 0).otherwise(1)
    kind = (F.col("year") + shift) % 4
    return (
        scenes(spark, sf)
        .select("aoi", "year")
        .distinct()
        .withColumn("classification", F.when(kind == 0, "wet").when(kind == 1, "neutral").when(kind == 2, "dry"))
        .filter("classification IS NOT NULL")
        .withColumn("usdm_net_score", ((F.col("year") * 37 + shift * 11) % 80 - 30).cast("double"))
    )


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Area outlines with a corner in every row of the static grid.

    Each area has one straight side and one whose corners follow the cells of
    their row; the southern one has a hole. y runs from 0 at the top to minus
    the number of rows.
    """
    part = table(spark, sf, "part")
    swing = F.sum("p_size") % 20
    row, bottom = F.col("row"), -F.col("height")

    def corner(aoi, ring, seq, x, y):
        return F.struct(
            F.lit(aoi).alias("aoi"),
            F.lit(ring).alias("ring"),
            seq.cast("int").alias("seq"),
            x.cast("double").alias("x"),
            y.cast("double").alias("y"),
        )

    sides = part.groupBy(_row("p_partkey").alias("row")).agg(swing.alias("k"))
    outline = sides.select(
        F.inline(
            F.array(
                *[
                    corner(aoi, 0, row + 1, F.lit(25) + sign * F.col("k"), -(row + 0.3))
                    for aoi, sign in (("north", 1), ("south", -1))
                ]
            )
        )
    )
    first, last = F.lit(0), F.col("height") + 1
    rest = []
    for aoi, x in (("north", 5), ("south", 45)):
        top = F.lit(-0.1)
        for seq, y in ((first, top), (last, bottom + 0.2), (last + 1, top)):
            rest.append(corner(aoi, 0, seq, F.lit(x), y))
    for seq, (x, share) in enumerate(HOLE):
        rest.append(corner("south", 1, F.lit(seq), F.lit(x), bottom * share))
    ends = part.agg((_row_of_last() + 1).alias("height")).select(F.inline(F.array(*rest)))
    return outline.unionByName(ends).select(
        F.concat(F.lit("landscape "), "aoi").alias("landscape_id"), "aoi", "ring", "seq", "x", "y"
    )


# Corners of the hole: column and share of the height.
HOLE = ((31, 0.50), (35, 0.40), (39, 0.50), (35, 0.62), (31, 0.50))


def _row_of_last() -> Column:
    return F.floor(F.max("p_partkey") / WIDTH)


def area_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The static grid once per area."""
    return traits(spark, sf).select(
        F.explode(F.array(F.lit("north"), F.lit("south"))).alias("aoi"), "row", "col"
    )


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of each area's grid."""
    return area_cells(spark, sf).groupBy("aoi").agg(F.count("*").alias("n_cells"))
