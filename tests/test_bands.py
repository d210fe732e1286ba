import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.functions import terrain
from canopygrid.model import LANDSAT, SENTINEL2
from canopygrid.operators import pixels

KEYS = ["cell"]
SCHEMA = "cell int, blue double, red double, nir double, swir double, scl int, qa int"


def column(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("cell").collect()]


def test_indices_match_numpy(spark):
    rng = np.random.default_rng(1)
    raw = rng.integers(1, 10000, size=(200, 4)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), 4, 0) for i, r in enumerate(raw)], SCHEMA)
    got = np.array(column(pixels.with_indices(df, SENTINEL2), "NDVI", "NDMI", "EVI"), dtype=float)
    b, r, n, s = (raw / 10000.0).T
    want = np.stack(
        [(n - r) / (n + r), (n - s) / (n + s), np.clip(2.5 * (n - r) / (n + 6 * r - 7.5 * b + 1), -1, 1)], axis=1
    )
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize(
    "nir, red, blue, want",
    [
        (0.5, 0.25, 0.4, 1.0),  # zero denominator clips by the sign of the numerator
        (0.5, 2.0, 1.8, -1.0),
        (2.0, 2.0, 2.0, None),  # nothing over nothing
        (0.5, 0.1, 0.3, -1.0),  # beyond the range, denominator below zero
        (0.4, 0.2, 0.1, 2.5 * 0.2 / (0.4 + 1.2 - 0.75 + 1)),
    ],
)
def test_evi_edges(spark, nir, red, blue, want):
    got = spark.range(1).select(B.evi(F.lit(nir), F.lit(red), F.lit(blue)).alias("v")).first()[0]
    assert got == (want if want is None else pytest.approx(want))


def test_ndvi_of_nothing_is_null(spark):
    assert spark.range(1).select(B.ndvi(F.lit(0.0), F.lit(0.0)).alias("v")).first()[0] is None


def test_masks(spark):
    ok = (100.0, 100.0, 200.0, 100.0)
    rows = [(i, *ok, c, 0) for i, c in enumerate(range(0, 12))]
    df = spark.createDataFrame(rows, SCHEMA)
    clear = [r[0] for r in column(df.select("cell", B.clear_of_cloud(SENTINEL2, F.col("scl")).alias("c")), "c")]
    assert clear == [c not in (8, 9, 10, 11) for c in range(12)]
    rows = [(i, *ok, 0, 1 << i) for i in range(16)]
    df = spark.createDataFrame(rows, SCHEMA)
    clear = [r[0] for r in column(df.select("cell", B.clear_of_cloud(LANDSAT, F.col("qa")).alias("c")), "c")]
    assert clear == [i not in (1, 2, 3, 5) for i in range(16)]


def test_open_interval_and_scope(spark):
    rows = [
        (0, 100.0, 100.0, 200.0, 0.0, 4, 0),  # moisture band invalid
        (1, 100.0, 10000.0, 200.0, 100.0, 4, 0),
        (2, 100.0, 100.0, 200.0, 100.0, 4, 0),
        (3, 100.0, None, 200.0, 100.0, 4, 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    requested = pixels.index_cells(df, SENTINEL2, KEYS)
    assert {(r.cell, r.index_name) for r in requested.collect()} == {(2, "NDVI"), (2, "NDMI"), (2, "EVI")}
    own = pixels.index_cells(df, SENTINEL2, KEYS, validity_scope="own_bands")
    assert {(r.cell, r.index_name) for r in own.collect()} == {
        (0, "NDVI"), (0, "EVI"), (1, "NDMI"), (2, "NDVI"), (2, "NDMI"), (2, "EVI"), (3, "NDMI"),
    }
    fewer = pixels.index_cells(df, SENTINEL2, KEYS, ["NDVI"])
    assert {r.cell for r in fewer.collect()} == {0, 2}


def test_landsat_reflectance_range(spark):
    dn = [7272.0, 7273.0, 43636.0, 43637.0, 20000.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(dn)], "cell int, dn double")
    got = [r[0] for r in column(df.select("cell", B.reflectance(LANDSAT, F.col("dn")).alias("v")), "v")]
    scaled = [d * 0.0000275 - 0.2 for d in dn]
    assert got == [pytest.approx(s) if 0 <= s <= 1 else None for s in scaled]


def test_offset(spark):
    got = spark.range(1).select(B.reflectance(SENTINEL2, F.lit(3000.0), offset=-0.1).alias("v")).first()[0]
    assert got == pytest.approx(0.2)


def test_unknown_index_is_refused():
    with pytest.raises(ValueError):
        B.bands_for(["NDWI"])


def test_scene_fractions(spark):
    rows = [(i, 1.0, 1.0, 2.0, 1.0, scl, 0, inside) for i, (scl, inside) in enumerate(
        [(11, True), (4, True), (4, True), (11, False), (8, True), (4, False)]
    )]
    df = spark.createDataFrame(rows, SCHEMA + ", in_aoi boolean").withColumns({"scene_id": F.lit(1), "aoi": F.lit("a")})
    # The scene sees half of the area's 8 cells, and one of them twice.
    cell = ["row", "col"]
    seen = df.withColumns({"row": F.monotonically_increasing_id(), "col": F.lit(0)})
    seen = seen.union(seen.filter("scl = 11 AND in_aoi"))
    areas = spark.createDataFrame([("a", 8), ("b", 5)], "aoi string, area_px long")
    out = pixels.scene_fractions(seen, areas, SENTINEL2, cell=cell).first()
    assert (out.area_px, out.snow_px, out.snow_frac, out.clear_frac) == (8, 1, 0.125, 0.25)
    filled = pixels.class_fill_outside(df, SENTINEL2)
    assert [r[0] for r in column(filled, "scl")] == [11, 4, 4, 0, 8, 0]


@pytest.mark.parametrize("missing", ["nir", "red", "blue"])
def test_index_of_a_missing_band_is_missing(spark, missing):
    bands = {b: F.lit(None if b == missing else 0.3).cast("double") for b in ("nir", "red", "blue")}
    assert spark.range(1).select(B.evi(**bands)).first()[0] is None


def test_no_class_without_a_finite_property(spark):
    nan = F.lit(float("nan"))
    row = spark.range(1).select(
        terrain.aspect_side(nan), terrain.aspect_side(F.lit(10.0), nan, 5.0), terrain.steep(nan),
        terrain.elevation_class(nan), terrain.elevation_class(nan, positive_low=True), terrain.elevation_band(nan),
    ).first()
    assert tuple(row) == ("neither", "neither", False, None, None, None)
