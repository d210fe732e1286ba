import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.functions import terrain
from canopygrid.model import Grid
from canopygrid.operators import grid


def table(spark, array, name="elevation"):
    rows = [
        (r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(array, dtype=float))
    ]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


@pytest.mark.parametrize("tile", [3, 4, 256])
def test_gradient_matches_numpy(spark, tile):
    z = np.random.default_rng(0).uniform(0, 500, (10, 9))
    z[4, 5] = np.nan
    out = grid.gradient_xy(table(spark, z), tile=tile)
    assert out.count() == z.size
    dy, dx = np.gradient(z, 10.0)
    np.testing.assert_allclose(dense(out, "dx", z.shape), dx, atol=1e-9)
    np.testing.assert_allclose(dense(out, "dy", z.shape), dy, atol=1e-9)


def test_gradient_by_area(spark):
    z = np.arange(12.0).reshape(3, 4)
    both = table(spark, z).withColumn("aoi", F.lit("a")).unionByName(
        table(spark, z * 2).withColumn("aoi", F.lit("b"))
    )
    out = {r.aoi: r.dx for r in grid.gradient_xy(both, keys=["aoi"]).filter("row = 1 AND col = 1").collect()}
    assert out == {"a": 0.1, "b": 0.2}


def test_slope_and_aspect_conventions(spark):
    # Ground rising to the south by 1 m per m: it faces north.
    z = np.repeat(np.arange(5.0)[:, None] * 10, 5, axis=1)
    up = grid.slope_aspect(table(spark, z)).filter("row = 2 AND col = 2").first()
    assert up.slope == pytest.approx(45) and up.aspect == pytest.approx(180)
    down = grid.slope_aspect(table(spark, z), convention="downslope").filter("row = 2 AND col = 2").first()
    assert down.aspect == pytest.approx(0)
    flat = grid.slope_aspect(table(spark, np.zeros((3, 3)))).first()
    assert flat.slope == 0 and flat.aspect is None


def test_aspect_matches_numpy(spark):
    z = np.random.default_rng(5).uniform(0, 60, (8, 8))
    dy, dx = np.gradient(z, 10.0)
    slope = np.degrees(np.arctan(np.sqrt(dx**2 + dy**2)))
    want = 90 - np.degrees(np.arctan2(-dy, dx))
    want = np.where(want < 0, want + 360, want)
    want[slope < 2] = np.nan
    np.testing.assert_allclose(dense(grid.slope_aspect(table(spark, z)), "aspect", z.shape), want, atol=1e-9)


def ray_cast(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


@pytest.mark.parametrize("seed", range(4))
def test_polygon_fill_matches_ray_cast(spark, seed):
    rng = np.random.default_rng(seed)
    g = Grid(x_min=100.0, y_max=900.0, width=30, height=20, dx=10.0, dy=10.0)

    def ring(cx, cy, radius, n):
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        r = radius * rng.uniform(0.3, 1.3, n)
        points = [(cx + a * np.cos(t), cy + a * np.sin(t)) for a, t in zip(r, angle)]
        return [*points, points[0]]

    # The hole, an edge on cell centres, and a part beyond the grid.
    rings = [ring(250, 800, 160, 12), ring(240, 790, 40, 6), [(105.0, 705.0), (145.0, 705.0), (145.0, 745.0), (105.0, 745.0), (105.0, 705.0)]]
    rows = [("a", i, s, float(x), float(y)) for i, rg in enumerate(rings) for s, (x, y) in enumerate(rg)]
    vertices = spark.createDataFrame(rows, "aoi string, ring int, seq int, x double, y double")
    got = {(r["row"], r["col"]) for r in grid.aoi_cells(vertices, g).collect()}
    want = {
        (r, c)
        for r in range(g.height)
        for c in range(g.width)
        if ray_cast(rings, g.x_min + (c + 0.5) * g.dx, g.y_max - (r + 0.5) * g.dy)
    }
    assert got == want


def test_area_and_canonical_grid(spark):
    square = [(0.0, 0.0), (1005.0, 0.0), (1005.0, 2000.0), (0.0, 2000.0), (0.0, 0.0)]
    hole = [(100.0, 100.0), (200.0, 100.0), (200.0, 200.0), (100.0, 200.0), (100.0, 100.0)]
    rows = [("a", i, s, x, y) for i, rg in enumerate((square, hole)) for s, (x, y) in enumerate(rg)]
    v = spark.createDataFrame(rows, "aoi string, ring int, seq int, x double, y double")
    assert grid.aoi_area(v).first().area_km2 == pytest.approx((1005 * 2000 - 10000) / 1e6)
    g = grid.canonical_grid(v, 10.0).first()
    assert (g.width, g.height, g.dx) == (100, 200, pytest.approx(10.05))


def test_regrid(spark):
    z = np.arange(16.0).reshape(4, 4)
    fine = Grid(0, 40, 4, 4, 10, 10)
    coarse = Grid(0, 40, 2, 2, 20, 20)
    target = spark.createDataFrame([(r, c) for r in range(2) for c in range(2)], "row int, col int")
    nearest = grid.regrid_nearest(target, table(spark, z), coarse, fine, "elevation")
    assert dense(nearest, "elevation", (2, 2)).tolist() == [[5, 7], [13, 15]]
    bilinear = grid.regrid_bilinear(target, table(spark, z), coarse, fine, "elevation")
    assert dense(bilinear, "elevation", (2, 2)).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    z[0, 0] = np.nan
    gap = grid.regrid_bilinear(target, table(spark, z), coarse, fine, "elevation")
    assert dense(gap, "elevation", (2, 2))[0, 0] == pytest.approx((1 + 4 + 5) / 3)
    outside = spark.createDataFrame([(9, 9)], "row int, col int")
    assert grid.regrid_bilinear(outside, table(spark, z), coarse, fine, "elevation").first().elevation is None


def test_dem_mosaic_skips_gaps(spark):
    a = table(spark, [[1.0, np.nan], [3.0, np.nan]])
    b = table(spark, [[3.0, 5.0], [np.nan, np.nan]])
    assert np.array_equal(
        dense(grid.dem_mosaic(a, b), "elevation", (2, 2)), [[2.0, 5.0], [3.0, np.nan]], equal_nan=True
    )


def test_raster_stats(spark):
    z = np.random.default_rng(2).uniform(-5, 2000, (9, 9))
    z[0, 0] = np.nan
    row = grid.raster_stats(table(spark, z), "elevation", value_range=(0, 3000)).first()
    valid = z[np.isfinite(z)]
    assert (row.n_cells, row.n_valid) == (81, 80)
    np.testing.assert_allclose([row.p25, row.p50, row.p75], np.percentile(valid, [25, 50, 75]))
    assert row["mean"] == pytest.approx(valid.mean()) and row.has_negative == (valid.min() < 0)


def test_alignment_codes(spark):
    head = "aoi string, layer string, epsg int, res double, width int, height int, x_min double, y_max double"
    layers = spark.createDataFrame(
        [
            ("a", "fits", 32617, 10.005, 5, 4, 0.0, 40.0),
            ("a", "bad", None, 30.0, 2, 4, 5.0, 40.0),
        ],
        head,
    )
    want = spark.createDataFrame([("a", "x", 32617, 10.0, 5, 4, 0.0, 40.0)], head)
    got = {r.layer: (r.issues, r.n_issues) for r in grid.alignment_check(layers, want).collect()}
    assert got == {"fits": ("", 0), "bad": ("crs,resolution,shape,origin", 4)}


def test_aspect_edges(spark):
    values = [0.0, 45.0, 45.1, 134.9, 135.0, 225.0, 225.1, 314.9, 315.0, 360.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a double")
    got = [r[0] for r in df.orderBy("i").select(terrain.aspect_side(F.col("a"))).collect()]
    assert got == ["north", "north", "neither", "neither", "south", "south", "neither", "neither", "north", "north", "neither"]


@pytest.mark.parametrize("factor, shift, tile", [(2.0, 0.0, 4), (0.5, 0.0, 3), (1.0, 3.7, 5), (1.7, -2.3, 4), (3.0, 1.25, 256)])
def test_resampled_layers_equal_regridded_ones(spark, factor, shift, tile):
    """Whole layers by tile against the cell-by-cell form, over gaps, nulls and the edges of tiles and of the source."""
    r = np.random.default_rng(int(factor * 10))
    frm = Grid(100.0, 500.0, 13, 11, 10.0, 10.0)
    to = Grid(100.0 + shift, 500.0 - shift, int(13 * factor) + 2, int(11 * factor) + 2, 10.0 / factor, 10.0 / factor)
    cells = [(i, j, None if r.random() < 0.1 else float(r.normal())) for i in range(11) for j in range(13) if r.random() < 0.9]
    source = spark.createDataFrame(cells, "row int, col int, v double")
    target = spark.createDataFrame([(i, j) for i in range(to.height) for j in range(to.width)], "row int, col int")
    present = {(i, j) for i, j, _ in cells}
    want = {}
    for x in grid.regrid_bilinear(target, source, to, frm, "v").collect():
        y, z = (frm.y_max - (to.y_max - (x.row + 0.5) * to.dy)) / frm.dy, (to.x_min + (x.col + 0.5) * to.dx - frm.x_min) / frm.dx
        if (int(np.floor(y)), int(np.floor(z))) in present:
            want[x.row, x.col] = x.v
    got = {(x.row, x.col): x.v for x in grid.resample_bilinear(source, to, frm, "v", tile=tile).collect()}
    assert set(got) == set(want) and len(want) > 20
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-9))


def test_resampling_shuffles_the_source_once(spark):
    frm, to = Grid(0.0, 0.0, 600, 600, 1.0, 1.0), Grid(0.0, 0.0, 1200, 1200, 0.5, 0.5)
    source = spark.range(600 * 600).select((F.col("id") / 600).cast("int").alias("row"), (F.col("id") % 600).cast("int").alias("col"), F.lit(1.0).alias("v"))
    text = grid.resample_bilinear(source, to, frm, "v")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    below = grid.resample_bilinear(source, to, frm, "v")
    assert below.count() == 1200 * 1200


def test_tiles_of_an_area(spark):
    """Every cell is decided by its tile or by its row's runs, and both agree with the outline."""
    ring = [(0.0, 0.0), (31.0, 0.0), (20.0, -18.0), (31.0, -33.0), (2.0, -33.0), (0.0, 0.0)]
    hole = [(6.0, -10.0), (14.0, -10.0), (14.0, -20.0), (6.0, -20.0), (6.0, -10.0)]
    rows = [("a", k, i, x, y) for k, r in enumerate((ring, hole)) for i, (x, y) in enumerate(r)]
    vertices = spark.createDataFrame(rows, "aoi string, ring int, seq int, x double, y double")
    g = Grid(0.0, 0.0, 33, 35, 1.0, 1.0)
    cells = spark.createDataFrame([(a, i, j) for a in "ab" for i in range(35) for j in range(33)], "aoi string, row int, col int")
    want = {tuple(r) for r in grid.aoi_cells(vertices, g).collect()}
    tiles = {(r.tile_row, r.tile_col): r.cover == grid.WHOLE for r in grid.aoi_tiles(vertices, g, 4).collect()}
    for i in range(9):
        for j in range(9):
            own = [("a", y, x) in want for y in range(4 * i, min(35, 4 * i + 4)) for x in range(4 * j, min(33, 4 * j + 4))]
            assert tiles.get((i, j)) == (None if not any(own) else all(own))
    assert any(tiles.values()) and not all(tiles.values())
    assert {tuple(r) for r in grid.inside_area(cells, vertices, g, 4).collect()} == want


def test_tiles_outside_are_not_read(spark, tmp_path):
    path = str(tmp_path / "tiled")
    cells = spark.range(64 * 64).select(
        F.lit("a").alias("aoi"), (F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col")
    )
    cells.withColumns(grid.tile_columns(8)).repartition("tile_row", "tile_col").write.partitionBy("tile_row", "tile_col").parquet(path)
    ring = [(0.0, 0.0), (20.0, 0.0), (20.0, -20.0), (0.0, -20.0), (0.0, 0.0)]
    vertices = spark.createDataFrame([("a", 0, i, x, y) for i, (x, y) in enumerate(ring)], "aoi string, ring int, seq int, x double, y double")
    g, kept = Grid(0.0, 0.0, 64, 64, 1.0, 1.0), str(tmp_path / "tiles")
    grid.aoi_tiles(vertices, g, 8).write.parquet(kept)
    store = spark._jsparkSession.sparkContext().statusStore()

    def read():
        none = spark._jvm.java.util.ArrayList()
        found = store.stageList(none, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), none)
        return sum(found.apply(i).inputRecords() for i in range(found.size()))

    before = read()
    inside = grid.inside_area(spark.read.parquet(path), vertices, g, 8, spark.read.parquet(kept))
    assert inside.count() == 400
    # Nine of 64 tiles hold cells of the area.
    assert read() - before < 1000
