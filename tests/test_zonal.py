import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.operators import crosstab, strata, zonal

CELLS = "aoi string, index_name string, scene_id int, year int, month int, row int, col int, value double"


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(4)
    traits = {
        "ecozone": rng.integers(0, 4, (12, 12)),
        "aspect": rng.uniform(0, 360, (12, 12)),
        "elevation": rng.uniform(0, 1000, (12, 12)),
    }
    traits["elevation"][0, 0] = 1000.0
    scenes = {200001: None, 200007: None, 200107: None, 200110: None}
    for s in scenes:
        z = rng.uniform(-1, 1, (12, 12))
        z[rng.uniform(size=z.shape) < 0.2] = np.nan
        scenes[s] = z
    return traits, scenes


@pytest.fixture(scope="module")
def frames(spark, world):
    traits, scenes = world
    t = spark.createDataFrame(
        [(r, c, int(traits["ecozone"][r, c]), float(traits["aspect"][r, c]), float(traits["elevation"][r, c])) for r in range(12) for c in range(12)],
        "row int, col int, ecozone int, aspect double, elevation double",
    )
    rows = [
        ("north", i, s, s // 100, s % 100, r, c, float(v) * k)
        for s, z in scenes.items()
        for (r, c), v in np.ndenumerate(z)
        for i, k in (("NDVI", 1.0), ("NDMI", 0.5))
    ]
    return spark.createDataFrame(rows, CELLS), t


def expected(world, p, code, minimum):
    """Scene percentiles of one ecozone."""
    traits, scenes = world
    out = {}
    for s, z in scenes.items():
        vals = z[(traits["ecozone"] == code) & np.isfinite(z)]
        if len(vals) >= minimum:
            out[s] = np.percentile(vals, p)
    return out


def test_two_level_means(world, frames):
    cells, traits = frames
    p = zonal.zonal_percentiles(zonal.in_ecozones(cells, traits), min_pixels=20)
    means = zonal.peak_productivity(p, traits).collect()
    for code in (1, 2, 3):
        want = expected(world, 95, code, 20)
        got = [r for r in means if r.ecozone == code and r.index_name == "NDVI"]
        if not want:
            assert not got or (got[0].n_scenes, got[0].p95) == (0, None)
            continue
        assert got[0].n_scenes == len(want)
        assert got[0].p95 == pytest.approx(np.mean(list(want.values())))
        assert got[0].pixel_count == (world[0]["ecozone"] == code).sum()
    assert p.filter("p95 > p99 OR p99 > p100").count() == 0


def test_methods_agree(frames):
    cells, traits = frames
    zoned = zonal.in_ecozones(cells, traits)
    rows = lambda m: sorted(
        tuple(round(v, 12) if isinstance(v, float) else v for v in r)
        for r in zonal.zonal_percentiles(zoned, min_pixels=1, method=m).collect()
    )
    assert rows("binned") == rows("hash")


def test_seasons_and_scaffold(world, frames):
    cells, traits = frames
    p = zonal.zonal_percentiles(zonal.in_ecozones(cells, traits), percentiles=(95, 100), min_pixels=1)
    curves = zonal.seasonal_curves(p)
    assert curves.count() == 2 * 12 * 3
    july = curves.filter("month = 7 AND ecozone = 2 AND index_name = 'NDVI'").first()
    want = expected(world, 95, 2, 1)
    assert july.p95 == pytest.approx(np.mean([want[200007], want[200107]])) and july.n_scenes == 2
    assert curves.filter("month = 3 AND (n_scenes <> 0 OR p95 IS NOT NULL)").count() == 0
    counts = {r.month: r.n_scenes for r in zonal.seasonal_scene_count(curves).filter("index_name = 'NDVI'").collect()}
    assert counts[7] == 2 and counts[1] == 1 and counts[2] == 0

    scenes = cells.filter("index_name = 'NDMI'").select("aoi", "scene_id", "year", "month").distinct()
    seasons = {r.season: r.n_scenes for r in zonal.season_partition(scenes).collect()}
    assert seasons == {"growing": 2, "dormant": 1, "excluded": 1}
    row = zonal.moisture_amplitude(p.filter("index_name = 'NDMI'"), scenes).filter("ecozone = 2").first()
    assert row.amplitude == pytest.approx((np.mean([want[200007], want[200107]]) - want[200001]) / 2)
    assert (row.growing_scenes, row.dormant_scenes) == (2, 1)


def test_drought(world, frames, spark):
    cells, traits = frames
    p = zonal.zonal_percentiles(zonal.in_ecozones(cells, traits), min_pixels=1)
    classes = spark.createDataFrame([("north", 2000, "wet")], "aoi string, year int, classification string")
    out = zonal.drought_response(p, classes)
    assert out.count() == 2 * 3 * 3
    wet = out.filter("classification = 'wet' AND ecozone = 1 AND index_name = 'NDVI'").first()
    want = expected(world, 95, 1, 1)
    assert wet.p95 == pytest.approx(np.mean([want[200001], want[200007]]))
    assert {(r.classification, r.step) for r in zonal.drought_space(out).collect()} == {("wet", 1)}
    scenes = cells.select("aoi", "scene_id", "year", "month").distinct()
    assert zonal.unclassified_scenes(scenes, classes).first().n_scenes == 2
    counted = zonal.drought_scene_counts(scenes, classes).first()
    assert (counted.n_scenes, counted.years) == (2, "2000")
    wide = zonal.summary_wide(out, ["aoi", "classification", "ecozone"], ["n_scenes", "p95"], ["NDVI", "NDMI"])
    assert wide.count() == 9 and "NDMI_p95" in wide.columns


def test_aspect_contrast(world, frames):
    cells, traits = frames
    t, scenes = world
    south = (t["aspect"] >= 135) & (t["aspect"] <= 225)
    north = (t["aspect"] >= 315) | (t["aspect"] <= 45)
    minimum = 25
    with_aspect = zonal.with_traits(cells, traits, ["aspect"])
    series = zonal.aspect_series(zonal.whole_and_sides(with_aspect, (75,), min_pixels=minimum))
    got = {r.scene_id: r for r in series.filter("index_name = 'NDVI'").collect()}
    both = {r.scene_id: r.diff for r in zonal.aspect_diff_both(with_aspect, min_pixels=minimum).filter("index_name = 'NDVI'").collect()}
    for s, z in scenes.items():
        ok = np.isfinite(z)
        side = {n: z[ok & m] for n, m in (("south", south), ("north", north))}
        p = {n: np.percentile(v, 75) if len(v) > minimum else None for n, v in side.items()}
        assert got[s].whole == pytest.approx(np.percentile(z[ok], 75))
        assert (got[s].south, got[s].north) == (pytest.approx(p["south"]) if p["south"] is not None else None, pytest.approx(p["north"]) if p["north"] is not None else None)
        if min(len(v) for v in side.values()) >= minimum:
            assert both[s] == pytest.approx(np.percentile(side["south"], 75) - np.percentile(side["north"], 75))
    summary = zonal.series_summary(series, ["whole"]).filter("index_name = 'NDVI'").first()
    wholes = [np.percentile(z[np.isfinite(z)], 75) for z in scenes.values()]
    assert summary.whole_std == pytest.approx(np.std(wholes))


def test_verdict(spark):
    df = spark.createDataFrame([(-0.06,), (-0.05,), (0.051,), (None,)], "diff_mean double")
    assert [r.verdict for r in zonal.aspect_verdict(df).collect()] == ["LOWER", "NONE", "HIGHER", None]


def test_elevation_bands(world, frames):
    cells, traits = frames
    z = world[0]["elevation"]
    bands = {r.lo: r.n_px for r in strata.elevation_bands(traits, 200, 1).collect()}
    want = {lo: int(((z >= lo) & (z < lo + 200)).sum()) for lo in range(0, 1000, 200)}
    assert bands == {k: v for k, v in want.items() if v}  # 1000 itself lies in no band
    out = zonal.elevation_gradient(zonal.in_elevation_bands(cells, traits, min_band_px=1), traits, min_band_px=1, min_pixels=1).collect()
    for r in out:
        inside = (z >= r.lo) & (z < r.hi)
        p = [np.percentile(s[inside & np.isfinite(s)], 95) for s in world[1].values()]
        assert r.NDVI_p95 == pytest.approx(np.mean(p)) and r.EVI_p95 is None


def test_strata_sum_to_whole(frames):
    _, traits = frames
    counts = crosstab.crosstab_counts(traits, "ecozone")
    by = {r.stratum: r.n for r in counts.groupBy("stratum").agg(F.sum("px").alias("n")).collect()}
    assert by["whole"] == by["south"] + by["north"] + by["neither"] == 144
    shares = crosstab.side_shares(traits, "ecozone").agg(F.sum("south_pct"), F.sum("north_pct")).first()
    assert shares[0] == pytest.approx(100) and shares[1] == pytest.approx(100)


def test_crosstab_edges(spark):
    rows = [(180.0, 502, 1), (180.0, 0, 1), (0.0, 502, 1), (90.0, 7, 1)]
    t = spark.createDataFrame(rows, "aspect double, forest_type int, ecozone int")
    oak = {r.code: r for r in crosstab.subset_delta(t).collect()}
    assert len(oak) == 8
    assert (oak[502].south_pct, oak[502].north_pct, oak[502].delta) == (100.0, 100.0, 0.0)
    assert (oak[515].south_px, oak[515].south_total, oak[515].south_pct) == (0, 1, 0.0)
    assert crosstab.species_delta(t, min_px=1).count() == 1  # 7 lies on neither side
    flat = t.filter("aspect = 90")
    assert [r.south_pct for r in crosstab.side_shares(flat, "forest_type").collect()] == [0.0]
    assert crosstab.species_delta(t, min_px=0).filter("code = 7").first().label == "Code 7"


def test_cells_of_kept_groups(spark):
    rows = [(0,)] * 9 + [(500,)] * 5 + [(400,)] * 2
    t = spark.createDataFrame(rows, "forest_group int")
    kept = strata.forest_group_strata(t, 3)
    assert [(r.forest_group, r.px, r.label) for r in kept.collect()] == [(500, 5, "Oak/Hickory Group")]
    assert [r.forest_group for r in strata.skipped_groups(t, 3).collect()] == [400]
    assert strata.in_strata(t, kept, "forest_group").count() == 5


def test_a_third_area_and_grids_of_their_own(spark):
    """Areas come from the rows; traits with an area are matched by it."""
    cells = [(a, "NDVI", 202007, 2020, 7, 0, c, v) for a, v in (("north", 0.1), ("south", 0.2), ("east", 0.3)) for c in range(3)]
    cells = spark.createDataFrame(cells, "aoi string, index_name string, scene_id int, year int, month int, row int, col int, value double")
    zone = {"north": 1, "south": 2, "east": 3}
    traits = spark.createDataFrame(
        [(a, 0, c, z, 100.0 * z + 200 * (c == 2)) for a, z in zone.items() for c in range(3)], "aoi string, row int, col int, ecozone int, elevation double"
    )
    p = zonal.zonal_percentiles(zonal.in_ecozones(cells, traits), percentiles=(95, 99, 100), min_pixels=1)
    assert sorted((r.aoi, r.ecozone, r.n) for r in p.collect()) == [("east", 3, 3), ("north", 1, 3), ("south", 2, 3)]
    curves = zonal.seasonal_curves(p).filter("n_scenes > 0").collect()
    assert sorted((r.aoi, r.ecozone) for r in curves) == [("east", 3), ("north", 1), ("south", 2)]
    assert zonal.seasonal_curves(p).count() == 3 * 12 * 3
    classes = spark.createDataFrame([(a, 2020, "dry") for a in zone], "aoi string, year int, classification string")
    assert zonal.drought_response(p, classes).filter("n_scenes = 1").count() == 3
    peak = zonal.peak_productivity(p, traits).collect()
    assert sorted((r.aoi, r.ecozone, r.n_scenes, r.pixel_count) for r in peak) == [("east", 3, 1, 3), ("north", 1, 1, 3), ("south", 2, 1, 3)]
    bands = zonal.elevation_gradient(zonal.in_elevation_bands(cells, traits, min_band_px=1), traits, min_band_px=1, min_pixels=2)
    assert sorted((r.aoi, r.lo, r.n_px, r.NDVI_p95) for r in bands.collect()) == [
        ("east", 200, 2, 0.3), ("east", 400, 1, None), ("north", 0, 2, 0.1), ("north", 200, 1, None), ("south", 200, 2, 0.2),
    ]
    with pytest.raises(ValueError, match="aoi"):
        zonal.in_ecozones(cells.drop("aoi"), traits)


def test_zones_and_bands_without_scenes_are_listed(spark):
    cells = spark.createDataFrame([("a", "NDMI", 1, 2020, 7, 0, 0, 0.5)], "aoi string, index_name string, scene_id int, year int, month int, row int, col int, value double")
    traits = spark.createDataFrame([(0, 0, 1, 10.0), (0, 1, 2, 250.0), (0, 2, 3, 450.0)], "row int, col int, ecozone int, elevation double")
    p = zonal.zonal_percentiles(zonal.in_ecozones(cells, traits), min_pixels=1)
    peak = zonal.peak_productivity(p, traits).collect()
    assert sorted((r.ecozone, r.n_scenes, r.p95, r.pixel_count) for r in peak) == [(1, 1, 0.5, 1), (2, 0, None, 1), (3, 0, None, 1)]
    season = zonal.moisture_amplitude(p, cells.select("aoi", "scene_id", "month")).collect()
    assert sorted((r.ecozone, r.growing_p95, r.growing_scenes) for r in season) == [(1, 0.5, 1), (2, None, 1), (3, None, 1)]
    bands = zonal.elevation_gradient(zonal.in_elevation_bands(cells, traits, min_band_px=1), traits, min_band_px=1, min_pixels=1).collect()
    assert sorted((r.lo, r.NDMI_p95) for r in bands) == [(0, 0.5), (200, None), (400, None)]


def test_monthly_medians_follow_each_areas_own_zones(spark):
    """Two areas with the same cells and different zones: no value of one falls in a zone of the other."""
    fields = "aoi string, index_name string, year int, month int, row int, col int, value double"
    rows = [(a, "NDVI", 2000, 7, 0, c, v + c) for a, v in (("x", 0.1), ("y", 5.1)) for c in range(3)]
    zones = [(a, 0, c, z) for a, z in (("x", 1), ("y", 2)) for c in range(3)]
    traits = spark.createDataFrame(zones, "aoi string, row int, col int, ecozone int")
    got = zonal.zonal_median_monthly(spark.createDataFrame(rows, fields), traits, min_pixels=1)
    assert sorted((r.aoi, r.ecozone, r.n, r.p50) for r in got.collect()) == [("x", 1, 3, 1.1), ("y", 2, 3, 6.1)]
