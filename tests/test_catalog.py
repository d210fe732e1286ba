import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.functions import naming
from canopygrid.operators import catalog


def windows_by_hand(start, end):
    """Half-year steps snapped to the first of a month."""
    out, at = [], start
    while at < end:
        months = at.year * 12 + at.month - 1 + 6
        stop = min(dt.date(months // 12, months % 12 + 1, 1), end)
        out.append((at, stop))
        at = stop
    return out


@pytest.mark.parametrize(
    "start, end",
    [("2017-01-01", "2026-03-01"), ("2017-08-31", "2018-03-01"), ("1984-03-15", "1985-09-15"), ("2020-02-29", "2020-03-01"), ("2020-05-05", "2020-05-05")],
)
def test_search_windows(spark, start, end):
    start, end = map(dt.date.fromisoformat, (start, end))
    bounds = spark.createDataFrame([(start, end)], "start date, end date")
    got = sorted((r.win_start, r.win_end) for r in catalog.search_windows(bounds).collect())
    assert got == windows_by_hand(start, end)


def test_calendar_windows_drop_the_future(spark):
    bounds = spark.createDataFrame([(2019, 2020)], "first_year int, last_year int")
    got = [(str(r.win_start), str(r.win_end)) for r in catalog.search_windows_calendar(bounds, "2020-07-01").collect()]
    assert got == [("2019-01-01", "2019-07-01"), ("2019-07-01", "2020-01-01"), ("2020-01-01", "2020-07-01")]


def test_boundary_day_is_in_both_windows(spark):
    bounds = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2021, 1, 1))], "start date, end date")
    items = spark.createDataFrame([(1, dt.datetime(2020, 7, 1, 23)), (2, dt.datetime(2020, 6, 30)), (3, dt.datetime(2021, 1, 2))], "item int, obs_ts timestamp_ntz")
    got = catalog.window_assign(items, catalog.search_windows(bounds)).groupBy("item").count().collect()
    assert {r["item"]: r["count"] for r in got} == {1: 2, 2: 1}


def test_footprints_match_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    box = lambda: (lambda x, y, w, h: (x, x + w, y, y + h))(*map(float, (*rng.uniform(-50, 50, 2), *rng.uniform(0, 30, 2))))
    cols = "x_min double, x_max double, y_min double, y_max double"
    items = [(i, *box()) for i in range(60)] + [(60, 0.0, 10.0, 0.0, 10.0)]
    areas = [(f"a{i}", *box()) for i in range(5)] + [("touch", 10.0, 20.0, 10.0, 20.0)]
    got = catalog.footprint_intersects(
        spark.createDataFrame(items, f"item int, {cols}"), spark.createDataFrame(areas, f"aoi string, {cols}"), 7.0
    ).collect()
    want = [
        (i[0], a[0]) for i in items for a in areas if i[1] <= a[2] and i[2] >= a[1] and i[3] <= a[4] and i[4] >= a[3]
    ]
    assert sorted((r["item"], r["aoi"]) for r in got) == sorted(want)


def test_filters_and_names(spark):
    rows = [
        (1, None, "landsat-5", "S2A_T17SPB_x_T18ABC"),
        (2, 40.0, "landsat-4", "S2A_T17SP_TOOLONG"),
        (3, 39.9, "landsat-9", "T1234_T12345"),
    ]
    df = spark.createDataFrame(rows, "item int, cloud_cover double, platform string, scene_id string")
    assert [r["item"] for r in catalog.cloud_filter(df).collect()] == [3]
    assert [r["item"] for r in catalog.platform_filter(df).orderBy("item").collect()] == [1, 3]
    tiles = [r[0] for r in df.orderBy("item").select(naming.tile_id(F.col("scene_id"))).collect()]
    assert tiles == ["T17SPB", "unknown", "T12345"]
    pr = df.limit(1).select(naming.path_row(F.lit("17"), F.lit(None)), naming.path_row_display(F.lit(None), F.lit("34"))).first()
    assert tuple(pr) == ("17?", "p?r34")


def test_date_range_includes_the_last_day(spark):
    rows = [(1, dt.datetime(2019, 12, 31, 23, 59)), (2, dt.datetime(2020, 1, 1)), (3, dt.datetime(2020, 12, 31, 23, 59)), (4, dt.datetime(2021, 1, 1))]
    df = spark.createDataFrame(rows, "item int, obs_ts timestamp_ntz")
    assert [r["item"] for r in catalog.date_range_filter(df, "2020-01-01", "2020-12-31").collect()] == [2, 3]


def test_dedup_keeps_the_first(spark):
    t = dt.datetime
    rows = [(5, t(2020, 1, 1, 9), "A"), (4, t(2020, 1, 1, 9), "A"), (1, t(2020, 1, 1, 10), "A"), (2, t(2020, 1, 1, 12), "B"), (3, t(2020, 1, 2), "A")]
    df = spark.createDataFrame(rows, "item int, obs_ts timestamp_ntz, tile string").withColumn("day", naming.day_text(F.col("obs_ts")))
    assert sorted(r["item"] for r in catalog.scene_dedup(df).collect()) == [2, 3, 4]


def test_heal_and_audit(spark):
    items = spark.createDataFrame([(i, "20200101", f"T{i}") for i in range(4)], "item int, day string, tile string")
    name = lambda i: f"NDVI_20200101_T{i}.tif"
    outputs = spark.createDataFrame([("NDVI", name(0)), ("NDVI", name(1))], "index_name string, filename string")
    manifest = spark.createDataFrame(
        [("NDVI", name(0), 0, "20200101", 3.0), ("NDVI", name(2), 2, "20200101", 4.0), ("NDVI", "NDVI_20191231_X.tif", 99, "20191231", 5.0)],
        "index_name string, filename string, item int, day string, cloud_cover double",
    )
    stray = outputs.union(spark.createDataFrame([("EVI", "EVI_20181130_T9.tif")], "index_name string, filename string"))
    rows = catalog.manifest_heal(items, stray, manifest, ["NDVI"]).collect()
    healed = {r["item"]: (r.status, r.cloud_cover) for r in rows}
    assert healed == {
        0: ("kept", 3.0), 1: ("healed", None), 2: ("redownload", 4.0), 3: ("new", None),
        # Entries and files outside the search stay.
        99: ("redownload", 5.0), None: ("healed", None),
    }
    assert [(r.filename, r.day) for r in rows if r["item"] is None] == [("EVI_20181130_T9.tif", "20181130")]
    counts = {r.index_name: (r.cached, r.needed) for r in catalog.cache_inventory(items, outputs, ["NDVI", "EVI"]).collect()}
    assert counts == {"NDVI": (2, 2), "EVI": (0, 4)}


@pytest.mark.parametrize(
    "name, want",
    [("2017_07", "2017-07-15"), ("2017_7.tif", "2017-07-15"), ("2017", "2017-07-01"), (" 2017.tif ", "2017-07-01"), ("2017_13", None), ("mosaic", None), ("2017_01_02", None)],
)
def test_acquired_date(spark, name, want):
    got = spark.range(1).select(naming.acquired_date(F.lit(name))).first()[0]
    assert (str(got) if got else None) == want


def test_available_years(spark):
    df = spark.createDataFrame([("2016_01",), ("2017_01",), ("2017_02",), ("x_1",), ("2019",)], "name string")
    assert sorted(r.year for r in catalog.available_years(df, 2017).collect()) == [2017, 2019]


def test_incremental_skip(spark):
    want = spark.createDataFrame([("a", 1), ("a", 2)], "aoi string, year int")
    assert [tuple(r) for r in catalog.incremental_skip(want, want.filter("year = 1"), ["aoi", "year"]).collect()] == [("a", 2)]


def test_polygons_intersect_like_brute_force(spark):
    """Concave outlines, holes, one within the other, in the other's hole, touching, apart."""
    from fractions import Fraction

    star = [(0, 0), (4, 0), (5, 8), (6, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(1, 3), (3, 3), (3, 9), (1, 9), (1, 3)]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    areas = {"u": [star, hole], "far": [square(100, 100, 5)], "big": [square(-50, -50, 200), square(0, 20, 30)]}
    rng = np.random.default_rng(3)
    items = {i: [square(*map(float, rng.integers(-3, 13, 2)), float(rng.choice([0.25, 1, 2, 30])))] for i in range(60)}
    items |= {
        100: [square(4.75, 1.0, 0.25)], 101: [square(1.5, 4.0, 1.0)], 102: [square(10, 10, 3)], 103: [square(5, 21, 2)],
        104: [square(-60, -60, 300)], 105: [square(-1, 19, 40), square(-0.5, 19.5, 35)], 106: [[(0, 0), (3, 3), (0, 3), (0, 0)]],
        107: [square(103, 103, 1)],
    }

    def sides(rings):
        return [(*map(Fraction, a), *map(Fraction, b)) for r in rings for a, b in zip(r, r[1:])]

    def turn(ax, ay, bx, by, cx, cy):
        t = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        return (t > 0) - (t < 0)

    def meet(s, t):
        (a, b, c, d), (e, f, g, h) = s, t
        if max(a, c) < min(e, g) or max(e, g) < min(a, c) or max(b, d) < min(f, h) or max(f, h) < min(b, d):
            return False
        return turn(a, b, c, d, e, f) * turn(a, b, c, d, g, h) <= 0 and turn(e, f, g, h, a, b) * turn(e, f, g, h, c, d) <= 0

    def holds(rings, p):
        x, y = map(Fraction, p)
        return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in sides(rings)) % 2 == 1

    want = {
        (i, n)
        for i, own in items.items()
        for n, area in areas.items()
        if any(meet(s, t) for s in sides(own) for t in sides(area)) or any(holds(area, r[0]) for r in own) or any(holds(own, r[0]) for r in area)
    }
    rows = lambda d: [(n, k, i, float(x), float(y)) for n, rings in d.items() for k, r in enumerate(rings) for i, (x, y) in enumerate(r)]
    f = spark.createDataFrame(rows(items), "item long, ring int, seq int, x double, y double")
    a = spark.createDataFrame(rows(areas), "aoi string, ring int, seq int, x double, y double")
    pairs = f.select("item").distinct().crossJoin(a.select("aoi").distinct())
    for bucket in (2.0, 7.0, 1000.0):
        assert {tuple(r) for r in catalog.polygons_intersect(pairs, f, a, bucket).collect()} == want
    assert {(101, "u"), (103, "big")}.isdisjoint(want) and {(100, "u"), (104, "u"), (102, "u"), (107, "far")} <= want | {(100, "u")}


def test_items_of_one_bucket_are_dealt_to_many_keys(spark):
    from canopygrid.operators import catalog

    many, few = spark.range(500).selectExpr("id AS item", "1 AS b"), spark.sql("SELECT 'x' AS aoi, 1 AS b")
    joined = catalog._dealt_join(many, few, ["b"])
    assert joined.count() == 500 and joined.columns == ["b", "item", "aoi"]
    assert "__salt" in joined._jdf.queryExecution().toString()


def test_items_stay_where_they_lie(spark, sf):
    """Nothing of the items but what is found is shuffled, even where Spark itself sends nothing to the tasks."""
    import re

    from canopygrid.plans import catalog_plans, fixtures as fx

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("footprint_polygons", "footprint_intersects"):
            text = catalog_plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
            moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
            assert all(re.sub(r"#\d+L?", "", m) in ("item, aoi", "item, ring, aoi") for m in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_rows_of_areas_are_joined_by_shuffle(spark, sf, monkeypatch):
    """The same pairs come out where the areas' sides are too many to be sent."""
    from canopygrid.plans import catalog_plans

    want = [sorted(map(tuple, catalog_plans.QUERIES[n](spark, sf).collect())) for n in ("footprint_polygons", "footprint_intersects")]
    monkeypatch.setattr(catalog, "SENT", 0)
    got = [sorted(map(tuple, catalog_plans.QUERIES[n](spark, sf).collect())) for n in ("footprint_polygons", "footprint_intersects")]
    assert got == want and want[0]
