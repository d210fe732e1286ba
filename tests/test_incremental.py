"""Kept state against the same result made anew, and what an update reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.operators import composites, incremental
from canopygrid.sources import versions, writers

FIELDS = "aoi string, index_name string, scene_id int, year int, month int, row int, col int, value double"


def made_scenes(seed, aois=("x", "y"), years=(2019, 2020, 2021), per_year=3):
    r = np.random.default_rng(seed)
    rows = []
    for aoi in aois:
        for year in years:
            for k in range(per_year):
                scene, month = year * 100 + 4 * k + 1, 4 * k + 1
                for c in r.choice(40, 25, replace=False):
                    rows.append((aoi, "NDVI", scene, year, month, int(c) // 8, int(c) % 8, round(float(r.uniform(-1, 1)), 6)))
    return rows


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")

    def add(rows):
        cells = spark.createDataFrame(rows, FIELDS).withColumn("sensor", F.lit("s"))
        writers.write_cells(cells, path, tile=4)

    return path, add


def rows_of(df, columns=("aoi", "index_name", "year", "row", "col", "value")):
    return sorted(tuple(r) for r in df.select(*columns).collect())




def counted_reads(spark, work):
    """Input rows that all stages of ``work`` read."""
    store = spark._jsparkSession.sparkContext().statusStore()

    def stages():
        none = spark._jvm.java.util.ArrayList()
        found = store.stageList(none, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.inputRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = work()
    return out, sum(n for key, n in stages().items() if key not in before)


def test_composites_take_in_new_scenes_only(spark, store, tmp_path):
    path, add = store
    state = str(tmp_path / "composites")
    rows = made_scenes(1)
    late = [r for r in rows if r[0] == "x" and r[2] == 202105]
    add([r for r in rows if r not in late])

    def scenes():
        return spark.read.parquet(path).select("aoi", "year", "scene_id").distinct()

    assert incremental.kept_composites(spark, state) is None
    assert incremental.extend_composites(spark.read.parquet(path), scenes(), state, batch=7, tile=4) == 17
    assert incremental.extend_composites(spark.read.parquet(path), scenes(), state, tile=4) == 0
    add(late)
    listed = spark.createDataFrame(sorted({(r[0], r[3], r[2]) for r in rows}), "aoi string, year int, scene_id int")
    taken, read = counted_reads(spark, lambda: incremental.extend_composites(spark.read.parquet(path), listed, state, tile=4))
    # The scene's cells, and the lists of scenes: of those known before and after.
    assert taken == 1 and read <= len(late) + 4 * 18
    want = rows_of(composites.max_composite(spark.createDataFrame(rows, FIELDS)))
    assert rows_of(incremental.kept_composites(spark, state)) == want
    incremental.compact(spark, state, tile=4)
    assert rows_of(incremental.kept_composites(spark, state)) == want
    tiles = {p.name for p in (tmp_path / "composites" / "parts").glob("*/aoi=x/year=2021/*")}
    assert tiles == {"tile=0_0", "tile=0_1", "tile=1_0", "tile=1_1"}


def test_files_do_not_grow_with_tiles_and_tasks(spark, store, tmp_path):
    path, add = store
    rows = made_scenes(1)
    add(rows)
    scene_files = [p.parent for p in (tmp_path / "store").rglob("*.parquet")]
    assert len(scene_files) == len(set(scene_files))
    cells = spark.read.parquet(path)
    state = str(tmp_path / "composites")
    incremental.extend_composites(cells, cells.select("aoi", "year", "scene_id").distinct(), state, tile=1)
    layers = {(r[0], r[3]) for r in rows}
    assert len(list((tmp_path / "composites" / "batches").rglob("*.parquet"))) == len(layers)
    assert rows_of(incremental.kept_composites(spark, state)) == rows_of(composites.max_composite(spark.createDataFrame(rows, FIELDS)))


def test_composites_by_month_and_a_failed_run(spark, store, tmp_path, monkeypatch):
    path, add = store
    state = str(tmp_path / "composites")
    rows = made_scenes(2, years=(2020,))
    add(rows)
    cells = spark.read.parquet(path)
    scenes = cells.select("aoi", "year", "scene_id").distinct()
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.extend_composites(cells, scenes, state, ("year", "month"))
    assert incremental.kept_composites(spark, state) is None
    incremental.extend_composites(cells, scenes, state, ("year", "month"))
    columns = ("aoi", "index_name", "year", "month", "row", "col", "value")
    want = composites.max_composite(spark.createDataFrame(rows, FIELDS), ("year", "month"))
    assert rows_of(incremental.kept_composites(spark, state), columns) == rows_of(want, columns)


def test_baseline_follows_the_classes_of_years(spark, tmp_path):
    state, layers = str(tmp_path / "baseline"), str(tmp_path / "annual")
    rows = made_scenes(3)
    composites.max_composite(spark.createDataFrame(rows, FIELDS)).write.partitionBy("aoi", "year").parquet(layers)
    annual = spark.read.parquet(layers)

    def years(*wanted):
        return spark.createDataFrame(list(wanted), "aoi string, year int")

    def same(*wanted):
        want = composites.baseline_mean(annual.join(years(*wanted), ["aoi", "year"], "left_semi"))
        got = incremental.kept_baseline(spark, state)
        columns = ["aoi", "index_name", "row", "col", "n_years", F.round("baseline", 12).alias("baseline")]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))

    first = [("x", 2019), ("x", 2020), ("y", 2020)]
    assert incremental.kept_baseline(spark, state) is None
    assert incremental.sync_baseline(annual, years(*first), state) == (3, 0)
    same(*first)
    assert incremental.sync_baseline(annual, years(*first), state) == (0, 0)
    then = [("x", 2020), ("x", 2021), ("y", 2020)]
    size = annual.filter("aoi = 'x' AND year IN (2019, 2021)").count()
    kept = incremental.kept_baseline(spark, state).count()
    changed, read = counted_reads(spark, lambda: incremental.sync_baseline(annual, years(*then), state))
    assert changed == (1, 1) and read <= size + kept + 20
    same(*then)
    assert incremental.sync_baseline(annual, years(("y", 2019)), state) == (1, 3)
    same(("y", 2019))


def test_months_are_worked_out_once(spark):
    import tempfile

    state = tempfile.mkdtemp()
    data = spark.createDataFrame([(a, y, m, y * 100 + m, v) for a in "xy" for y in (2019, 2020) for m in (1, 2, 12) for v in (1, 2)], "aoi string, year int, month int, scene_id int, v int")
    asked = []

    def make(where):
        asked.append(where)
        return data.filter(where).groupBy("aoi", "year", "month").agg(F.sum("v").alias("total"))

    def scenes(changed=None):
        tag = F.when(F.col("scene_id") == changed, "new").otherwise("old") if changed else F.lit("old")
        return data.select("aoi", "year", "month", "scene_id", tag.alias("processed")).distinct()

    assert incremental.kept_months(spark, state) is None
    assert incremental.sync_months(scenes(), make, state, "p95", ["processed"]) == 12
    assert incremental.sync_months(scenes(), make, state, "p95", ["processed"]) == 0 and len(asked) == 1
    assert incremental.sync_months(scenes(201902), make, state, "p95", ["processed"]) == 2
    assert data.filter(asked[1]).select("year", "month").distinct().count() == 1
    assert incremental.sync_months(scenes(201902).filter("aoi = 'x'"), make, state, "p95", ["processed"]) == 0
    got = incremental.kept_months(spark, state)
    assert sorted(map(tuple, got.select("aoi", "year", "month", "total").collect())) == [("x", y, m, 3) for y in (2019, 2020) for m in (1, 2, 12)]
    assert incremental.sync_months(scenes(201902), make, state, "p50", ["processed"]) == 12
