import json
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from canopygrid.functions import labels
from canopygrid.model import SENTINEL2
from canopygrid.session import shared_folder
from canopygrid.sources import colocated, readers, versions, writers
from canopygrid.streaming import ingest


def test_manifest_file(spark, tmp_path):
    doc = {
        "S1": {"filename": "a.tif", "date": "2020-01-02T10:20:30.500000+00:00", "cloud_cover": 3.5, "clear_frac": 0.5},
        "S2": {"filename": "b.tif", "date": "2020-03-02T00:00:00Z", "platform": "landsat-8", "path_row": "p17r34"},
        "S3": {"filename": "c.tif", "date": "2020-04-02T00:00:00", "veg_coverage": None, "rebuilt": "x"},
    }
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    out = readers.read_manifest(spark, str(tmp_path / "m.json"))
    rows = {r.scene_id: r for r in out.collect()}
    assert rows["S1"].obs_ts.isoformat() == "2020-01-02T10:20:30.500000"
    assert rows["S2"].obs_ts.isoformat() == "2020-03-02T00:00:00" and rows["S2"].cloud_cover is None
    assert rows["S3"].path_row is None
    have = spark.createDataFrame([("a.tif",), ("c.tif",)], "filename string")
    assert {r.scene_id for r in readers.stored_scenes(out, have).collect()} == {"S1", "S3"}


def test_manifest_round_trip(spark, tmp_path):
    rows = [(f"S{i}", f"{i}.tif", float(i) if i % 2 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "scene_id string, filename string, cloud_cover double").repartition(3)
    writers.write_manifest(df, str(tmp_path / "m"))
    back = readers.read_manifest(spark, str(tmp_path / "m"), lines=True)
    assert sorted((r.scene_id, r.filename, r.cloud_cover) for r in back.collect()) == sorted(rows)


def test_stac_items(spark, tmp_path):
    item = {
        "id": "X",
        "bbox": [1, 2, 3, 4],
        "properties": {"datetime": "2020-01-02T10:20:30Z", "eo:cloud_cover": 7, "landsat:wrs_path": "017"},
        "assets": {"red": {"href": "r"}},
        "links": [],
    }
    (tmp_path / "x.json").write_text(json.dumps(item, indent=1))
    row = readers.read_stac_items(spark, str(tmp_path)).first()
    assert (row.scene_id, row.cloud_cover, row.wrs_path, row.wrs_row, row.x_max) == ("X", 7.0, "017", None, 3.0)
    assert row.assets["red"].href == "r"


def test_year_class_and_inventory(spark, tmp_path):
    (tmp_path / "y.csv").write_text("aoi,year,classification,usdm_net_score\nnorth,2017,wet,31.5\nsouth,2018,dry,\n")
    want = [("north", 2017, "wet", 31.5), ("south", 2018, "dry", None)]
    assert [tuple(r) for r in readers.read_year_class(spark, str(tmp_path / "y.csv")).collect()] == want
    assert [tuple(r) for r in readers.parse_year_class(spark.read.text(str(tmp_path / "y.csv"))).collect()] == want
    (tmp_path / "i.json").write_text(json.dumps({"500": {"label": "L", "pixels": 3, "km2": 0.1}, "100": {"label": "M", "pixels": 4, "km2": 0.2}}))
    codes = readers.read_inventory(spark, str(tmp_path / "i.json")).orderBy("code").collect()
    assert [(r.code, r.pixels) for r in codes] == [(100, 4), (500, 3)]


def test_unknown_area_fails(spark):
    v = spark.createDataFrame([("a", 1.0)], "landscape_id string, x double")
    assert readers.aoi_vertices(v, "a").count() == 1
    with pytest.raises(PySparkException, match="no area named b"):
        readers.aoi_vertices(v, "b").collect()


def test_labels(spark):
    assert len(labels.FOREST_GROUPS) == 29 and len(labels.FOREST_TYPES) == 142
    df = spark.createDataFrame([(500,), (7,)], "code int")
    got = {r.code: r.label for r in labels.with_label(df, "forest_group", "code").collect()}
    assert got == {500: "Oak/Hickory Group", 7: "Code 7"}
    got = {r.code: r.label for r in labels.with_label(df, "ecozone", "code").collect()}
    assert got[7] == "Unknown (7)"


CELLS = "sensor string, aoi string, index_name string, year int, row int, col int, value double"


def test_store_prunes_and_replaces_only_what_it_writes(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = [("s", "north", i, y, r, 0, float(y)) for i in ("NDVI", "EVI") for y in (2017, 2018) for r in (0, 300)]
    writers.write_cells(spark.createDataFrame(rows, CELLS), path)
    again = spark.createDataFrame([("s", "north", "NDVI", 2018, 5, 5, float("nan"))], CELLS)
    writers.write_cells(again, path)
    out = readers.read_cells(spark, path, "s", "north", "NDVI")
    assert sorted((r.year, r.row, r.value, r.tile_row) for r in out.collect()) == [
        (2017, 0, 2017.0, 0), (2017, 300, 2017.0, 1), (2018, 5, None, 0),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sensor" in plan
    assert spark.read.parquet(path).count() == 2 + 4 + 1


def test_scenes_of_a_year_are_added_one_by_one(spark, tmp_path):
    path = str(tmp_path / "cells")
    schema = CELLS.replace("year int", "year int, scene_id int")

    def rows(scene, values):
        return spark.createDataFrame([("s", "north", "NDVI", 2020, scene, r, 0, v) for r, v in values], schema)

    writers.write_cells(rows(1, [(0, 0.1), (1, 0.2)]), path)
    writers.write_cells(rows(2, [(0, 0.3)]), path)
    writers.write_cells(rows(1, [(5, 0.4)]), path)
    writers.merge_cells(rows(2, [(0, 0.5), (7, 0.6)]), path)
    writers.merge_cells(rows(3, [(1, 0.7)]), path)
    writers.merge_cells(rows(3, [(1, 0.7)]), path)
    got = sorted((r.scene_id, r.row, r.value) for r in spark.read.parquet(path).collect())
    assert got == [(1, 5, 0.4), (2, 0, 0.5), (2, 7, 0.6), (3, 1, 0.7)]


def test_manifest_entries_are_added_one_by_one(spark, tmp_path):
    path = str(tmp_path / "manifest")
    fields = "scene_id string, filename string, clear_frac double, processed string"
    for rows in ([("a", "1.tif", 0.5, "x"), ("b", "2.tif", None, "x")], [("b", "3.tif", 0.1, "y")], [("c", "4.tif", None, None)]):
        writers.update_manifest(spark.createDataFrame(rows, fields), path)
    got = sorted((r.scene_id, r.filename, r.clear_frac, r.processed) for r in readers.read_manifest(spark, path, lines=True).collect())
    assert got == [("a", "1.tif", 0.5, "x"), ("b", "3.tif", 0.1, "y"), ("c", "4.tif", None, None)]


def test_traits_without_nan(spark, tmp_path):
    nan = float("nan")
    rows = [(0, 1, nan, nan, 5), (1, 1, 1.5, 3.0, 6)]
    spark.createDataFrame(rows, "row int, col int, aspect double, slope double, ecozone int").write.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, readers.read_traits(spark, str(tmp_path / "t")).collect())) == [(0, 1, None, None, 5), (1, 1, 1.5, 3.0, 6)]


def test_result_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345678, "x")], "a int, b double, c string")
    writers.write_table(df, str(tmp_path / "t"), ["c", "b"], form="csv")
    # A part without rows has a header too.
    assert "c,b\nx,0.123457\n" in {f.read_text() for f in (tmp_path / "t").glob("*.csv")}
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "u"), ["c"], form="xlsx")


def test_shared_folder_follows_the_session(spark):
    class Session:
        def __init__(self, conf, master="local[2]"):
            self.conf = conf
            self.sparkContext = SimpleNamespace(master=master)

    assert shared_folder(Session({"spark.checkpoint.dir": "/shared/place/"}), "x").startswith("/shared/place/x-")
    assert shared_folder(Session({}), "x") != shared_folder(Session({}), "x")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session({}, "spark://host:7077"), "x")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_folder(spark, "x").startswith(configured)


def test_ingest_appends_each_file_once(spark, tmp_path):
    src, store, mark = (str(tmp_path / n) for n in ("bands", "store", "mark"))

    def add(scene):
        rows = [("north", scene, scene // 100, scene % 100, r, 0, 100.0, 100.0, 300.0, 100.0, scl) for r, scl in enumerate((4, 9, 5))]
        spark.createDataFrame(
            rows, "aoi string, scene_id int, year int, month int, row int, col int, blue double, red double, nir double, swir double, scl int"
        ).write.mode("append").parquet(src)

    def run():
        query = ingest.append_cells(ingest.band_stream(spark, src, files_per_batch=1), SENTINEL2, store, mark)
        query.awaitTermination()

    add(201907)
    run()
    run()
    add(202001)
    run()
    out = spark.read.parquet(store)
    counts = {(r.year, r.index_name): r.n for r in out.groupBy("year", "index_name").agg(F.count("*").alias("n")).collect()}
    assert counts == {(y, i): 2 for y in (2019, 2020) for i in ("NDVI", "NDMI", "EVI")}


def test_tags_of_other_layers_stay(spark, tmp_path):
    path = str(tmp_path / "tags")
    fields = "aoi string, index_name string, year int, scene_count long, platforms string"
    for rows in ([("n", "NDVI", 2019, 3, "a"), ("n", "EVI", 2019, 3, "a")], [("n", "NDVI", 2020, 4, "b")], [("n", "NDVI", 2019, 5, "a/b")]):
        writers.write_catalog(spark.createDataFrame(rows, fields), path)
    got = sorted((r.index_name, r.year, r.scene_count, r.platforms) for r in spark.read.parquet(path).collect())
    assert got == [("EVI", 2019, 3, "a"), ("NDVI", 2019, 5, "a/b"), ("NDVI", 2020, 4, "b")]
    monthly = str(tmp_path / "monthly")
    for month in (1, 2):
        writers.write_catalog(spark.createDataFrame([("n", "NDVI", 2019, month, month)], "aoi string, index_name string, year int, month int, scene_count long"), monthly)
    assert sorted((r.month, r.scene_count) for r in spark.read.parquet(monthly).collect()) == [(1, 1), (2, 2)]


def test_months_of_a_year_are_written_one_by_one(spark, tmp_path):
    path = str(tmp_path / "cells")
    schema = CELLS.replace("year int", "year int, month int")
    for month in (1, 2, 1):
        writers.write_cells(spark.createDataFrame([("s", "north", "NDVI", 2020, month, 0, 0, month / 10)], schema), path)
    assert sorted((r.month, r.value) for r in spark.read.parquet(path).collect()) == [(1, 0.1), (2, 0.2)]


def test_a_broken_rewrite_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "manifest")
    fields = "scene_id string, filename string"
    writers.write_manifest(spark.createDataFrame([("a", "1.tif")], fields), path)
    broken = spark.createDataFrame([("b", "2.tif")], fields).withColumn(
        "filename", F.when(F.col("scene_id") == "b", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("filename"))
    )
    with pytest.raises(PySparkException, match="broken"):
        writers.update_manifest(broken, path)
    assert [r.scene_id for r in readers.read_manifest(spark, path, lines=True).collect()] == ["a"]
    for n in range(4):
        writers.update_manifest(spark.createDataFrame([(f"n{n}", "x.tif")], fields), path)
    assert sorted(r.scene_id for r in readers.read_manifest(spark, path, lines=True).collect()) == ["a", "n0", "n1", "n2", "n3"]
    assert len(versions.numbers(spark, path)) == 2 and len(list((tmp_path / "manifest").glob("_version-*"))) == 2


def test_a_version_is_marked_once(spark, tmp_path):
    path = str(tmp_path / "state")
    versions.publish(spark, path, lambda p: spark.range(1).write.parquet(p))

    def late(folder):
        versions.publish(spark, path, lambda p: spark.range(2).write.parquet(p))
        spark.range(3).write.mode("overwrite").parquet(folder)

    with pytest.raises(Exception, match="already exists"):
        versions.publish(spark, path, late)
    assert versions.current(spark, str(tmp_path / "none")) is None


def test_buckets_grow_with_the_facts(spark):
    assert [colocated.bucket_count(spark.range(n), least=8, rows=10) for n in (0, 80, 81, 1000)] == [8, 8, 16, 128]
