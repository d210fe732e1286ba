"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from canopygrid.functions.quantiles import grouped_percentiles
from canopygrid.operators import catalog, composites, grid
from canopygrid.plans import catalog_plans, fixtures as fx, raster_plans, zonal_plans

WRITES = (
    "sink_cells", "sink_manifest", "sink_inventory", "sink_table",
    "annual_max_kept", "baseline_neutral_kept", "inside_area", "zonal_median_monthly_kept", "zonal_percentiles_colocated",
)
CORE = {**catalog_plans.QUERIES, **raster_plans.QUERIES, **zonal_plans.QUERIES}
LAZY = sorted(set(CORE) - set(WRITES))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_product_and_no_python(spark, sf, name):
    text = plan(CORE[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "InPandas"):
        assert bad not in text, bad


def test_scan_reads_only_what_is_asked(spark, sf):
    text = plan(fx.cells(spark, sf, ["NDVI"]).select("aoi", "value"))
    schema = re.search(r"l_suppkey[^\n]*ReadSchema: (struct<[^>]*>)", text).group(1)
    assert "l_quantity" in schema and "l_extendedprice" in schema
    for unused in ("l_tax", "l_discount", "l_returnflag", "l_orderkey", "l_shipdate"):
        assert unused not in schema


def test_band_filters_reach_the_scan(spark, sf, tmp_path):
    from canopygrid.model import SENTINEL2
    from canopygrid.operators import pixels

    path = str(tmp_path / "bands")
    fx.obs(spark, sf).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        text = plan(pixels.index_cells(spark.read.parquet(path), SENTINEL2, fx.CELL_KEYS))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "LessThan(nir,10000.0)" in pushed and "GreaterThan(swir,0.0)" in pushed and "In(scl" in pushed


def test_date_filter_reaches_the_scan(spark, sf):
    text = plan(catalog.date_range_filter(fx.stac(spark, sf), "1996-03-01", "1999-12-31"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)


def executed(df):
    df.collect()
    text = plan(df)
    return text[: text.find("== Initial Plan ==")]


def counted(spark, make):
    """Records that all stages of ``make`` and its result read from tables and write to shuffles."""
    store = spark._jsparkSession.sparkContext().statusStore()

    def stages():
        none = spark._jvm.java.util.ArrayList()
        found = store.stageList(none, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), none)
        return {
            (s.stageId(), s.attemptId()): (s.inputRecords(), s.shuffleWriteRecords(), s.stageId())
            for s in (found.apply(i) for i in range(found.size()))
        }

    before = stages()
    make().write.format("noop").mode("overwrite").save()
    new = [n for key, n in stages().items() if key not in before]
    return sum(n[0] for n in new), sum(n[1] for n in new)


def spread(spark, groups, each):
    """Values without order in groups that lie together, as scenes do in a store."""
    return spark.range(groups * each).select(
        (F.col("id") / each).cast("long").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(2_000_003)) / 1_000_001.0 - 1).alias("value")
    )


def test_percentiles_shuffle_few_rows(spark):
    """Counts per bin and the rows of the wanted bins move, not the rows."""
    rows = spread(spark, 4, 100_000)
    _, moved = counted(spark, lambda: grouped_percentiles(rows, ["g"], percentiles=(50, 95), bins=(256,)))
    assert moved < 0.05 * 400_000
    _, repeated = counted(spark, lambda: grouped_percentiles(rows, ["g"], percentiles=(50, 95), bins=(32, 32)))
    assert repeated < moved


def test_percentiles_of_very_many_groups_shuffle_few_rows(spark):
    """300,000 groups: no list of their bins anywhere, and under a fifth of the rows moves."""
    groups, each = 300_000, 500
    rows = spread(spark, groups, each)
    _, moved = counted(spark, lambda: grouped_percentiles(rows, ["g"], percentiles=(50,), bins=(8, 8)))
    assert moved < groups * each / 5


def test_percentiles_run_nothing_before_they_are_asked_for(spark, sf):
    jobs = lambda: spark._jsparkSession.sparkContext().statusStore().jobsList(None).size()
    zoned = fx.zoned_cells(spark, sf)
    before = jobs()
    text = plan(grouped_percentiles(zoned, ["aoi", "scene_id", "ecozone"]))
    assert jobs() == before and "BroadcastExchange" in text


def test_strata_are_not_exploded_before_the_shuffle(spark):
    """A fact moves at most once for all of its strata."""
    sides = F.element_at(F.array(*map(F.lit, ("south", "north", "neither"))), (F.col("id") % 3 + 1).cast("int"))
    rows = spread(spark, 10, 20_000).withColumn("id", F.monotonically_increasing_id()).withColumn("side", sides).drop("id")
    strata = {"whole": None, "south": ["south"], "north": ["north"]}
    make = lambda s: grouped_percentiles(rows, ["g"], percentiles=(50,), bins=(64,), part="side", strata=s)
    _, all_three = counted(spark, lambda: make(strata))
    _, one = counted(spark, lambda: make({"whole": None}))
    assert all_three < 3 * one + 10_000 and all_three < 0.2 * 200_000
    text = plan(make(strata))
    # Values move by part, and parts become strata above that.
    assert re.search(r"Exchange hashpartitioning\(__key#\d+, __part#\d+, __up#\d+, __v#", text)
    assert "Generate" not in text[text.rindex("Exchange") :]


def test_strata_join_before_rows_triple(spark, sf):
    text = plan(fx.zoned_cells(spark, sf))
    assert text.index("Generate inline") < text.index("Join") and text.count("Generate inline") == 1


def test_composites_move_a_row_a_cell(spark, sf):
    text = plan(raster_plans.annual(spark, sf))
    assert text.index("Generate inline") < text.index("Exchange hashpartitioning") and "partial_max" in text


def test_masks_move_no_facts_by_cell(spark, sf):
    for name in ("combined_mask", "class_fill_outside"):
        assert not re.search(r"Exchange hashpartitioning\(aoi[^)]*col#", plan(CORE[name](spark, sf)))


@pytest.mark.parametrize(
    "name, reads",
    [
        # once for the histogram and once for the wanted bins
        ("seasonal_curves", 2), ("peak_productivity", 2), ("seasonal_sync", 2), ("elevation_gradient", 2), ("aspect_series", 2),
        ("elevation_diff", 2), ("strata_percentiles", 2),
        # the composites below the percentiles are made once
        ("season_mean", 1),
        # whose scenes come from the scene table
        ("drought_response", 2), ("longterm_trend", 2), ("moisture_amplitude", 2), ("seasonal_amplitude", 1), ("season_partition", 0),
    ],
)
def test_how_often_facts_are_read(spark, name, reads):
    sf = "/root/testdata/sf0.01"
    facts = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    fx.scenes(spark, sf)
    read, _ = counted(spark, lambda: entry.queries()[name](spark, sf))
    assert reads <= read / facts < reads + 0.5


def test_colocated_facts_do_not_move(spark, sf):
    """With broadcasts off, the join of facts and traits reads both where they lie."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    cells = zonal_plans.colocated_cells(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(cells)
        moved = plan(zonal_plans.fx.zoned_cells(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text
    assert "Exchange" in moved


def test_fractions_move_bitmaps(spark, sf):
    """No row is shuffled for a cell."""
    text = plan(raster_plans.snow_fraction(spark, sf))
    assert "bitmap_construct_agg" in text and not re.search(r"Exchange hashpartitioning\([^)]*\bcol#", text)


def test_dedup_limits_groups_before_the_shuffle(spark, sf):
    text = plan(fx.scenes_s2(spark, sf))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", text)


def test_composites_combine_before_the_shuffle(spark, sf):
    text = plan(composites.max_composite(fx.cells(spark, sf)))
    assert "partial_max" in text and text.count("Exchange hashpartitioning") == 1


def test_anomaly_adds_one_shuffle(spark, sf):
    text = plan(composites.anomaly(raster_plans.annual(spark, sf)))
    assert text.count("Exchange hashpartitioning") == 2


def test_gradient_shuffles_once(spark, sf):
    text = plan(grid.gradient_xy(fx.traits(spark, sf).select("row", "col", "elevation")))
    assert text.count("Exchange hashpartitioning") == 1


def test_top_k_is_not_a_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(raster_plans.class_topk(spark, sf))


def test_crosstab_shuffles_counts_only(spark, sf):
    text = plan(zonal_plans.crosstab_counts(spark, sf))
    assert text.count("Exchange") == 2 and "partial_count" in text


def test_skip_is_an_anti_join(spark, sf):
    assert "LeftAnti" in plan(catalog_plans.incremental_skip(spark, sf))
