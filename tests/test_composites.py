import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.operators import composites

SCHEMA = "aoi string, index_name string, scene_id int, year int, month int, row int, col int, value double"


@pytest.fixture(scope="module")
def stack():
    """years x scenes x rows x cols, with gaps."""
    rng = np.random.default_rng(11)
    z = rng.uniform(-1, 1, (4, 3, 3, 4))
    z[rng.uniform(size=z.shape) < 0.3] = np.nan
    z[:, :, 0, 0] = np.nan
    return z


@pytest.fixture(scope="module")
def cells(spark, stack):
    rows = [
        ("north", "NDVI", 100 * y + s, 2017 + y, s + 1, r, c, float(v))
        for (y, s, r, c), v in np.ndenumerate(stack)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def dense(df, name, shape, *keys):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[k] - (2017 if k == "year" else 1 if k == "month" else 0) for k in keys)] = r[name]
    return out


def fmax(z, axis):
    return np.fmax.reduce(z, axis=axis)


def test_annual_and_monthly(cells, stack):
    annual = dense(composites.max_composite(cells), "value", (4, 3, 4), "year", "row", "col")
    np.testing.assert_array_equal(annual, fmax(stack, 1))
    monthly = composites.max_composite(cells, ("year", "month"))
    np.testing.assert_array_equal(
        dense(monthly, "value", stack.shape, "year", "month", "row", "col"), stack
    )


def test_order_free_and_idempotent(cells):
    once = composites.max_composite(cells)
    again = composites.max_composite(once)
    shuffled = composites.max_composite(cells.orderBy(F.rand(3)).unionByName(cells))
    rows = lambda df: sorted(map(tuple, df.select(*once.columns).collect()))
    assert rows(once) == rows(again) == rows(shuffled)


def test_infinite_and_empty(spark):
    rows = [
        ("n", "NDVI", 1, 2017, 1, 0, 0, float("inf")),
        ("n", "NDVI", 1, 2017, 1, 0, 1, float("nan")),
        ("n", "NDVI", 2, 2018, 1, 0, 0, 0.1),
    ]
    out = composites.max_composite(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.year, r.value) for r in out] == [(2018, 0.1)]


def test_baseline_and_anomaly(spark, cells, stack):
    annual = composites.max_composite(cells)
    want = fmax(stack, 1)
    with np.errstate(all="ignore"):
        mean = np.nanmean(want, axis=0)
    np.testing.assert_allclose(
        dense(composites.baseline_mean(annual), "baseline", (3, 4), "row", "col"), mean
    )
    out = composites.anomaly(annual)
    np.testing.assert_allclose(dense(out, "anomaly", want.shape, "year", "row", "col"), want - mean)
    assert out.filter(F.abs(F.col("baseline") + F.col("anomaly") - F.col("value")) > 1e-12).count() == 0

    classes = spark.createDataFrame(
        [("north", 2017, "wet"), ("north", 2018, "neutral"), ("north", 2020, "neutral")],
        "aoi string, year int, classification string",
    )
    with np.errstate(all="ignore"):
        neutral = np.nanmean(want[[1, 3]], axis=0)
    got = dense(composites.anomaly(annual, classes), "anomaly", want.shape, "year", "row", "col")
    np.testing.assert_allclose(got, want - neutral)
    base = dense(composites.baseline_neutral(annual, classes), "baseline", (3, 4), "row", "col")
    np.testing.assert_allclose(base, neutral)
    none = classes.filter("classification = 'dry'")
    assert composites.anomaly(annual, none).count() == 0

    stats = {r.year: r for r in composites.anomaly_stats(out).collect()}
    d = (want - mean)[2]
    assert stats[2019].mean_anomaly == pytest.approx(np.nanmean(d))
    assert stats[2019].min_anomaly == pytest.approx(np.nanmin(d))


def test_metadata(spark, cells, stack):
    scenes = cells.select("aoi", "scene_id", "year").distinct().withColumn(
        "platform", F.when(F.col("scene_id") % 2 == 0, "landsat-8").otherwise("landsat-5")
    )
    size = spark.createDataFrame([("north", 12)], "aoi string, n_cells int")
    rows = composites.composite_metadata(composites.max_composite(cells), scenes, size).collect()
    valid = np.isfinite(fmax(stack, 1)).sum(axis=(1, 2))
    assert {r.year: (r.scene_count, r.platforms, r.valid_px) for r in rows} == {
        2017 + y: (3, "landsat-5/landsat-8", int(valid[y])) for y in range(4)
    }
    assert all(r.valid_pct == pytest.approx(r.valid_px / 12 * 100) for r in rows)
