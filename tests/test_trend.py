import numpy as np
import pandas as pd
import pytest

from canopygrid.operators import trend, zonal

SERIES = "aoi string, index_name string, ecozone int, year int, p95 double, n_scenes bigint"


def series(spark, values, first=2000):
    rows = [("n", "NDVI", 1, first + i, v, 1) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SERIES)


def test_rolling_mean_matches_pandas(spark):
    values = [0.1, None, 0.3, 0.5, None, 0.2, 0.9, 0.4]
    df = pd.DataFrame({"year": range(2000, 2008), "v": values}).dropna()
    want = df.v.rolling(5, center=True, min_periods=3).mean().tolist()
    got = [r.rolling_mean for r in trend.rolling_mean(series(spark, values)).orderBy("year").collect()]
    np.testing.assert_allclose(got, want)
    short = trend.rolling_mean(series(spark, [0.1, 0.2])).collect()
    assert [r.rolling_mean for r in short] == [None, None]


def test_linear_trend_matches_polyfit(spark):
    values = [0.3, 0.1, None, 0.6, 0.5]
    out = trend.linear_trend(series(spark, values), "p95").orderBy("year").collect()
    years = [2000, 2001, 2003, 2004]
    want = np.polyval(np.polyfit(years, [0.3, 0.1, 0.6, 0.5], 1), years)
    np.testing.assert_allclose([r.fitted for r in out], want)
    assert trend.linear_trend(series(spark, [0.1, None, 0.2]), "p95").count() == 0


def test_longterm_lists_empty_years(spark):
    scenes = spark.createDataFrame([("n", "NDVI", 2000), ("n", "NDVI", 2001)], "aoi string, index_name string, year int")
    p = spark.createDataFrame(
        [("n", "NDVI", 1, 2000, 0.2), ("n", "NDVI", 1, 2000, 0.4)], "aoi string, index_name string, ecozone int, year int, p95 double"
    )
    rows = {(r.ecozone, r.year): (r.p95, r.n_scenes) for r in trend.longterm_trend(p, scenes).collect()}
    assert len(rows) == 6
    assert rows[(1, 2000)] == (pytest.approx(0.3), 2) and rows[(1, 2001)] == (None, 0)
    found = trend.trend_range(trend.longterm_trend(p, scenes)).filter("ecozone = 1").first()
    assert (found.n_years, found.min_p95) == (1, pytest.approx(0.3))


def test_seasonal_amplitude_weights(spark):
    monthly = [(2018, 12, 0.2), (2019, 1, 0.4), (2019, 2, 0.6), (2019, 7, 0.9), (2020, 1, 0.3), (2020, 6, 0.7), (2020, 8, 0.9)]
    medians = spark.createDataFrame(
        [("n", "NDVI", y, m, 1, v) for y, m, v in monthly], "aoi string, index_name string, year int, month int, ecozone int, p50 double"
    )
    layers = spark.createDataFrame([("n", "NDVI", y) for y in (2018, 2019, 2020)], "aoi string, index_name string, year int")
    out = {r.year: r for r in zonal.seasonal_amplitude(medians, layers).filter("ecozone = 1").collect()}
    assert out[2019].winter == pytest.approx((0.2 + 0.5) / 2)  # December weighs as much as January and February
    assert out[2019].amplitude == pytest.approx(0.9 - 0.35)
    assert out[2020].winter == pytest.approx(0.3) and out[2020].summer == pytest.approx(0.8)
    assert (out[2018].summer, out[2018].winter, out[2018].amplitude) == (None, None, None)
    shifted = zonal.season_means(medians, (12,), "december", year_shift=1).first()
    assert (shifted.year, shifted.december) == (2019, 0.2)


def test_year_class_text(spark):
    rows = [("n", 2001, "wet", 31.4), ("n", 2000, "dry", -7.5), ("n", 2002, "neutral", 0.0)]
    out = trend.year_class_summary(spark.createDataFrame(rows, "aoi string, year int, classification string, usdm_net_score double")).collect()
    assert [(r.year, r.score_text) for r in out] == [(2000, "-8"), (2001, "+31"), (2002, "+0")]
    years = spark.createDataFrame([("n", 2000), ("n", 2002)], "aoi string, year int")
    flags = trend.trend_year_class(years, spark.createDataFrame(rows, "aoi string, year int, classification string, s double"))
    assert [tuple(r) for r in flags.collect()] == [("n", 2000, "dry")]
