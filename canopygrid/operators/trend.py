"""Change over years: long-term series, rolling means and fitted lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions import naming
from canopygrid.model import ECOZONES
from canopygrid.operators.zonal import LAYER, mean_over_scenes

SERIES = (*LAYER, "ecozone")


def longterm_trend(scene_p95: DataFrame, scenes: DataFrame) -> DataFrame:
    """Mean scene p95 per year and ecozone.

    Every year with a scene is listed; without a contributing scene p95 is
    null and the count 0. ``scenes`` has (aoi, index_name, year).
    """
    keys = [*SERIES, "year"]
    frame = (
        scenes.select(*LAYER, "year")
        .distinct()
        .withColumn("ecozone", F.explode(F.array(*[F.lit(z) for z in ECOZONES])))
    )
    return (
        frame.join(mean_over_scenes(scene_p95, keys, (95,)), keys, "left")
        .withColumn("n_scenes", F.coalesce("n_scenes", F.lit(0).cast("bigint")))
        .select(*keys, "p95", "n_scenes")
    )


def trend_range(trend: DataFrame) -> DataFrame:
    """Years with data, lowest and highest value of each series."""
    return trend.groupBy(*SERIES).agg(
        F.count("p95").alias("n_years"), F.min("p95").alias("min_p95"), F.max("p95").alias("max_p95")
    )


def rolling_mean(trend: DataFrame, value: str = "p95", width: int = 5, min_values: int = 3) -> DataFrame:
    """Centred mean over the years that have data; gaps are not filled.

    A series has one row per year.
    """
    half = width // 2
    frame = Window.partitionBy(*SERIES).orderBy("year").rowsBetween(-half, half)
    return trend.filter(F.col(value).isNotNull()).withColumn(
        "rolling_mean",
        F.when(F.count(value).over(frame) >= min_values, F.avg(value).over(frame)),
    )


def trend_year_class(trend: DataFrame, year_class: DataFrame) -> DataFrame:
    """Wet and dry years among those plotted."""
    marked = year_class.filter(F.col("classification").isin("wet", "dry"))
    years = trend.select("aoi", "year").distinct()
    return years.join(marked.select("aoi", "year", "classification"), ["aoi", "year"])


def year_class_summary(year_class: DataFrame, wet_from: float = 25.0, dry_to: float = -5.0) -> DataFrame:
    """Class and net score per year with the class limits and the score as signed text."""
    return year_class.select(
        "aoi",
        "year",
        "classification",
        "usdm_net_score",
        naming.signed_whole(F.col("usdm_net_score")).alias("score_text"),
        F.lit(wet_from).alias("wet_from"),
        F.lit(dry_to).alias("dry_to"),
    ).orderBy("aoi", "year")


def linear_trend(
    series: DataFrame, value: str, keys: Sequence[str] = SERIES, *, min_points: int = 3
) -> DataFrame:
    """Least-squares line over the years of each series, with the fitted values.

    Series with fewer than ``min_points`` years of data are dropped.
    """
    keys = list(keys)
    points = series.filter(F.col(value).isNotNull())
    lines = (
        points.groupBy(*keys)
        .agg(
            F.regr_count(value, "year").alias("n_years"),
            F.regr_slope(value, "year").alias("slope"),
            F.regr_intercept(value, "year").alias("intercept"),
        )
        .filter(F.col("n_years") >= min_points)
    )
    return points.join(lines, keys).withColumn(
        "fitted", F.col("slope") * F.col("year") + F.col("intercept")
    )
