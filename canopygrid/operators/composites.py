"""Maximum composites, baselines and anomalies per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.model import INDICES
from canopygrid.operators.pixels import to_long

LAYER = ("aoi", "index_name")
CELL = ("row", "col")


def max_composite(cells: DataFrame, period: Sequence[str] = ("year",), cell: Sequence[str] = CELL) -> DataFrame:
    """Highest value per cell and period.

    The maximum is combined before the shuffle. Cells without any value are
    absent, so a period with none leaves no layer.
    """
    return (
        cells.filter(B.finite(F.col("value")))
        .groupBy(*LAYER, *period, *cell)
        .agg(F.max("value").alias("value"))
    )


def max_composite_wide(
    cells: DataFrame,
    period: Sequence[str] = ("year",),
    cell: Sequence[str] = CELL,
    indices: Sequence[str] = INDICES,
) -> DataFrame:
    """The same from cells with a column per index: one row a cell is shuffled, and opened up afterwards."""
    keys = ["aoi", *period, *cell]
    highest = cells.groupBy(*keys).agg(*[F.max(F.when(B.finite(F.col(i)), F.col(i))).alias(i) for i in indices])
    return to_long(highest, keys, indices).select(*LAYER, *period, *cell, "value")


def composite_metadata(
    composites: DataFrame, scenes: DataFrame, grid_cells: DataFrame, period: Sequence[str] = ("year",)
) -> DataFrame:
    """Scene count, platforms and valid share of the whole grid for each layer.

    ``scenes`` has one row per (aoi, scene_id, platform) with the period's
    columns. Layers without a valid cell are not listed.
    """
    by_period = scenes.groupBy("aoi", *period).agg(
        F.count_distinct("scene_id").alias("scene_count"),
        # Bounded by the number of satellites.
        F.array_join(F.array_sort(F.collect_set("platform")), "/").alias("platforms"),
    )
    valid = composites.groupBy(*LAYER, *period).agg(F.count("*").alias("valid_px"))
    return (
        valid.join(by_period, ["aoi", *period])
        .join(grid_cells, "aoi")
        .withColumn("valid_pct", F.col("valid_px") * 100.0 / F.col("n_cells"))
        .drop("n_cells")
    )


def baseline_mean(annual: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Mean of the annual composites per cell."""
    return annual.groupBy(*LAYER, *cell).agg(
        F.avg("value").alias("baseline"), F.count("value").alias("n_years")
    )


def neutral_years(annual: DataFrame, year_class: DataFrame, classification: str = "neutral") -> DataFrame:
    """Composites of the years an area was classed as ``classification``."""
    wanted = year_class.filter(F.col("classification") == classification).select("aoi", "year")
    return annual.join(wanted, ["aoi", "year"], "left_semi")


def baseline_neutral(annual: DataFrame, year_class: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    return baseline_mean(neutral_years(annual, year_class), cell)


def anomaly(annual: DataFrame, year_class: DataFrame | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """Composite minus baseline per cell and year.

    The baseline is the mean of all years, or with ``year_class`` of the
    neutral ones. A window over the years of a cell does both in one shuffle;
    it holds one row a year. Cells without a baseline are absent.
    """
    base = F.col("value")
    if year_class is not None:
        classes = year_class.filter(F.col("classification") == "neutral").select(
            "aoi", "year", F.lit(True).alias("__neutral")
        )
        annual = annual.join(classes, ["aoi", "year"], "left")
        base = F.when(F.col("__neutral"), base)
    years = Window.partitionBy(*LAYER, *cell)
    return (
        annual.withColumn("baseline", F.avg(base).over(years))
        .filter(F.col("baseline").isNotNull())
        .withColumn("anomaly", F.col("value") - F.col("baseline"))
        .drop("__neutral")
    )


def anomaly_stats(anomalies: DataFrame) -> DataFrame:
    """Mean, lowest and highest anomaly per layer year."""
    return anomalies.groupBy(*LAYER, "year").agg(
        F.count("anomaly").alias("n_px"),
        F.avg("anomaly").alias("mean_anomaly"),
        F.min("anomaly").alias("min_anomaly"),
        F.max("anomaly").alias("max_anomaly"),
    )
