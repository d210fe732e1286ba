"""Cross-tabulations of class layers by slope side and ecozone.

Cells are counted once per class, with one count per stratum combined before
the shuffle; everything after works on that table of at most a few hundred
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions import labels, terrain
from canopygrid.operators.strata import CELL_KM2

STRATA = ("whole", "south", "north", "neither")
SIDES = ("south", "north")


def _over_classes(total: Column) -> Column:
    """Sum over the rows of a count table, which has one row per class."""
    return total.over(Window.partitionBy(F.lit(0)))


def pct(part: Column, total: Column) -> Column:
    """Share in percent; 0 of nothing is 0."""
    return F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0))


def class_by_side(cells: DataFrame, code: str) -> DataFrame:
    """One row per class with its cells in each stratum: code, whole_px, south_px, ..."""
    side = terrain.aspect_side(F.col("aspect"))
    return cells.groupBy(F.col(code).alias("code")).agg(
        F.count("*").alias("whole_px"),
        *[F.count_if(side == s).alias(f"{s}_px") for s in STRATA[1:]],
    )


def with_totals(wide: DataFrame, *, forested_only: bool = False) -> DataFrame:
    """Adds the size of each stratum, or of its forested part (code not 0)."""
    counted = F.col("code") != 0 if forested_only else F.lit(True)
    zero = F.lit(0).cast("bigint")
    return wide.withColumns(
        {
            f"{s}_total": _over_classes(F.sum(F.when(counted, F.col(f"{s}_px")).otherwise(zero)))
            for s in STRATA
        }
    )


def crosstab_counts(cells: DataFrame, code: str, km2: float = CELL_KM2) -> DataFrame:
    """Long form: cells per stratum and class with the stratum's total and area."""
    wide = with_totals(class_by_side(cells, code))
    entry = lambda s: F.struct(
        F.lit(s).alias("stratum"), F.col(f"{s}_px").alias("px"), F.col(f"{s}_total").alias("total_px")
    )
    return wide.select("code", F.inline(F.array(*[entry(s) for s in STRATA]))).withColumn(
        "total_km2", F.col("total_px") * km2
    )


def composition(cells: DataFrame, code: str, kind: str, known: DataFrame, km2: float = CELL_KM2) -> DataFrame:
    """Count, area and share of each known class in each stratum.

    ``known`` lists the codes to report; the rest but non-forest is pooled as
    'Other/unknown'.
    """
    listed = known.select("code", F.lit(True).alias("__known"))
    counts = (
        crosstab_counts(cells, code)
        .join(listed, "code", "left")
        .withColumn("__known", F.coalesce("__known", F.lit(False)))
        .filter(F.col("__known") | (F.col("code") != 0))
    )
    label = F.when(F.col("__known"), F.col("__name")).otherwise(F.lit("Other/unknown"))
    return (
        labels.with_label(counts, kind, "code", "__name")
        .groupBy("stratum", label.alias("label"))
        .agg(F.sum("px").alias("px"), F.max("total_px").alias("total_px"))
        .withColumn("km2", F.col("px") * km2)
        .withColumn("pct", pct(F.col("px"), F.col("total_px")))
    )


def with_delta(wide: DataFrame, flag_above: float | None = None) -> DataFrame:
    """South and north shares, their difference in points and a flag for large ones."""
    out = wide.withColumns(
        {f"{s}_pct": pct(F.col(f"{s}_px"), F.col(f"{s}_total")) for s in SIDES}
    ).withColumn("delta", F.col("south_pct") - F.col("north_pct"))
    return out if flag_above is None else out.withColumn("flag", F.abs("delta") > flag_above)


def composition_delta(cells: DataFrame, code: str, kind: str, known: DataFrame, flag_above: float = 5) -> DataFrame:
    """South minus north share of each known class."""
    wide = with_delta(with_totals(class_by_side(cells, code)), flag_above)
    return labels.with_label(wide.join(known.select("code"), "code", "left_semi"), kind, "code")


def species_delta(
    cells: DataFrame, code: str = "forest_type", *, min_px: int = 1000, flag_above: float = 3
) -> DataFrame:
    """South minus north share of every forest type with enough cells, largest difference first."""
    wide = with_delta(with_totals(class_by_side(cells, code)), flag_above)
    enough = (F.col("code") != 0) & (F.col("south_px") + F.col("north_px") >= min_px)
    return labels.with_label(wide.filter(enough), "forest_type", "code").orderBy(
        F.abs("delta").desc(), "code"
    )


def subset_delta(
    cells: DataFrame, codes: Sequence[int] = labels.OAK_TYPES, code: str = "forest_type", flag_above: float = 3
) -> DataFrame:
    """Shares of chosen types among forested cells only; types that do not occur are 0."""
    zero = F.lit(0).cast("bigint")
    listed = cells.sparkSession.createDataFrame([(c,) for c in codes], "code int")
    counts = (
        class_by_side(cells, code)
        .unionByName(listed.withColumns({f"{s}_px": zero for s in STRATA}))
        .groupBy("code")
        .agg(*[F.sum(f"{s}_px").alias(f"{s}_px") for s in STRATA])
    )
    shares = with_delta(with_totals(counts, forested_only=True), flag_above)
    return labels.with_label(shares.filter(F.col("code").isin(*codes)), "forest_type", "code")


def ecozone_by_aspect(cells: DataFrame, km2: float = CELL_KM2) -> DataFrame:
    """Share of every ecozone that occurs, in each stratum."""
    zones = crosstab_counts(cells, "ecozone", km2).filter(F.col("code").isin(*labels.ECOZONE_NAMES))
    return labels.with_label(zones, "ecozone", "code").withColumn(
        "pct", pct(F.col("px"), F.col("total_px"))
    )


def ecozone_aspect_delta(cells: DataFrame, flag_above: float = 5) -> DataFrame:
    wide = with_delta(with_totals(class_by_side(cells, "ecozone")), flag_above)
    return labels.with_label(wide.filter(F.col("code").isin(*labels.ECOZONE_NAMES)), "ecozone", "code")


def group_by_zone(cells: DataFrame) -> DataFrame:
    """One row per forest group with its cells in each ecozone, and in all."""
    return cells.groupBy(F.col("forest_group").alias("code")).agg(
        F.count("*").alias("total_px"),
        *[F.count_if(F.col("ecozone") == z).alias(f"zone_{z}") for z in labels.ECOZONE_NAMES],
    )


def ecozone_by_forest(cells: DataFrame, known: DataFrame, km2: float = CELL_KM2) -> DataFrame:
    """Known forest groups in each ecozone that occurs, absent ones as 0, most frequent first."""
    zones = list(labels.ECOZONE_NAMES)
    totals = group_by_zone(cells).withColumns(
        {f"all_{z}": _over_classes(F.sum(f"zone_{z}")) for z in zones}
    )
    entry = lambda z: F.struct(
        F.lit(z).alias("ecozone"), F.col(f"zone_{z}").alias("px"), F.col(f"all_{z}").alias("zone_px")
    )
    out = (
        totals.join(known.select("code"), "code", "left_semi")
        .select(F.col("code").alias("forest_group"), F.inline(F.array(*[entry(z) for z in zones])))
        .filter("zone_px > 0")
        .withColumn("km2", F.col("px") * km2)
        .withColumn("pct", pct(F.col("px"), F.col("zone_px")))
    )
    return labels.with_label(out, "forest_group", "forest_group").orderBy(
        "ecozone", F.col("px").desc(), "forest_group"
    )


def forest_by_ecozone(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Share of each known forest group that lies in each ecozone."""
    shares = [
        pct(F.col(f"zone_{z}"), F.col("total_px")).alias(f"{name.lower()}_pct")
        for z, name in labels.ECOZONE_NAMES.items()
    ]
    out = (
        group_by_zone(cells)
        .join(known.select("code"), "code", "left_semi")
        .select(F.col("code").alias("forest_group"), "total_px", *shares)
    )
    return labels.with_label(out, "forest_group", "forest_group")


def side_shares(cells: DataFrame, code: str) -> DataFrame:
    return with_delta(with_totals(class_by_side(cells, code))).drop("delta")


def group_pct_by_aspect(cells: DataFrame) -> DataFrame:
    """Share of south and north cells per forest group."""
    return labels.with_label(
        side_shares(cells, "forest_group").filter(F.col("code") > 0), "forest_group", "code"
    )


def topk_species_by_aspect(cells: DataFrame, k: int = 8) -> DataFrame:
    """The most frequent forest types and their share of each side."""
    top = (
        side_shares(cells, "forest_type")
        .filter(F.col("code") != 0)
        .orderBy(F.col("whole_px").desc(), "code")
        .limit(k)
    )
    return labels.with_label(top, "forest_type", "code")


def class_contrast(cells: DataFrame, codes: Sequence[int] = (502, 505), code: str = "forest_type") -> DataFrame:
    """South and north shares of chosen types."""
    return labels.with_label(
        side_shares(cells, code).filter(F.col("code").isin(*codes)), "forest_type", "code"
    )
