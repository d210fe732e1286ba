"""Identifiers and dates carried in names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_id(scene_id: Column) -> Column:
    """First six-letter part starting with T, e.g. T17SPB, else 'unknown'."""
    parts = F.filter(F.split(scene_id, "_"), lambda p: p.startswith("T") & (F.length(p) == 6))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("unknown"))


def path_row(path: Column, row: Column) -> Column:
    return F.concat(F.coalesce(path, F.lit("?")), F.coalesce(row, F.lit("?")))


def path_row_display(path: Column, row: Column) -> Column:
    return F.concat(
        F.lit("p"), F.coalesce(path, F.lit("?")), F.lit("r"), F.coalesce(row, F.lit("?"))
    )


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def layer_file(index_name: Column, day: Column, tile: Column) -> Column:
    return F.concat(index_name, F.lit("_"), day, F.lit("_"), tile, F.lit(".tif"))


def layer_name(year: Column, month: Column | None = None) -> Column:
    """'2017' for an annual layer, '2017_07' for a monthly one."""
    if month is None:
        return year.cast("string")
    return F.concat(year.cast("string"), F.lit("_"), F.lpad(month.cast("string"), 2, "0"))


def layer_year(name: Column) -> Column:
    """Leading year of a layer name, null when it is not a number."""
    head = F.split(name, "_").getItem(0)
    return F.when(head.rlike("^[0-9]+$"), head.cast("int"))


def acquired_date(name: Column) -> Column:
    """Stand-in date of a layer: the 15th of its month, or 1 July of its year."""
    stem = F.trim(F.regexp_replace(name, r"\.tif", ""))
    month = F.regexp_extract(stem, r"^([0-9]{1,4})_([0-9]{1,2})$", 2)
    year = F.regexp_extract(stem, r"^([0-9]{1,4})(_[0-9]{1,2})?$", 1)
    text = F.concat_ws(
        "-",
        F.lpad(year, 4, "0"),
        F.when(month == "", F.lit("07")).otherwise(F.lpad(month, 2, "0")),
        F.when(month == "", F.lit("01")).otherwise(F.lit("15")),
    )
    return F.when(year != "", F.try_to_date(text, "yyyy-MM-dd"))


def signed_whole(score: Column) -> Column:
    return F.format_string("%+.0f", score)
