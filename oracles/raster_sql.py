"""Check SQL: pixel functions, grids, terrain, strata and composites."""

from __future__ import annotations

from oracles.base import CLEAR_LANDSAT, evi
from oracles.base import with_views as v

_KEYS = 'aoi, scene_id, year, month, "row", "col"'
_BANDS = ("blue", "red", "nir", "swir")
_SHORT = dict(zip(_BANDS, ("b", "r", "n", "s")))
_DN_OK = " AND ".join(f"{b} > 0 AND {b} < 10000" for b in _BANDS)
_VALID = f"{_DN_OK} AND scl NOT IN (8, 9, 10, 11)"
_REFL_OK = " AND ".join(f"{c} IS NOT NULL" for c in "nrsb")

_S2_ALL = """s2_all AS (SELECT *, nir / 10000.0::DOUBLE AS n, red / 10000.0::DOUBLE AS r, swir / 10000.0::DOUBLE AS s, blue / 10000.0::DOUBLE AS b FROM obs)"""


def _index(expression: str) -> str:
    return v(
        f"""WITH {_S2_ALL}
        SELECT 'sentinel-2' AS sensor, {_KEYS}, round({expression}, 6) AS value FROM s2_all
        UNION ALL SELECT 'landsat', {_KEYS}, round({expression}, 6) FROM scaled_landsat""",
        "obs",
        "scaled_landsat",
    )


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"


_INDEX = {"NDVI": _ratio("n", "r"), "NDMI": _ratio("n", "s"), "EVI": evi("n", "r", "b")}

_FRACTIONS = f"""WITH f AS (
SELECT 'sentinel-2' AS sensor, aoi, scene_id, "row", "col", in_aoi, scl = 11 AS snow, {_VALID} AS clear FROM flagged_obs
UNION ALL
SELECT 'landsat', aoi, scene_id, "row", "col", in_aoi, (qa & 32) <> 0, {CLEAR_LANDSAT} AND {_REFL_OK} FROM scaled_landsat JOIN flagged USING (aoi, "row", "col")),
a AS (SELECT aoi, count(*) AS px FROM flagged WHERE in_aoi GROUP BY 1)
SELECT sensor, f.aoi, scene_id, max(px) AS area_px, count(DISTINCT CASE WHEN in_aoi AND {{0}} THEN "row" * 1000 + "col" END) AS {{0}}_px,
    round(count(DISTINCT CASE WHEN in_aoi AND {{0}} THEN "row" * 1000 + "col" END) / CAST(max(px) AS DOUBLE), 4) AS {{0}}_frac
FROM f JOIN a USING (aoi) GROUP BY 1, 2, 3"""

_GRADIENT = """WITH g AS (SELECT "row", "col",
    CASE WHEN lag(elevation) OVER h IS NULL THEN (lead(elevation) OVER h - elevation) / {0}
         WHEN lead(elevation) OVER h IS NULL THEN (elevation - lag(elevation) OVER h) / {0}
         ELSE (lead(elevation) OVER h - lag(elevation) OVER h) / (2 * {0}) END AS dx,
    CASE WHEN lag(elevation) OVER w IS NULL THEN (lead(elevation) OVER w - elevation) / {0}
         WHEN lead(elevation) OVER w IS NULL THEN (elevation - lag(elevation) OVER w) / {0}
         ELSE (lead(elevation) OVER w - lag(elevation) OVER w) / (2 * {0}) END AS dy
    FROM traits WINDOW h AS (PARTITION BY "row" ORDER BY "col"), w AS (PARTITION BY "col" ORDER BY "row")),
s AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, 90 - degrees(atan2(-dy, dx)) AS bearing FROM g)
"""

_GROUPS = """SELECT c.code AS forest_group, px, coalesce(l.label, concat('Code ', c.code)) AS label, round(px * 0.0001::DOUBLE, 6) AS km2
FROM (SELECT forest_group AS code, count(*) AS px FROM traits WHERE forest_group <> 0 GROUP BY 1) c LEFT JOIN group_labels l USING (code) WHERE px {0} 50"""

_HISTOGRAM = """SELECT c.code AS {0}, px, coalesce(l.label, concat('Code ', c.code)) AS label, round(px * 0.0001::DOUBLE, 6) AS km2,
    round(px * 100.0::DOUBLE / sum(px) OVER (), 6) AS pct, l.label IS NOT NULL AS known
FROM (SELECT {0} AS code, count(*) AS px FROM traits GROUP BY 1) c LEFT JOIN {1} l USING (code)"""

_MASKS = {
    "south_facing": "aspect >= 135 AND aspect <= 225",
    "north_facing": "aspect >= 315 OR aspect <= 45",
    "steep_slopes": "slope > 15",
    "elev_low": "elevation < 175",
    "elev_mid": "elevation >= 175 AND elevation < 300",
    "elev_high": "elevation >= 300",
    "ecozone_1": "ecozone = 1",
    "ecozone_2": "ecozone = 2",
    "ecozone_3": "ecozone = 3",
}

_AUDIT = ", ".join(
    f"""count(*) FILTER ({t}) AS {n}_px, round(min(aspect) FILTER ({t}), 6) AS {n}_aspect_min, round(max(aspect) FILTER ({t}), 6) AS {n}_aspect_max,
    round(min(slope) FILTER ({t}), 6) AS {n}_slope_min, round(max(slope) FILTER ({t}), 6) AS {n}_slope_max, round(avg(slope) FILTER ({t}), 6) AS {n}_slope_mean"""
    for n, t in (("south", _MASKS["south_facing"]), ("north", _MASKS["north_facing"]))
)

_BASELINE_KEYS = 'aoi, index_name, "row", "col"'

SQL = {
    "scale_s2": v(
        f"SELECT {_KEYS}, " + ", ".join(f"round({b} / 10000.0::DOUBLE, 9) AS {b}" for b in _BANDS) + " FROM obs", "obs"
    ),
    "scale_landsat": v(
        f"SELECT {_KEYS}, " + ", ".join(f"round({_SHORT[b]}, 12) AS {b}" for b in _BANDS) + " FROM scaled_landsat",
        "scaled_landsat",
    ),
    "valid_dn": v(f"SELECT {_KEYS}, {_DN_OK} AS valid FROM obs", "obs"),
    "valid_reflectance": v(f"SELECT {_KEYS}, {_REFL_OK} AS valid FROM scaled_landsat", "scaled_landsat"),
    "scl_mask": v(f"SELECT {_KEYS}, scl, scl NOT IN (8, 9, 10, 11) AS clear FROM obs", "obs"),
    "qa_bitmask": v(f"SELECT {_KEYS}, qa, {CLEAR_LANDSAT} AS clear FROM obs", "obs"),
    "ndvi": _index(_INDEX["NDVI"]),
    "ndmi": _index(_INDEX["NDMI"]),
    "evi": _index(_INDEX["EVI"]),
    "index_dispatch": v(
        f"""SELECT {_KEYS}, 'NDVI' AS index_name, round({_INDEX['NDVI']}, 6) AS value FROM scaled_landsat WHERE {CLEAR_LANDSAT} AND n IS NOT NULL AND r IS NOT NULL AND n + r <> 0
        UNION ALL SELECT {_KEYS}, 'EVI', round({_INDEX['EVI']}, 6) FROM scaled_landsat WHERE {CLEAR_LANDSAT} AND n IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL""",
        "scaled_landsat",
    ),
    "combined_mask": v(
        f"""SELECT {_KEYS}, """
        + ", ".join(f"CASE WHEN ok THEN round({e}, 6) END AS \"{i}\"" for i, e in _INDEX.items())
        + f""" FROM (SELECT *, in_aoi AND {_VALID} AS ok, nir / 10000.0::DOUBLE AS n, red / 10000.0::DOUBLE AS r, swir / 10000.0::DOUBLE AS s, blue / 10000.0::DOUBLE AS b FROM flagged_obs)""",
        "flagged_obs",
    ),
    "aoi_mask": v('SELECT aoi, "row", "col", in_aoi FROM flagged', "flagged"),
    "class_fill_outside": v(f"SELECT {_KEYS}, CASE WHEN in_aoi THEN scl ELSE 0 END AS scl FROM flagged_obs", "flagged_obs"),
    "snow_fraction": v(_FRACTIONS.format("snow"), "flagged_obs", "scaled_landsat"),
    "clear_fraction": v(_FRACTIONS.format("clear"), "flagged_obs", "scaled_landsat"),
    "valid_predicate": v(
        "SELECT aoi, year, count(*) FILTER (scl <> 5) AS n_not_nan, count(*) FILTER (scl NOT IN (5, 6)) AS n_finite FROM obs GROUP BY 1, 2",
        "obs",
    ),
    "canonical_grid": v(
        """SELECT aoi, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max,
        round((x_max - x_min) / width, 6) AS dx, round((y_max - y_min) / height, 6) AS dy, width, height
        FROM (SELECT *, CAST(floor((x_max - x_min) / 0.7::DOUBLE) AS INT) AS width, CAST(floor((y_max - y_min) / 0.7::DOUBLE) AS INT) AS height
              FROM (SELECT aoi, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM vertices GROUP BY 1))""",
        "vertices",
    ),
    "aoi_area": v(
        """SELECT aoi, round(sum(CASE WHEN ring = 0 THEN a ELSE -a END) / 1e6, 9) AS area_km2
        FROM (SELECT aoi, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM edges GROUP BY 1, 2) GROUP BY 1""",
        "edges",
    ),
    "bbox_share": v(
        """SELECT aoi, count(*) AS n_cells, count(*) FILTER (in_aoi) AS n_inside, round(count(*) FILTER (in_aoi) / CAST(count(*) AS DOUBLE), 6) AS inside_share FROM flagged GROUP BY 1""",
        "flagged",
    ),
    "cell_centers": v(
        """SELECT "row", "col", 300000.0::DOUBLE + ("col" + 0.5::DOUBLE) * 10 AS x, 4300000.0::DOUBLE - ("row" + 0.5::DOUBLE) * 10 AS y FROM traits""",
        "traits",
    ),
    "regrid_nearest": v(
        """SELECT CAST(t."row" // 3 AS INT) AS "row", CAST(t."col" // 3 AS INT) AS "col", s.ecozone
        FROM traits t LEFT JOIN traits s ON s."row" = t."row" + 1 AND s."col" = t."col" + 1 WHERE t."row" % 3 = 0 AND t."col" % 3 = 0""",
        "traits",
    ),
    "regrid_bilinear": v(
        """SELECT t.fr AS "row", t.fc AS "col", round(sum(w * s.elevation) / sum(CASE WHEN s.elevation IS NOT NULL THEN w END), 6) AS elevation
        FROM (SELECT CAST("row" * 2 + i AS INT) AS fr, CAST("col" * 2 + j AS INT) AS fc,
                CAST("row" + a * (CASE WHEN i = 0 THEN -1 ELSE 1 END) AS INT) AS sr, CAST("col" + b * (CASE WHEN j = 0 THEN -1 ELSE 1 END) AS INT) AS sc,
                (CASE WHEN a = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) * (CASE WHEN b = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) AS w
              FROM traits CROSS JOIN (VALUES (0), (1)) AS i(i) CROSS JOIN (VALUES (0), (1)) AS j(j) CROSS JOIN (VALUES (0), (1)) AS a(a) CROSS JOIN (VALUES (0), (1)) AS b(b)) t
        LEFT JOIN traits s ON s."row" = sr AND s."col" = sc GROUP BY 1, 2""",
        "traits",
    ),
    "dem_mosaic": v(
        """SELECT "row", "col", round(avg(elevation), 6) AS elevation FROM (SELECT "row", "col", elevation FROM traits WHERE "col" < 30
        UNION ALL SELECT "row", "col", elevation + slope FROM traits WHERE "col" >= 20) GROUP BY 1, 2""",
        "traits",
    ),
    "gradient_xy": v(_GRADIENT.format("10.0::DOUBLE") + 'SELECT "row", "col", round(dx, 6) AS dx, round(dy, 6) AS dy FROM g', "traits"),
    "slope": v(_GRADIENT.format("10.0::DOUBLE") + 'SELECT "row", "col", round(slope, 6) AS slope FROM s', "traits"),
    "aspect": v(
        _GRADIENT.format("1000.0::DOUBLE")
        + 'SELECT "row", "col", CASE WHEN slope >= 2 THEN round(CASE WHEN bearing < 0 THEN bearing + 360 ELSE bearing END, 6) END AS aspect FROM s',
        "traits",
    ),
    "raster_stats": v(
        """SELECT count(*) AS n_cells, count(elevation) AS n_valid, min(elevation) AS "min", max(elevation) AS "max", round(avg(elevation), 6) AS mean,
        round(quantile_cont(elevation, 0.25), 6) AS p25, round(quantile_cont(elevation, 0.5), 6) AS p50, round(quantile_cont(elevation, 0.75), 6) AS p75,
        round(count(elevation) / CAST(count(*) AS DOUBLE), 6) AS valid_share, min(elevation) < 0 AS has_negative FROM traits""",
        "traits",
    ),
    "alignment_check": v(
        """WITH l AS (SELECT layer, CAST(split_part(layer, '#', 2) AS INT) AS n, max("row") + 1 AS h, (SELECT max("row") + 1 FROM traits) AS eh FROM traits GROUP BY 1),
        i AS (SELECT layer, list_filter([CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 'crs' END, CASE WHEN (n % 3) * 0.008 > 0.01 THEN 'resolution' END,
            CASE WHEN h <> eh THEN 'shape' END, CASE WHEN n % 4 = 0 OR h <> eh THEN 'origin' END], lambda x : x IS NOT NULL) AS found FROM l)
        SELECT layer, array_to_string(found, ',') AS issues, CAST(len(found) AS INT) AS n_issues FROM i""",
        "traits",
    ),
    "aspect_strata": v('SELECT "row", "col", side FROM sided', "sided"),
    "aspect_strata_slope5": v(
        """SELECT "row", "col", CASE WHEN slope >= 5 THEN side ELSE 'neither' END AS side FROM sided""", "sided"
    ),
    "steep_mask": v('SELECT "row", "col", slope > 15 AS steep FROM traits', "traits"),
    "elev_bands_fixed": v(
        """SELECT "row", "col", CASE WHEN elevation < 175 THEN 'low' WHEN elevation < 300 THEN 'mid' ELSE 'high' END AS band FROM traits""", "traits"
    ),
    "elev_bands_positive": v(
        """SELECT "row", "col", CASE WHEN e <= 0 THEN NULL WHEN e < 175 THEN 'low' WHEN e < 300 THEN 'mid' ELSE 'high' END AS band FROM (SELECT *, elevation - 80 AS e FROM traits)""",
        "traits",
    ),
    "elev_bands_uniform": v(
        """SELECT CAST(lo AS INT) AS lo, CAST(lo + 200 AS INT) AS hi, CAST(lo + 100 AS DOUBLE) AS mid, count(*) AS n_px
        FROM (SELECT b * 200 AS lo, elevation FROM traits, generate_series(0, 20) AS g(b) WHERE elevation >= b * 200 AND elevation < (b + 1) * 200)
        WHERE lo < (SELECT ceil(max(elevation) / 200) * 200 FROM traits) GROUP BY lo HAVING count(*) >= 50""",
        "traits",
    ),
    "forest_group_strata": v(_GROUPS.format(">="), "traits", "group_labels"),
    "skipped_groups": v(_GROUPS.format("<"), "traits", "group_labels"),
    "ecozone_strata": v(
        """SELECT ecozone, count(*) AS px, label FROM traits JOIN zone_labels ON ecozone = code GROUP BY 1, 3""", "traits", "zone_labels"
    ),
    "mask_coverage": v(
        " UNION ALL ".join(
            f"SELECT '{m}' AS mask, count(*) FILTER ({t}) AS px, round(count(*) FILTER ({t}) * 0.0001::DOUBLE, 6) AS km2 FROM traits"
            for m, t in _MASKS.items()
        ),
        "traits",
    ),
    "mask_overlap_audit": v(
        f"SELECT count(*) FILTER (({_MASKS['south_facing']}) AND ({_MASKS['north_facing']})) AS overlap_px, {_AUDIT} FROM traits", "traits"
    ),
    "class_histogram": v(_HISTOGRAM.format("forest_group", "group_labels"), "traits", "group_labels"),
    "class_topk": v(
        _HISTOGRAM.format("forest_type", "type_labels") + " ORDER BY px DESC, c.code LIMIT 15", "traits", "type_labels"
    ),
    "annual_max": v('SELECT aoi, index_name, year, "row", "col", round(value, 6) AS value FROM annual', "annual"),
    "monthly_max": v('SELECT aoi, index_name, year, month, "row", "col", round(value, 6) AS value FROM monthly', "monthly"),
    "composite_drop_empty": v(
        """SELECT aoi, index_name, year, month, count(*) AS valid_px FROM monthly GROUP BY ALL""", "monthly"
    ),
    "composite_metadata": v(
        """SELECT a.aoi, a.index_name, a.year, valid_px, scene_count, platforms, round(valid_px * 100.0::DOUBLE / n_cells, 6) AS valid_pct
        FROM (SELECT aoi, index_name, year, count(*) AS valid_px FROM annual GROUP BY ALL) a
        JOIN (SELECT aoi, year, count(DISTINCT scene_id) AS scene_count, array_to_string(list_sort(list_distinct(list(platform))), '/') AS platforms FROM obs GROUP BY ALL) s USING (aoi, year)
        JOIN grid_cells USING (aoi)""",
        "annual",
        "grid_cells",
    ),
    "baseline_mean": v(
        f"SELECT {_BASELINE_KEYS}, round(avg(value), 6) AS baseline, count(*) AS n_years FROM annual GROUP BY ALL", "annual"
    ),
    "baseline_neutral": v(
        f"""SELECT {_BASELINE_KEYS}, round(avg(value), 6) AS baseline, count(*) AS n_years FROM annual
        WHERE (aoi, year) IN (SELECT aoi, year FROM year_class WHERE classification = 'neutral') GROUP BY ALL""",
        "annual",
        "year_class",
    ),
    "anomaly": v(
        f"""SELECT a.aoi, a.index_name, a.year, a."row", a."col", round(b, 6) AS baseline, round(value - b, 6) AS anomaly
        FROM annual a JOIN (SELECT {_BASELINE_KEYS}, avg(value) AS b FROM annual
            WHERE (aoi, year) IN (SELECT aoi, year FROM year_class WHERE classification = 'neutral') GROUP BY ALL) n USING ({_BASELINE_KEYS})""",
        "annual",
        "year_class",
    ),
    "anomaly_stats": v(
        f"""SELECT aoi, index_name, year, count(*) AS n_px, round(avg(d), 6) AS mean_anomaly, round(min(d), 6) AS min_anomaly, round(max(d), 6) AS max_anomaly
        FROM (SELECT *, value - avg(value) OVER (PARTITION BY {_BASELINE_KEYS}) AS d FROM annual) GROUP BY ALL""",
        "annual",
    ),
    "acquired_date": v(
        """SELECT DISTINCT CASE month WHEN 3 THEN concat(year, '_03.tif') WHEN 5 THEN concat(year, '_13') WHEN 8 THEN 'mosaic' WHEN 9 THEN CAST(year AS VARCHAR)
            ELSE concat(year, '_', lpad(CAST(month AS VARCHAR), 2, '0')) END AS name,
        CASE WHEN month IN (5, 8) THEN NULL WHEN month = 9 THEN concat(year, '-07-01') ELSE concat(year, '-', lpad(CAST(month AS VARCHAR), 2, '0'), '-15') END AS acquired FROM obs""",
        "obs",
    ),
}

# What is kept up to date is what would be made anew.
SQL["annual_max_kept"] = SQL["annual_max"]
SQL["baseline_neutral_kept"] = SQL["baseline_neutral"]
SQL["inside_area"] = v(
    """SELECT aoi, scene_id, year, month, "row", "col", round(nir, 6) AS nir FROM flagged_obs WHERE in_aoi""", "flagged_obs"
)
