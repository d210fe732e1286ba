"""Check SQL: zonal percentiles, time series and cross-tabulations."""

from __future__ import annotations

from oracles.base import side_counts
from oracles.base import with_views as v

_SCENE = "aoi, index_name, scene_id, year, month"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_PEAK = """SELECT aoi, index_name, ecozone, count(p95) AS n_scenes, avg(p95) AS p95, avg(p99) AS p99, avg(p100) AS p100, pixel_count
FROM (SELECT * FROM (SELECT DISTINCT aoi, index_name FROM scene_p) CROSS JOIN zones) f
JOIN (SELECT ecozone, count(*) AS pixel_count FROM traits GROUP BY 1) USING (ecozone) LEFT JOIN scene_p s USING (aoi, index_name, ecozone) GROUP BY ALL"""


def _wide(source: str, keys: str, columns) -> str:
    """One row per keys, a column per index and statistic."""
    picks = ", ".join(
        (f"max({c}) FILTER (index_name = '{i}')" if c == "n_scenes" else f"round(max({c}) FILTER (index_name = '{i}'), 6)")
        + f' AS "{i}_{c}"'
        for i in ("NDVI", "NDMI", "EVI")
        for c in columns
    )
    return f"SELECT {keys}, {picks} FROM ({source}) GROUP BY {keys}"


def _pairs(source: str, keys: str, extra: str = "") -> str:
    return f"""SELECT {keys}, round(ndvi, 6) AS ndvi, round(ndmi, 6) AS ndmi{extra} FROM (
    SELECT {keys}, max(p95) FILTER (index_name = 'NDVI') AS ndvi, max(p95) FILTER (index_name = 'NDMI') AS ndmi FROM ({source}) GROUP BY {keys})
    WHERE ndvi IS NOT NULL AND ndmi IS NOT NULL"""


_SEASON = "CASE WHEN month BETWEEN 4 AND 9 THEN 'growing' WHEN month = 10 THEN 'excluded' ELSE 'dormant' END"

_ELEV_DIFF = f"""WITH long AS (SELECT {_SCENE}, stratum, 'p50' AS percentile, p50 AS v FROM elev_p UNION ALL SELECT {_SCENE}, stratum, 'p75', p75 FROM elev_p
    UNION ALL SELECT {_SCENE}, stratum, 'p90', p90 FROM elev_p),
d AS (SELECT {_SCENE}, percentile, max(v) FILTER (stratum = 'low') AS low, max(v) FILTER (stratum = 'high') AS high FROM long GROUP BY ALL)
"""

_DELTA = """SELECT code, label, south_px, north_px, round(sp, 6) AS south_pct, round(np, 6) AS north_pct, round(sp - np, 6) AS delta, abs(sp - np) > 1 AS flag
FROM (SELECT c.code, coalesce(l.label, concat('{1}', c.code)) AS label, south_px, north_px,
    coalesce(south_px * 100.0::DOUBLE / nullif(south_total, 0), 0) AS sp, coalesce(north_px * 100.0::DOUBLE / nullif(north_total, 0), 0) AS np
  FROM ({0}) c LEFT JOIN {2} l USING (code)) {3}"""

_SHARES = """SELECT c.code, coalesce(l.label, concat('Code ', c.code)) AS label, whole_px,
    round(coalesce(south_px * 100.0::DOUBLE / nullif(south_total, 0), 0), 6) AS south_pct, round(coalesce(north_px * 100.0::DOUBLE / nullif(north_total, 0), 0), 6) AS north_pct
FROM ({0}) c LEFT JOIN {1} l USING (code)"""

_OAK_SIDES = """SELECT o.code, count(s.side) FILTER (side = 'south') AS south_px, count(s.side) FILTER (side = 'north') AS north_px,
    (SELECT count(*) FROM sided WHERE side = 'south' AND forest_type <> 0) AS south_total, (SELECT count(*) FROM sided WHERE side = 'north' AND forest_type <> 0) AS north_total
FROM (VALUES (501), (502), (503), (504), (505), (506), (510), (515)) AS o(code) LEFT JOIN sided s ON s.forest_type = o.code GROUP BY 1"""

_COMPOSITION = """SELECT * FROM (SELECT stratum, CASE WHEN k.code IS NULL THEN 'Other/unknown' ELSE coalesce(l.label, concat('Code ', c.code)) END AS label,
    CAST(sum(c.px) AS BIGINT) AS px, any_value(total_px) AS total_px, round(sum(c.px) * 0.0001::DOUBLE, 6) AS km2, round(coalesce(sum(c.px) * 100.0::DOUBLE / nullif(any_value(total_px), 0), 0), 6) AS pct
FROM (SELECT s.stratum, g.code, count(b.stratum) AS px, (SELECT count(*) FROM by_side x WHERE x.stratum = s.stratum) AS total_px
      FROM strata_names s CROSS JOIN (SELECT DISTINCT forest_group AS code FROM traits) g LEFT JOIN by_side b ON b.stratum = s.stratum AND b.forest_group = g.code GROUP BY 1, 2) c
LEFT JOIN known_groups k USING (code) LEFT JOIN group_labels l USING (code) WHERE k.code IS NOT NULL OR c.code <> 0 GROUP BY 1, 2) WHERE label {0} 'Other/unknown'"""

_BY_ZONE = """SELECT z.ecozone, k.code AS forest_group, count(t.ecozone) AS px, (SELECT count(*) FROM traits x WHERE x.ecozone = z.ecozone) AS zone_px
FROM zones z CROSS JOIN known_groups k LEFT JOIN traits t ON t.ecozone = z.ecozone AND t.forest_group = k.code GROUP BY 1, 2"""

SQL = {
    "zonal_percentiles": v(f"SELECT {_SCENE}, ecozone, n, {_r('p95', 'p99', 'p100')} FROM scene_p", "scene_p"),
    "zonal_percentiles_colocated": v(
        f"""SELECT {_SCENE}, ecozone, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS p100
        FROM cells JOIN area_traits USING (aoi, "row", "col") WHERE ecozone IN (1, 2, 3) GROUP BY {_SCENE}, ecozone HAVING count(*) >= 30""",
        "cells",
        "area_traits",
    ),
    "zonal_whole_aoi": v(
        f"""SELECT {_SCENE}, count(*) AS n, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM cells GROUP BY {_SCENE}""",
        "cells",
    ),
    "peak_productivity": v(
        f"SELECT aoi, index_name, ecozone, n_scenes, pixel_count, {_r('p95', 'p99', 'p100')} FROM ({_PEAK})", "scene_p", "traits", "zones"
    ),
    "peak_productivity_landsat": v(
        f"""WITH p AS (SELECT {_SCENE}, ecozone, quantile_cont(value, 0.95) AS a, quantile_cont(value, 0.99) AS b, max(value) AS c
              FROM cells_landsat JOIN traits USING ("row", "col") WHERE ecozone IN (1, 2, 3) GROUP BY {_SCENE}, ecozone HAVING count(*) >= 5)
        SELECT aoi, index_name, ecozone, count(a) AS n_scenes, pixel_count, round(avg(a), 6) AS p95, round(avg(b), 6) AS p99, round(avg(c), 6) AS p100
        FROM (SELECT * FROM (SELECT DISTINCT aoi, index_name FROM p) CROSS JOIN zones) f
        JOIN (SELECT ecozone, count(*) AS pixel_count FROM traits GROUP BY 1) USING (ecozone) LEFT JOIN p USING (aoi, index_name, ecozone) GROUP BY ALL""",
        "cells_landsat",
        "traits",
        "zones",
    ),
    "peak_summary_wide": v(_wide(_PEAK, "aoi, ecozone, pixel_count", ("p95", "p99", "p100")), "scene_p", "traits", "zones"),
    "ecological_space": v(
        _pairs("SELECT aoi, index_name, ecozone, avg(p95) AS p95 FROM scene_p GROUP BY ALL", "aoi, ecozone"), "scene_p"
    ),
    "seasonal_curves": v(f"SELECT aoi, index_name, month, ecozone, n_scenes, {_r('p95', 'p100')} FROM curves", "curves"),
    "seasonal_scene_count": v(
        "SELECT aoi, index_name, month, max(n_scenes) AS n_scenes FROM curves GROUP BY ALL", "curves"
    ),
    "seasonal_band": v(
        f"SELECT aoi, index_name, month, ecozone, n_scenes, {_r('p95', 'p100')} FROM curves WHERE p95 IS NOT NULL AND p100 IS NOT NULL", "curves"
    ),
    "seasonal_sync": v(_pairs("SELECT * FROM curves", "aoi, month, ecozone"), "curves"),
    "drought_response": v(
        f"SELECT aoi, index_name, classification, ecozone, n_scenes, {_r('p95', 'p99', 'p100')} FROM response", "response"
    ),
    "drought_scene_counts": v(
        """SELECT aoi, classification, CAST(sum(n) AS BIGINT) AS n_scenes, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years
        FROM (SELECT aoi, classification, year, count(*) AS n FROM scenes JOIN year_class USING (aoi, year) GROUP BY ALL) GROUP BY 1, 2""",
        "scenes",
        "year_class",
    ),
    "unclassified_scenes": v(
        "SELECT aoi, count(*) AS n_scenes FROM scenes WHERE (aoi, year) NOT IN (SELECT aoi, year FROM year_class) GROUP BY 1",
        "scenes",
        "year_class",
    ),
    "drought_space": v(
        f"""SELECT p.*, CAST(c.step AS INT) AS step FROM ({_pairs("SELECT * FROM response", "aoi, ecozone, classification")}) p JOIN classes c USING (classification)""",
        "response",
    ),
    "drought_table_wide": v(
        _wide("SELECT * FROM response", "aoi, classification, ecozone", ("n_scenes", "p95", "p99", "p100")), "response"
    ),
    "year_class_summary": v(
        """SELECT aoi, year, classification, usdm_net_score, printf('%+.0f', usdm_net_score) AS score_text, 25.0::DOUBLE AS wet_from, -5.0::DOUBLE AS dry_to FROM year_class""",
        "year_class",
    ),
    "season_partition": v(f"SELECT aoi, {_SEASON} AS season, count(*) AS n_scenes FROM scenes GROUP BY 1, 2", "scenes"),
    "moisture_amplitude": v(
        f"""SELECT aoi, ecozone, {_r('growing_p95', 'dormant_p95')}, round(growing_p95 - dormant_p95, 6) AS amplitude, growing_scenes, dormant_scenes
        FROM (SELECT f.aoi, f.ecozone, avg(p95) FILTER ({_SEASON} = 'growing') AS growing_p95, avg(p95) FILTER ({_SEASON} = 'dormant') AS dormant_p95
              FROM (SELECT * FROM (SELECT DISTINCT aoi FROM scene_p WHERE index_name = 'NDMI') CROSS JOIN zones) f
              LEFT JOIN (SELECT * FROM scene_p WHERE index_name = 'NDMI') s ON s.aoi = f.aoi AND s.ecozone = f.ecozone GROUP BY 1, 2)
        JOIN (SELECT aoi, count(*) FILTER ({_SEASON} = 'growing') AS growing_scenes, count(*) FILTER ({_SEASON} = 'dormant') AS dormant_scenes FROM scenes GROUP BY 1) USING (aoi)""",
        "scene_p",
        "scenes",
        "zones",
    ),
    "zonal_median_monthly": v("SELECT aoi, index_name, year, month, ecozone, n, round(p50, 6) AS p50 FROM medians", "medians"),
    "season_mean": v(
        """SELECT aoi, index_name, CAST(year + 1 AS INT) AS year, ecozone, round(avg(p50), 6) AS december FROM medians WHERE month = 12 GROUP BY ALL""",
        "medians",
    ),
    "seasonal_amplitude": v(
        f"SELECT aoi, index_name, year, ecozone, {_r('summer', 'winter', 'amplitude')} FROM amplitude", "amplitude"
    ),
    "amplitude_trend": v(
        """SELECT aoi, index_name, ecozone, year, n_years, round(slope, 6) AS slope, round(slope * year + intercept, 6) AS fitted
        FROM amplitude JOIN (SELECT aoi, index_name, ecozone, regr_count(amplitude, year)::BIGINT AS n_years, regr_slope(amplitude, year) AS slope, regr_intercept(amplitude, year) AS intercept
            FROM amplitude GROUP BY 1, 2, 3 HAVING regr_count(amplitude, year) >= 3) USING (aoi, index_name, ecozone) WHERE amplitude IS NOT NULL""",
        "amplitude",
    ),
    "longterm_trend": v("SELECT aoi, index_name, ecozone, year, round(p95, 6) AS p95, n_scenes FROM trend", "trend"),
    "trend_range": v(
        """SELECT aoi, index_name, ecozone, count(p95) AS n_years, round(min(p95), 6) AS min_p95, round(max(p95), 6) AS max_p95 FROM trend GROUP BY 1, 2, 3""",
        "trend",
    ),
    "rolling_mean_5": v(
        """SELECT aoi, index_name, ecozone, year, round(p95, 6) AS p95, n_scenes, CASE WHEN count(*) OVER w >= 3 THEN round(avg(p95) OVER w, 6) END AS rolling_mean
        FROM trend WHERE p95 IS NOT NULL WINDOW w AS (PARTITION BY aoi, index_name, ecozone ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        "trend",
    ),
    "trend_year_class": v(
        "SELECT aoi, year, classification FROM year_class WHERE classification IN ('wet', 'dry')", "year_class"
    ),
    "elevation_gradient": v(
        """WITH bands AS (SELECT CAST(floor(elevation / 200) * 200 AS INT) AS lo, count(*) AS n_px FROM traits WHERE elevation < (SELECT ceil(max(elevation) / 200) * 200 FROM traits) GROUP BY 1 HAVING count(*) >= 50),
        p AS (SELECT aoi, index_name, scene_id, lo, quantile_cont(value, 0.95) AS p95 FROM cells JOIN traits USING ("row", "col") JOIN bands ON lo = floor(elevation / 200) * 200 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
        SELECT a.aoi, b.lo, CAST(b.lo + 200 AS INT) AS hi, CAST(b.lo + 100 AS DOUBLE) AS mid, n_px, round(avg(p95) FILTER (index_name = 'NDVI'), 6) AS "NDVI_p95",
            round(avg(p95) FILTER (index_name = 'NDMI'), 6) AS "NDMI_p95", round(avg(p95) FILTER (index_name = 'EVI'), 6) AS "EVI_p95"
        FROM (SELECT DISTINCT aoi FROM p) a CROSS JOIN bands b LEFT JOIN p ON p.aoi = a.aoi AND p.lo = b.lo GROUP BY a.aoi, b.lo, n_px""",
        "cells",
        "traits",
    ),
    "aspect_series": v(f"SELECT {_SCENE}, {_r('whole', 'south', 'north')} FROM sides_p", "sides_p"),
    "aspect_diff": v(f"SELECT {_SCENE}, round(south - north, 6) AS diff FROM sides_p", "sides_p"),
    "aspect_diff_both": v(
        f"""SELECT {_SCENE}, round(CASE WHEN sn >= 30 AND nn >= 30 THEN s - n END, 6) AS diff
        FROM (SELECT {_SCENE}, quantile_cont(value, 0.75) FILTER (side = 'south') AS s, quantile_cont(value, 0.75) FILTER (side = 'north') AS n,
            count(*) FILTER (side = 'south') AS sn, count(*) FILTER (side = 'north') AS nn FROM cells JOIN sided USING ("row", "col") GROUP BY {_SCENE}) WHERE sn >= 30 OR nn >= 30""",
        "cells",
        "sided",
    ),
    "aspect_summary": v(
        "SELECT aoi, index_name, "
        + ", ".join(f"round(avg({e}), 6) AS {n}_mean, round(stddev_pop({e}), 6) AS {n}_std" for n, e in (("whole", "whole"), ("south", "south"), ("north", "north"), ("diff", "south - north")))
        + " FROM sides_p GROUP BY 1, 2",
        "sides_p",
    ),
    "aspect_verdict": v(
        """SELECT aoi, index_name, round(d, 6) AS diff_mean, CASE WHEN d < -0.005 THEN 'LOWER' WHEN d > 0.005 THEN 'HIGHER' WHEN d IS NOT NULL THEN 'NONE' END AS verdict
        FROM (SELECT aoi, index_name, avg(south - north) AS d FROM sides_p GROUP BY 1, 2)""",
        "sides_p",
    ),
    "strata_percentiles": v(
        f"""SELECT {_SCENE}, stratum, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90
        FROM (SELECT c.*, s.stratum FROM cells c JOIN by_side s USING ("row", "col") WHERE s.stratum <> 'neither') GROUP BY {_SCENE}, stratum HAVING stratum = 'whole' OR count(*) > 30""",
        "cells",
        "by_side",
    ),
    "elevation_percentiles": v(f"SELECT {_SCENE}, stratum, n, {_r('p50', 'p75', 'p90')} FROM elev_p", "elev_p"),
    "elevation_diff": v(
        _ELEV_DIFF
        + """SELECT aoi, index_name, percentile, round(avg(high - low), 6) AS diff_mean, round(stddev_pop(high - low), 6) AS diff_std FROM d WHERE high - low IS NOT NULL GROUP BY 1, 2, 3""",
        "elev_p",
    ),
    "elevation_diff_series": v(
        _ELEV_DIFF + f"SELECT {_SCENE}, percentile, {_r('low', 'high')}, round(high - low, 6) AS diff FROM d WHERE high - low IS NOT NULL",
        "elev_p",
    ),
    "crosstab_counts": v(
        """SELECT s.stratum, g.code, count(b.stratum) AS px, any_value(t.n) AS total_px, round(any_value(t.n) * 0.0001::DOUBLE, 6) AS total_km2
        FROM strata_names s CROSS JOIN (SELECT DISTINCT forest_group AS code FROM traits) g JOIN (SELECT stratum, count(*) AS n FROM by_side GROUP BY 1) t ON t.stratum = s.stratum
        LEFT JOIN by_side b ON b.stratum = s.stratum AND b.forest_group = g.code GROUP BY 1, 2""",
        "by_side",
        "strata_names",
    ),
    "composition_pct": v(_COMPOSITION.format("<>"), "by_side", "strata_names", "known_groups", "group_labels"),
    "other_unknown": v(_COMPOSITION.format("="), "by_side", "strata_names", "known_groups", "group_labels"),
    "composition_delta": v(
        _DELTA.format(side_counts("forest_group"), "Code ", "group_labels", "WHERE code IN (SELECT code FROM known_groups)"),
        "sided",
        "known_groups",
        "group_labels",
    ),
    "species_delta": v(
        _DELTA.format(side_counts("forest_type"), "Code ", "type_labels", "WHERE code <> 0 AND south_px + north_px >= 50"), "sided", "type_labels"
    ),
    "subset_delta": v(_DELTA.format(_OAK_SIDES, "Code ", "type_labels", ""), "sided", "type_labels"),
    "ecozone_by_aspect": v(
        """SELECT c.*, l.label, round(c.total_px * 0.0001::DOUBLE, 6) AS total_km2, round(coalesce(px * 100.0::DOUBLE / nullif(total_px, 0), 0), 6) AS pct
        FROM (SELECT s.stratum, z.ecozone AS code, count(b.stratum) AS px, (SELECT count(*) FROM by_side x WHERE x.stratum = s.stratum) AS total_px
              FROM strata_names s CROSS JOIN zones z LEFT JOIN by_side b ON b.stratum = s.stratum AND b.ecozone = z.ecozone
              WHERE z.ecozone IN (SELECT ecozone FROM traits) GROUP BY 1, 2) c JOIN zone_labels l USING (code)""",
        "by_side",
        "strata_names",
        "zones",
        "zone_labels",
    ),
    "ecozone_aspect_delta": v(
        _DELTA.format(side_counts("ecozone"), "Code ", "zone_labels", "WHERE code IN (1, 2, 3)"), "sided", "zone_labels"
    ),
    "ecozone_by_forest": v(
        f"""SELECT b.*, coalesce(l.label, concat('Code ', forest_group)) AS label, round(px * 0.0001::DOUBLE, 6) AS km2, round(px * 100.0::DOUBLE / zone_px, 6) AS pct
        FROM ({_BY_ZONE}) b LEFT JOIN group_labels l ON l.code = forest_group WHERE zone_px > 0""",
        "zones",
        "known_groups",
        "group_labels",
        "traits",
    ),
    "forest_by_ecozone": v(
        """SELECT forest_group, count(*) AS total_px, coalesce(any_value(l.label), concat('Code ', forest_group)) AS label,
        round(count(*) FILTER (ecozone = 1) * 100.0::DOUBLE / count(*), 6) AS cool_pct, round(count(*) FILTER (ecozone = 2) * 100.0::DOUBLE / count(*), 6) AS intermediate_pct,
        round(count(*) FILTER (ecozone = 3) * 100.0::DOUBLE / count(*), 6) AS hot_pct
        FROM traits LEFT JOIN group_labels l ON l.code = forest_group WHERE forest_group IN (SELECT code FROM known_groups) GROUP BY 1""",
        "traits",
        "known_groups",
        "group_labels",
    ),
    "group_pct_by_aspect": v(
        _SHARES.format(side_counts("forest_group"), "group_labels") + " WHERE c.code > 0", "sided", "group_labels"
    ),
    "topk_species_by_aspect": v(
        _SHARES.format(side_counts("forest_type"), "type_labels") + " WHERE c.code <> 0 ORDER BY whole_px DESC, c.code LIMIT 8", "sided", "type_labels"
    ),
    "class_contrast": v(
        _SHARES.format(side_counts("forest_type"), "type_labels") + " WHERE c.code IN (502, 505)", "sided", "type_labels"
    ),
}

SQL["zonal_median_monthly_kept"] = SQL["zonal_median_monthly"]
