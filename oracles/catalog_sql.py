"""Check SQL: sources, sinks and the scene catalog."""

from __future__ import annotations

from oracles.base import with_views as v

_DAY = "strftime({0}, '%Y-%m-%d')".format
_INVENTORY = f"""SELECT k.code, coalesce(l.label, concat('Code ', k.code)) AS label, px AS pixels, round(px * 0.0001::DOUBLE, 6) AS km2
FROM known_groups k LEFT JOIN group_labels l USING (code)"""
_MANIFEST = """SELECT concat(index_name, '_', item) AS scene_id, filename, concat(substring(day, 1, 4), '-', substring(day, 5, 2), '-', substring(day, 7, 2)) AS date,
    CASE WHEN item % 3 <> 0 THEN cloud_cover END AS cloud_cover, (item % 100) / 100.0::DOUBLE AS clear_frac, CAST(NULL AS DOUBLE) AS valid_frac,
    (item % 7) / 10.0::DOUBLE AS snow_frac, CAST(NULL AS DOUBLE) AS veg_coverage, CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS path_row,
    CASE WHEN item % 3 = 0 THEN 'again' ELSE 'first' END AS processed, CAST(NULL AS VARCHAR) AS rebuilt FROM manifest"""

_WINDOWS = """WITH b AS (SELECT CAST(min(obs_ts) AS DATE) + 13 AS a, CAST(max(obs_ts) AS DATE) AS e FROM stac),
w AS (SELECT CASE WHEN i = 0 THEN a ELSE CAST(date_trunc('month', a) + to_months(CAST(6 * i AS INT)) AS DATE) END AS ws,
             least(CAST(date_trunc('month', a) + to_months(CAST(6 * (i + 1) AS INT)) AS DATE), e) AS we
      FROM b CROSS JOIN generate_series(0, 400) AS g(i)),
win AS (SELECT ws, we FROM w WHERE ws < we)
"""

_SCENE_GROUP = """SELECT {0}, CAST(row_number() OVER (PARTITION BY {0} ORDER BY day, item) AS INT) AS rank, item, day, tile
FROM (SELECT *, CAST(year(obs_ts) AS INT) AS year, CAST(month(obs_ts) AS INT) AS month FROM scenes_s2)"""

SQL = {
    "scan_cells": v(
        """SELECT aoi, index_name, year, month, "row", "col", round(value, 6) AS value FROM cells WHERE aoi = 'north' AND index_name = 'NDVI'""",
        "cells",
    ),
    "scan_manifest": v(
        """SELECT concat(m.index_name, '_', m.item) AS scene_id, m.filename, strftime(m.obs_ts, '%Y-%m-%d') AS date, m.cloud_cover
        FROM manifest m JOIN (SELECT DISTINCT filename FROM outputs) o ON o.filename = m.filename""",
        "manifest",
        "outputs",
    ),
    "scan_stac_items": v(
        f"""SELECT scene_id, {_DAY('obs_ts')} AS date, cloud_cover, platform, wrs_path, wrs_row, x_min, y_max, concat('red/', item) AS red_href FROM stac""",
        "stac",
    ),
    "scan_year_class": v("SELECT aoi, year, classification, usdm_net_score FROM year_class", "year_class"),
    "scan_labels": v(
        """SELECT kind, c.code, coalesce(l.label, CASE WHEN kind = 'ecozone' THEN concat('Unknown (', c.code, ')') ELSE concat('Code ', c.code) END) AS label, px
        FROM (SELECT 'forest_group' AS kind, forest_group AS code, count(*) AS px FROM traits GROUP BY ALL
              UNION ALL SELECT 'forest_type', forest_type, count(*) FROM traits GROUP BY ALL
              UNION ALL SELECT 'ecozone', ecozone, count(*) FROM traits GROUP BY ALL) c
        LEFT JOIN (SELECT 'forest_group' AS kind, * FROM group_labels UNION ALL SELECT 'forest_type', * FROM type_labels
                   UNION ALL SELECT 'ecozone', * FROM zone_labels) l USING (kind, code)""",
        "traits",
        "group_labels",
        "type_labels",
        "zone_labels",
    ),
    "scan_inventory": v(_INVENTORY, "known_groups", "group_labels"),
    "scan_aoi": v(
        """SELECT landscape_id, aoi, ring, seq, round(x, 6) AS x, round(y, 6) AS y FROM vertices WHERE landscape_id = 'landscape south'""",
        "vertices",
    ),
    "sink_cells": v(
        """SELECT a.aoi, a.index_name, a.year, "row", "col", round(value, 6) AS value, scene_count
        FROM annual a JOIN (SELECT aoi, year, count(DISTINCT scene_id) AS scene_count FROM obs GROUP BY ALL) s USING (aoi, year)""",
        "annual",
    ),
    "sink_manifest": v(_MANIFEST, "manifest"),
    "sink_inventory": v(_INVENTORY, "known_groups", "group_labels"),
    "sink_table": v(
        """SELECT aoi, index_name, year, count(*) AS n_px, round(avg(d), 6) AS mean_anomaly, round(min(d), 6) AS min_anomaly, round(max(d), 6) AS max_anomaly
        FROM (SELECT *, value - avg(value) OVER (PARTITION BY aoi, index_name, "row", "col") AS d FROM annual) GROUP BY ALL""",
        "annual",
    ),
    "incremental_skip": v(
        """SELECT DISTINCT aoi, index_name, year, month FROM obs CROSS JOIN indices WHERE month % 4 = 0""", "obs", "indices"
    ),
    "search_windows": v(_WINDOWS + f"SELECT {_DAY('ws')} AS win_start, {_DAY('we')} AS win_end FROM win", "stac"),
    "search_windows_calendar": v(
        """SELECT strftime(s, '%Y-%m-%d') AS win_start, strftime(s + INTERVAL 6 MONTH, '%Y-%m-%d') AS win_end
        FROM (SELECT unnest(generate_series(CAST(date_trunc('year', min(obs_ts)) AS TIMESTAMP), CAST(date_trunc('year', max(obs_ts)) + INTERVAL 6 MONTH AS TIMESTAMP), INTERVAL 6 MONTH)) AS s FROM stac)
        WHERE s < TIMESTAMP '2001-05-01'""",
        "stac",
    ),
    "window_assign": v(
        _WINDOWS
        + f"""SELECT item, {_DAY('ws')} AS win_start, {_DAY('we')} AS win_end FROM stac JOIN win ON CAST(obs_ts AS DATE) >= ws AND CAST(obs_ts AS DATE) <= we""",
        "stac",
    ),
    "scene_union": v(
        """SELECT item, platform FROM stac WHERE coalesce(cloud_cover, 100) < 40
        UNION ALL SELECT item, platform FROM stac WHERE platform IN ('landsat-5', 'landsat-7', 'landsat-8', 'landsat-9')""",
        "stac",
    ),
    "footprint_intersects": v(
        """SELECT item, a.aoi FROM stac s JOIN (SELECT aoi, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vertices GROUP BY 1) a
        ON x_min <= x1 AND x_max >= x0 AND y_min <= y1 AND y_max >= y0""",
        "stac",
        "vertices",
    ),
    "footprint_polygons": v(
        """SELECT DISTINCT item, aoi FROM footprint_edges JOIN edges
            ON greatest(u1, u2) >= least(x1, x2) AND greatest(x1, x2) >= least(u1, u2) AND greatest(v1, v2) >= least(y1, y2) AND greatest(y1, y2) >= least(v1, v2)
            AND sign((u2 - u1) * (y1 - v1) - (v2 - v1) * (x1 - u1)) * sign((u2 - u1) * (y2 - v1) - (v2 - v1) * (x2 - u1)) <= 0
            AND sign((x2 - x1) * (v1 - y1) - (y2 - y1) * (u1 - x1)) * sign((x2 - x1) * (v2 - y1) - (y2 - y1) * (u2 - x1)) <= 0
        UNION SELECT item, aoi FROM (SELECT f.item, f.ring, e.aoi, count(*) AS n FROM footprints f, edges e
            WHERE seq = 0 AND (y1 > f.y) <> (y2 > f.y) AND f.x < (x2 - x1) * (f.y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL) WHERE n % 2 = 1
        UNION SELECT item, aoi FROM (SELECT e.item, a.ring, a.aoi, count(*) AS n FROM vertices a, footprint_edges e
            WHERE seq = 0 AND (v1 > a.y) <> (v2 > a.y) AND a.x < (u2 - u1) * (a.y - v1) / nullif(v2 - v1, 0) + u1 GROUP BY ALL) WHERE n % 2 = 1""",
        "footprint_edges",
        "edges",
        "vertices",
    ),
    "cloud_filter": v("SELECT item, cloud_cover FROM stac WHERE coalesce(cloud_cover, 100) < 40", "stac"),
    "platform_filter": v(
        "SELECT item, platform FROM stac WHERE platform IN ('landsat-5', 'landsat-7', 'landsat-8', 'landsat-9')", "stac"
    ),
    "date_range_filter": v(
        """SELECT item, strftime(obs_ts, '%Y%m%d') AS day FROM stac WHERE CAST(obs_ts AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1999-12-31'""",
        "stac",
    ),
    "tile_id": v("SELECT item, scene_id, tile AS tile_id FROM stac_named", "stac_named"),
    "path_row": v(
        """SELECT item, concat(coalesce(wrs_path, '?'), coalesce(wrs_row, '?')) AS path_row,
        concat('p', coalesce(wrs_path, '?'), 'r', coalesce(wrs_row, '?')) AS path_row_text FROM stac""",
        "stac",
    ),
    "scene_dedup": v("SELECT item, day, tile AS tile_id FROM scenes_s2", "scenes_s2"),
    "scene_dedup_path_row": v(
        """SELECT item, day, path_row FROM (SELECT *, row_number() OVER (PARTITION BY day, path_row ORDER BY obs_ts, item) AS rn
        FROM (SELECT *, concat(coalesce(wrs_path, '?'), coalesce(wrs_row, '?')) AS path_row FROM stac_named
              WHERE coalesce(cloud_cover, 100) < 40 AND platform IN ('landsat-5', 'landsat-7', 'landsat-8', 'landsat-9'))) WHERE rn = 1""",
        "stac_named",
    ),
    "cache_inventory": v(
        """SELECT index_name, count(*) FILTER (filename IN (SELECT filename FROM outputs)) AS cached,
        count(*) FILTER (filename NOT IN (SELECT filename FROM outputs)) AS needed FROM scene_index GROUP BY 1""",
        "scene_index",
        "outputs",
    ),
    "cache_audit": v(
        """SELECT s.index_name, s.day, s.tile AS tile_id, s.cloud_cover, CASE WHEN o.have IS NOT NULL THEN 'present' ELSE 'missing' END AS status
        FROM scene_index s LEFT JOIN (SELECT DISTINCT filename, 1 AS have FROM outputs) o ON o.filename = s.filename""",
        "scene_index",
        "outputs",
    ),
    "manifest_heal": v(
        """WITH wanted AS MATERIALIZED (SELECT index_name, item, k, filename, day, cloud_cover FROM scene_index),
        lists AS (
            SELECT index_name, filename, item, day, NULL AS cloud_cover, 0 AS stored, 0 AS listed FROM wanted
            UNION ALL SELECT index_name, filename, NULL, NULL, NULL, 1, 0 FROM wanted WHERE (item + k) % 3 <> 0
            UNION ALL SELECT index_name, filename, item, day, cloud_cover, 0, 1 FROM wanted WHERE (item * 7 + k) % 5 <> 0)
        SELECT index_name, max(item) AS item, filename, max(day) AS day, max(cloud_cover) AS cloud_cover,
            CASE max(stored) * 2 + max(listed) WHEN 3 THEN 'kept' WHEN 2 THEN 'healed' WHEN 1 THEN 'redownload' ELSE 'new' END AS status
        FROM lists GROUP BY index_name, filename""",
        "scene_index",
    ),
    "manifest_rebuild": v(
        """SELECT s.aoi, i.index_name, s.scene_id, c.valid_px, round(c.valid_px / CAST(g.n_cells AS DOUBLE), 6) AS veg_coverage, c.valid_px IS NULL AS missing
        FROM scenes s CROSS JOIN indices i JOIN grid_cells g USING (aoi)
        LEFT JOIN (SELECT aoi, index_name, scene_id, count(*) AS valid_px FROM cells GROUP BY ALL) c ON c.aoi = s.aoi AND c.scene_id = s.scene_id AND c.index_name = i.index_name""",
        "scenes",
        "indices",
        "grid_cells",
        "cells",
    ),
    "year_floor": v("SELECT item, CAST(year(obs_ts) AS INT) AS year FROM stac WHERE year(obs_ts) >= 1997", "stac"),
    "available_years": v("SELECT DISTINCT year FROM obs WHERE month <> 2 AND year >= 1997", "obs"),
    "scene_group_year": v(_SCENE_GROUP.format("year"), "scenes_s2"),
    "scene_group_month": v(_SCENE_GROUP.format("year, month"), "scenes_s2"),
}
