"""Views shared by the check queries, as DuckDB common table expressions."""

from __future__ import annotations

from canopygrid.functions import labels
from canopygrid.plans.fixtures import FOOTPRINT, FOOTPRINT_HOLE, HOLE


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


def _names(names: dict) -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return ", ".join(f"({code}, {quoted(text)})" for code, text in names.items())


VALID_S2 = (
    "nir > 0 AND nir < 10000 AND red > 0 AND red < 10000 AND swir > 0 AND swir < 10000 "
    "AND blue > 0 AND blue < 10000 AND scl NOT IN (8, 9, 10, 11)"
)
CLEAR_LANDSAT = "(qa & 46) = 0"

_EVI = (
    "CASE WHEN {n} + 6.0::DOUBLE * {r} - 7.5::DOUBLE * {b} + 1.0::DOUBLE <> 0 "
    "THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 2.5::DOUBLE * ({n} - {r}) / ({n} + 6.0::DOUBLE * {r} - 7.5::DOUBLE * {b} + 1.0::DOUBLE))) "
    "WHEN {b} IS NULL THEN NULL WHEN {n} - {r} <> 0 THEN sign({n} - {r})::DOUBLE END"
)


def evi(n: str, r: str, b: str) -> str:
    return _EVI.format(n=n, r=r, b=b)


# view -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "traits": (
        (),
        """SELECT CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS "col",
            CAST(p_size * 40 AS DOUBLE) AS elevation, CAST(p_size % 30 AS DOUBLE) AS slope,
            CASE WHEN p_size % 30 >= 2 THEN CAST((p_partkey * 37) % 360 AS DOUBLE) END AS aspect,
            CAST(p_size % 4 AS INT) AS ecozone,
            CAST(CASE WHEN p_size = 13 THEN 900 WHEN p_type = 'ECONOMY' THEN 0 WHEN p_type = 'STANDARD' THEN 500
                 WHEN p_type = 'MEDIUM' THEN 400 WHEN p_type = 'PROMO' THEN 100 WHEN p_type = 'LARGE' THEN 800 ELSE 998 END AS INT) AS forest_group,
            CAST(CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 11 = 0 THEN 999 ELSE 500 + p_size % 17 END AS INT) AS forest_type,
            p_brand AS layer
        FROM part""",
    ),
    "area_traits": (
        ("traits",),
        """SELECT 'north' AS aoi, "row", "col", ecozone FROM traits
        UNION ALL SELECT 'south', "row", CAST(49 - "col" AS INT), ecozone FROM traits""",
    ),
    "sided": (
        ("traits",),
        """SELECT *, CASE WHEN aspect >= 135 AND aspect <= 225 THEN 'south'
                 WHEN aspect >= 315 OR aspect <= 45 THEN 'north' ELSE 'neither' END AS side FROM traits""",
    ),
    "obs": (
        (),
        """SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'north' ELSE 'south' END AS aoi,
            CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS scene_id,
            CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
            CAST(l_partkey // 50 AS INT) AS "row", CAST(l_partkey % 50 AS INT) AS "col",
            l_extendedprice / 10 AS nir, l_quantity * 100 AS red, l_tax * 10000 AS swir, l_discount * 10000 AS blue,
            CAST(l_linenumber + 4 AS INT) AS scl, CAST(1 << CAST(l_linenumber - 1 AS INT) AS INT) AS qa,
            CASE WHEN l_linestatus = 'F' THEN 'landsat-5' ELSE 'landsat-8' END AS platform
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    ),
    "refl": (
        ("obs",),
        f"""SELECT aoi, scene_id, year, month, "row", "col", nir / 10000.0::DOUBLE AS n, red / 10000.0::DOUBLE AS r,
            swir / 10000.0::DOUBLE AS s, blue / 10000.0::DOUBLE AS b
        FROM obs WHERE {VALID_S2}""",
    ),
    "cells": (
        ("refl",),
        f"""SELECT aoi, 'NDVI' AS index_name, scene_id, year, month, "row", "col", (n - r) / (n + r) AS value FROM refl
        UNION ALL SELECT aoi, 'NDMI', scene_id, year, month, "row", "col", (n - s) / (n + s) FROM refl
        UNION ALL SELECT aoi, 'EVI', scene_id, year, month, "row", "col", {evi('n', 'r', 'b')} FROM refl""",
    ),
    "dn_landsat": (
        ("obs",),
        """SELECT * REPLACE (nir * 5 AS nir, red * 8 AS red, swir * 30 + 7000 AS swir, blue * 20 + 7000 AS blue) FROM obs""",
    ),
    "scaled_landsat": (
        ("dn_landsat",),
        """SELECT *, CASE WHEN sn >= 0 AND sn <= 1 THEN sn END AS n, CASE WHEN sr >= 0 AND sr <= 1 THEN sr END AS r,
            CASE WHEN ss >= 0 AND ss <= 1 THEN ss END AS s, CASE WHEN sb >= 0 AND sb <= 1 THEN sb END AS b
        FROM (SELECT *, nir * 0.0000275::DOUBLE + -0.2::DOUBLE AS sn, red * 0.0000275::DOUBLE + -0.2::DOUBLE AS sr,
            swir * 0.0000275::DOUBLE + -0.2::DOUBLE AS ss, blue * 0.0000275::DOUBLE + -0.2::DOUBLE AS sb FROM dn_landsat)""",
    ),
    "cells_landsat": (
        ("scaled_landsat",),
        f"""SELECT * FROM (
        SELECT aoi, 'NDVI' AS index_name, scene_id, year, month, "row", "col", CASE WHEN n + r <> 0 THEN (n - r) / (n + r) END AS value, n, r, s, b, qa FROM scaled_landsat
        UNION ALL SELECT aoi, 'NDMI', scene_id, year, month, "row", "col", CASE WHEN n + s <> 0 THEN (n - s) / (n + s) END, n, r, s, b, qa FROM scaled_landsat
        UNION ALL SELECT aoi, 'EVI', scene_id, year, month, "row", "col", {evi('n', 'r', 'b')}, n, r, s, b, qa FROM scaled_landsat)
        WHERE {CLEAR_LANDSAT} AND n IS NOT NULL AND r IS NOT NULL AND s IS NOT NULL AND b IS NOT NULL AND value IS NOT NULL""",
    ),
    "scenes": (("obs",), "SELECT DISTINCT aoi, scene_id, year, month FROM obs"),
    "layer_years": (
        ("obs",),
        """SELECT DISTINCT aoi, i AS index_name, year FROM obs CROSS JOIN (VALUES ('NDVI'), ('NDMI'), ('EVI')) AS v(i)""",
    ),
    "zone_cells": (
        ("cells", "traits"),
        """SELECT c.*, t.ecozone FROM cells c JOIN traits t USING ("row", "col") WHERE t.ecozone IN (1, 2, 3)""",
    ),
    "scene_p": (
        ("zone_cells",),
        """SELECT aoi, index_name, scene_id, year, month, ecozone, count(*) AS n, quantile_cont(value, 0.95) AS p95,
            quantile_cont(value, 0.99) AS p99, quantile_cont(value, 1.0) AS p100
        FROM zone_cells GROUP BY ALL HAVING count(*) >= 30""",
    ),
    "zones": ((), "SELECT * FROM (VALUES (1), (2), (3)) AS z(ecozone)"),
    "aois": ((), "SELECT * FROM (VALUES ('north'), ('south')) AS a(aoi)"),
    "indices": ((), "SELECT * FROM (VALUES ('NDVI'), ('NDMI'), ('EVI')) AS i(index_name)"),
    "classes": ((), "SELECT * FROM (VALUES ('wet', 1), ('neutral', 2), ('dry', 3)) AS c(classification, step)"),
    "year_class": (
        ("scenes",),
        """SELECT aoi, year, CASE (year + k) % 4 WHEN 0 THEN 'wet' WHEN 1 THEN 'neutral' WHEN 2 THEN 'dry' END AS classification,
            CAST((year * 37 + k * 11) % 80 - 30 AS DOUBLE) AS usdm_net_score
        FROM (SELECT DISTINCT aoi, year, CASE WHEN aoi = 'north' THEN 0 ELSE 1 END AS k FROM scenes) WHERE (year + k) % 4 < 3""",
    ),
    "stac": (
        (),
        """SELECT o_orderkey AS item, o_orderdate AS obs_ts,
            CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) END AS cloud_cover,
            CASE WHEN o_orderkey % 23 = 0 THEN 'S2A_MSIL2A_NOTILE' WHEN o_orderkey % 29 = 0 THEN 'S2A_MSIL2A_T17SPAXX_T17S'
                 WHEN o_orderkey % 31 = 0 THEN concat('S2A_T1_MSIL2A_T17SP', substring('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1), '_T18TWL')
                 ELSE concat('S2A_MSIL2A_', CAST(year(o_orderdate) AS VARCHAR), '_T17SP', substring('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1)) END AS scene_id,
            CASE o_orderstatus WHEN 'F' THEN 'landsat-5' WHEN 'O' THEN 'landsat-8' ELSE 'landsat-4' END AS platform,
            CASE WHEN o_orderkey % 19 <> 0 THEN CAST(16 + o_custkey % 3 AS VARCHAR) END AS wrs_path,
            CAST(34 + o_custkey % 2 AS VARCHAR) AS wrs_row,
            CAST(o_custkey % 97 AS DOUBLE) AS x_min, CAST(o_custkey % 97 + 10 AS DOUBLE) AS x_max,
            CAST(-(o_orderkey % 89) - 10 AS DOUBLE) AS y_min, CAST(-(o_orderkey % 89) AS DOUBLE) AS y_max
        FROM orders""",
    ),
    "stac_named": (
        ("stac",),
        """SELECT *, strftime(obs_ts, '%Y%m%d') AS day,
            coalesce(list_filter(string_split(scene_id, '_'), lambda p: starts_with(p, 'T') AND length(p) = 6)[1], 'unknown') AS tile FROM stac""",
    ),
    "scenes_s2": (
        ("stac_named",),
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY day, tile ORDER BY obs_ts, item) AS rn
        FROM stac_named WHERE coalesce(cloud_cover, 100) < 40) WHERE rn = 1""",
    ),
    "scene_index": (
        ("scenes_s2",),
        """SELECT s.*, index_name, k, concat(index_name, '_', day, '_', tile, '.tif') AS filename
        FROM scenes_s2 s CROSS JOIN (VALUES ('NDVI', 0), ('NDMI', 1), ('EVI', 2)) AS v(index_name, k)""",
    ),
    "outputs": (("scene_index",), "SELECT * FROM scene_index WHERE (item + k) % 3 <> 0"),
    "manifest": (("scene_index",), "SELECT * FROM scene_index WHERE (item * 7 + k) % 5 <> 0"),
    "extent": ((), "SELECT CAST(max(p_partkey) // 50 + 1 AS INT) AS height FROM part"),
    "vertices": (
        ("extent",),
        f"""SELECT concat('landscape ', aoi) AS landscape_id, aoi, CAST(ring AS INT) AS ring, CAST(seq AS INT) AS seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (
        SELECT aoi, 0 AS ring, r + 1 AS seq, 25 + sign * k AS x, -(r + 0.3::DOUBLE) AS y
            FROM (SELECT p_partkey // 50 AS r, sum(p_size) % 20 AS k FROM part GROUP BY 1) CROSS JOIN (VALUES ('north', 1), ('south', -1)) AS s(aoi, sign)
        UNION ALL SELECT aoi, 0, CASE n WHEN 0 THEN 0 ELSE height + n END, x, CASE n WHEN 1 THEN -height + 0.2::DOUBLE ELSE -0.1::DOUBLE END
            FROM extent CROSS JOIN (VALUES ('north', 5), ('south', 45)) AS s(aoi, x) CROSS JOIN (VALUES (0), (1), (2)) AS n(n)
        UNION ALL SELECT 'south', 1, seq, x, -height * CAST(share AS DOUBLE) FROM extent CROSS JOIN (VALUES {_values((i, *h) for i, h in enumerate(HOLE))}) AS h(seq, x, share))""",
    ),
    "edges": (
        ("vertices",),
        """SELECT * FROM (SELECT aoi, ring, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
        FROM vertices WINDOW w AS (PARTITION BY aoi, ring ORDER BY seq)) WHERE x2 IS NOT NULL""",
    ),
    "footprints": (
        ("stac",),
        f"""SELECT item, ring, seq, x0 + cx * size AS x, y0 + cy * size AS y
        FROM (SELECT item, x_min / 2 AS x0, y_min / 2 AS y0, CASE WHEN item % 3 = 0 THEN (x_max - x_min) / 40 ELSE (x_max - x_min) / 10 END AS size FROM stac)
        CROSS JOIN (VALUES {_values((r, i, *c) for r, ring in enumerate((FOOTPRINT, FOOTPRINT_HOLE)) for i, c in enumerate(ring))}) AS c(ring, seq, cx, cy)
        WHERE ring = 0 OR item % 5 = 0""",
    ),
    "footprint_edges": (
        ("footprints",),
        """SELECT * FROM (SELECT item, ring, x AS u1, y AS v1, lead(x) OVER w AS u2, lead(y) OVER w AS v2
        FROM footprints WINDOW w AS (PARTITION BY item, ring ORDER BY seq)) WHERE u2 IS NOT NULL""",
    ),
    "flagged": (
        ("traits", "edges"),
        """SELECT c.aoi, c."row", c."col", sum(CASE WHEN ((y1 > c.y) <> (y2 > c.y)) AND c.x < (x2 - x1) * (c.y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS in_aoi
        FROM (SELECT a.aoi, t."row", t."col", t."col" + 0.5::DOUBLE AS x, -(t."row" + 0.5::DOUBLE) AS y
              FROM traits t CROSS JOIN (VALUES ('north'), ('south')) AS a(aoi)) c
        JOIN edges USING (aoi) GROUP BY 1, 2, 3""",
    ),
    "flagged_obs": (
        ("obs", "flagged"),
        """SELECT o.*, f.in_aoi FROM obs o JOIN flagged f USING (aoi, "row", "col")""",
    ),
    "group_labels": ((), f"SELECT * FROM (VALUES {_names(labels.FOREST_GROUPS)}) AS l(code, label)"),
    "type_labels": ((), f"SELECT * FROM (VALUES {_names(labels.FOREST_TYPES)}) AS l(code, label)"),
    "zone_labels": ((), f"SELECT * FROM (VALUES {_names(labels.ECOZONE_NAMES)}) AS l(code, label)"),
    "known_groups": (
        ("traits",),
        """SELECT forest_group AS code, count(*) AS px FROM traits WHERE forest_group <> 0 GROUP BY 1 HAVING count(*) >= 50""",
    ),
    "annual": (
        ("cells",),
        """SELECT aoi, index_name, year, "row", "col", max(value) AS value FROM cells GROUP BY ALL""",
    ),
    "monthly": (
        ("cells",),
        """SELECT aoi, index_name, year, month, "row", "col", max(value) AS value FROM cells GROUP BY ALL""",
    ),
    "medians": (
        ("monthly", "area_traits"),
        """SELECT aoi, index_name, year, month, ecozone, count(*) AS n, quantile_cont(value, 0.5) AS p50
        FROM monthly JOIN area_traits USING (aoi, "row", "col") WHERE ecozone IN (1, 2, 3) GROUP BY ALL HAVING count(*) >= 30""",
    ),
    "amplitude": (
        ("medians", "layer_years", "zones"),
        """SELECT aoi, index_name, year, ecozone, su AS summer, coalesce((de + jf) / 2, de, jf) AS winter,
            su - coalesce((de + jf) / 2, de, jf) AS amplitude
        FROM (SELECT l.*, z.ecozone,
            (SELECT avg(p50) FROM medians m WHERE m.aoi = l.aoi AND m.index_name = l.index_name AND m.ecozone = z.ecozone AND m.year = l.year AND m.month IN (6, 7, 8)) AS su,
            (SELECT avg(p50) FROM medians m WHERE m.aoi = l.aoi AND m.index_name = l.index_name AND m.ecozone = z.ecozone AND m.year = l.year - 1 AND m.month = 12) AS de,
            (SELECT avg(p50) FROM medians m WHERE m.aoi = l.aoi AND m.index_name = l.index_name AND m.ecozone = z.ecozone AND m.year = l.year AND m.month IN (1, 2)) AS jf
        FROM layer_years l CROSS JOIN zones z)""",
    ),
    "trend": (
        ("layer_years", "scene_p", "zones"),
        """SELECT l.aoi, l.index_name, z.ecozone, l.year, avg(p95) AS p95, count(p95) AS n_scenes
        FROM layer_years l CROSS JOIN zones z LEFT JOIN scene_p s ON s.aoi = l.aoi AND s.index_name = l.index_name AND s.year = l.year AND s.ecozone = z.ecozone
        GROUP BY 1, 2, 3, 4""",
    ),
    "response": (
        ("classes", "zones", "scene_p", "year_class"),
        """SELECT f.*, count(s.p95) AS n_scenes, avg(s.p95) AS p95, avg(s.p99) AS p99, avg(s.p100) AS p100
        FROM (SELECT * FROM (SELECT DISTINCT aoi, index_name FROM scene_p JOIN year_class USING (aoi, year)) CROSS JOIN classes CROSS JOIN zones) f
        LEFT JOIN (SELECT scene_p.*, classification FROM scene_p JOIN year_class USING (aoi, year)) s USING (aoi, index_name, classification, ecozone)
        GROUP BY ALL""",
    ),
    "curves": (
        ("zones", "scene_p"),
        """SELECT f.*, count(s.p95) AS n_scenes, avg(s.p95) AS p95, avg(s.p100) AS p100
        FROM (SELECT aoi, index_name, CAST(m AS INT) AS month, ecozone FROM (SELECT DISTINCT aoi, index_name FROM scene_p) CROSS JOIN zones CROSS JOIN generate_series(1, 12) AS g(m)) f
        LEFT JOIN scene_p s USING (aoi, index_name, month, ecozone) GROUP BY ALL""",
    ),
    "sides_p": (
        ("cells", "sided"),
        """SELECT aoi, index_name, scene_id, year, month,
            quantile_cont(value, 0.75) AS whole,
            CASE WHEN count(*) FILTER (side = 'south') > 30 THEN quantile_cont(value, 0.75) FILTER (side = 'south') END AS south,
            CASE WHEN count(*) FILTER (side = 'north') > 30 THEN quantile_cont(value, 0.75) FILTER (side = 'north') END AS north
        FROM cells JOIN sided USING ("row", "col") GROUP BY 1, 2, 3, 4, 5""",
    ),
    "elev_p": (
        ("cells", "traits"),
        """SELECT aoi, index_name, scene_id, year, month, stratum, count(*) AS n, quantile_cont(value, 0.5) AS p50,
            quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90
        FROM (SELECT c.*, CASE WHEN elevation > 0 AND elevation < 175 THEN 'low' WHEN elevation >= 175 AND elevation < 300 THEN 'mid' WHEN elevation >= 300 THEN 'high' END AS stratum
              FROM cells c JOIN traits USING ("row", "col")) WHERE stratum IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) > 5""",
    ),
    "by_side": (
        ("sided",),
        """SELECT * FROM (SELECT 'whole' AS stratum, * FROM sided UNION ALL SELECT side AS stratum, * FROM sided)""",
    ),
    "strata_names": ((), "SELECT * FROM (VALUES ('whole'), ('south'), ('north'), ('neither')) AS s(stratum)"),
    "grid_cells": ((), "SELECT aoi, count(*) AS n_cells FROM part CROSS JOIN (VALUES ('north'), ('south')) AS a(aoi) GROUP BY 1"),
}


def side_counts(code: str) -> str:
    """Cells of each class in whole, south and north, with the totals."""
    return f"""SELECT {code} AS code, count(*) AS whole_px, count(*) FILTER (side = 'south') AS south_px,
        count(*) FILTER (side = 'north') AS north_px,
        (SELECT count(*) FROM sided WHERE side = 'south') AS south_total, (SELECT count(*) FROM sided WHERE side = 'north') AS north_total
    FROM sided GROUP BY {code}"""


def with_views(body: str, *views: str) -> str:
    """``body`` behind the named views and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    if not order:
        return body
    parts = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    joiner = ",\n" if body.lstrip().startswith("WITH ") else "\n"
    rest = body.lstrip()[5:] if joiner.startswith(",") else body
    return f"WITH {parts}{joiner}{rest}"
