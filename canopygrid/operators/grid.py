"""Grids, area outlines, regridding and terrain derivation.

Cell (row, col) covers x_min + [col, col+1)·dx and y_max − [row, row+1)·dy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.functions import bands as B
from canopygrid.functions import terrain
from canopygrid.functions.quantiles import grouped_percentiles
from canopygrid.model import TILE, Grid


def canonical_grid(vertices: DataFrame, resolution: float) -> DataFrame:
    """Grid of each area's bounding box.

    Sides are whole numbers of cells, so the cell size differs slightly from
    ``resolution``.
    """
    return (
        vertices.groupBy("aoi")
        .agg(
            F.min("x").alias("x_min"),
            F.max("x").alias("x_max"),
            F.min("y").alias("y_min"),
            F.max("y").alias("y_max"),
        )
        .withColumn("width", F.floor((F.col("x_max") - F.col("x_min")) / resolution).cast("int"))
        .withColumn("height", F.floor((F.col("y_max") - F.col("y_min")) / resolution).cast("int"))
        .withColumn("dx", F.try_divide(F.col("x_max") - F.col("x_min"), F.col("width")))
        .withColumn("dy", F.try_divide(F.col("y_max") - F.col("y_min"), F.col("height")))
    )


def edges(vertices: DataFrame) -> DataFrame:
    """Outline segments from closed rings of (aoi, ring, seq, x, y).

    ``seq`` numbers the corners of a ring without gaps, so that a corner finds
    the next one by an equi-join and a long ring is spread over all tasks.
    """
    following = vertices.select(
        "aoi", "ring", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    return vertices.join(following, ["aoi", "ring", "seq"]).select(
        "aoi", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2"
    )


def aoi_area(vertices: DataFrame) -> DataFrame:
    """Area in km² by the shoelace rule; ring 0 is the outline, others are holes."""
    ring = (
        edges(vertices)
        .groupBy("aoi", "ring")
        .agg((F.abs(F.sum(F.expr("x1 * y2 - x2 * y1"))) / 2).alias("ring_area"))
    )
    signed = F.when(F.col("ring") == 0, F.col("ring_area")).otherwise(-F.col("ring_area"))
    return ring.groupBy("aoi").agg((F.sum(signed) / 1e6).alias("area_km2"))


def cell_centers(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumns(
        {
            "x": F.lit(grid.x_min) + (F.col("col") + 0.5) * grid.dx,
            "y": F.lit(grid.y_max) - (F.col("row") + 0.5) * grid.dy,
        }
    )


def aoi_spans(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Runs of columns [col_from, col_to) inside each area, per grid row.

    Scan-line fill: an edge is spread over the rows whose centre line it
    crosses; the crossings of a row, in order, pair up into inside runs
    (even-odd rule, so holes and several rings work). Work grows with the
    outline and the covered rows, never with cells times edges.
    """
    top = F.greatest("y1", "y2")
    bottom = F.least("y1", "y2")
    # Rows whose centre y satisfies bottom <= y < top.
    first = F.floor((F.lit(grid.y_max) - top) / grid.dy - 0.5) + 1
    last = F.floor((F.lit(grid.y_max) - bottom) / grid.dy - 0.5)
    first = F.greatest(first, F.lit(0))
    if grid.height is not None:
        last = F.least(last, F.lit(grid.height - 1))
    y = F.lit(grid.y_max) - (F.col("row") + 0.5) * grid.dy
    crossings = (
        edges(vertices)
        .filter(F.col("y1") != F.col("y2"))
        .filter(first <= last)
        .withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .select(
            "aoi",
            "row",
            ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"),
        )
    )
    scan = Window.partitionBy("aoi", "row").orderBy("x")
    runs = (
        crossings.withColumn("n", F.row_number().over(scan))
        .withColumn("x_to", F.lead("x").over(scan))
        .filter(F.col("n") % 2 == 1)
    )
    # A centre belongs to the run when x <= centre < x_to.
    col_of = lambda x: F.ceil((F.col(x) - grid.x_min) / grid.dx - 0.5)
    return (
        runs.select(
            "aoi",
            "row",
            F.greatest(col_of("x"), F.lit(0)).cast("int").alias("col_from"),
            F.least(col_of("x_to"), F.lit(grid.width)).cast("int").alias("col_to"),
        ).filter("col_from < col_to")
    )


def aoi_cells(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre lies inside an area, as (aoi, row, col)."""
    return aoi_spans(vertices, grid).select(
        "aoi", "row", F.explode(F.sequence(F.col("col_from"), F.col("col_to") - 1)).alias("col")
    )


def with_aoi_flag(cells: DataFrame, vertices: DataFrame, grid: Grid) -> DataFrame:
    """Adds in_aoi to (aoi, row, col) cells.

    Cells meet their row's runs, a handful of column ranges, so a small table
    by row and not one of all inside cells is joined.
    """
    runs = aoi_spans(vertices, grid).groupBy("aoi", "row").agg(
        F.collect_list(F.struct("col_from", "col_to")).alias("__runs")
    )
    inside = F.exists("__runs", lambda r: (F.col("col") >= r["col_from"]) & (F.col("col") < r["col_to"]))
    return cells.join(runs, ["aoi", "row"], "left").withColumn("in_aoi", F.coalesce(inside, F.lit(False))).drop("__runs")


CROSSED, WHOLE = 1, 2


def aoi_tiles(vertices: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(aoi, tile_row, tile_col, cover): the storage tiles that hold cells of each area.

    ``cover`` is ``WHOLE`` where all of a tile's cells are inside, ``CROSSED``
    where the outline parts them. Tiles that are not listed lie outside. Runs
    are added up by tile; the outline is not looked at again.
    """
    first, last = F.floor(F.col("col_from") / tile), F.floor((F.col("col_to") - 1) / tile)
    spread = aoi_spans(vertices, grid).withColumn("tile_col", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    inside = F.least("col_to", (F.col("tile_col") + 1) * tile) - F.greatest("col_from", F.col("tile_col") * tile)
    wide = F.least(F.lit(tile), F.lit(grid.width) - F.col("tile_col") * tile)
    high = F.lit(tile)
    if grid.height is not None:
        high = F.least(high, F.lit(grid.height) - F.col("tile_row") * tile)
    return (
        spread.groupBy("aoi", F.floor(F.col("row") / tile).cast("int").alias("tile_row"), "tile_col")
        .agg(F.sum(inside).alias("__n"))
        .select("aoi", "tile_row", "tile_col", F.when(F.col("__n") == wide * high, WHOLE).otherwise(CROSSED).alias("cover"))
    )


def tile_columns(tile: int = TILE) -> dict[str, Column]:
    return {f"tile_{c}": F.floor(F.col(c) / tile).cast("int") for c in ("row", "col")}


def inside_area(
    cells: DataFrame, vertices: DataFrame, grid: Grid, tile: int = TILE, tiles: DataFrame | None = None
) -> DataFrame:
    """The cells whose centre lies inside their area.

    A cell's tile decides where it lies wholly inside or outside; only cells
    of tiles that the outline crosses meet runs. Where ``cells`` is a store with
    partitions by (tile_row, tile_col) and ``tiles`` a stored table of
    ``aoi_tiles``, files of tiles outside are not read.
    """
    tiles = aoi_tiles(vertices, grid, tile) if tiles is None else tiles
    missing = {c: v for c, v in tile_columns(tile).items() if c not in cells.columns}
    tiled, at = cells.withColumns(missing) if missing else cells, ["aoi", "tile_row", "tile_col"]
    of = lambda cover: tiled.join(tiles.filter(F.col("cover") == cover).select(*at), at, "left_semi").select(*cells.columns)
    crossed = with_aoi_flag(of(CROSSED), vertices, grid).filter("in_aoi").select(*cells.columns)
    return of(WHOLE).unionByName(crossed)


def aoi_pixels(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre lies inside each area: (aoi, area_px), summed over runs."""
    return aoi_spans(vertices, grid).groupBy("aoi").agg(
        F.sum((F.col("col_to") - F.col("col_from")).cast("bigint")).alias("area_px")
    )


def bbox_share(cells: DataFrame) -> DataFrame:
    """Share of an area's bounding-box cells that lie inside it."""
    return cells.groupBy("aoi").agg(
        F.count("*").alias("n_cells"),
        F.count_if("in_aoi").alias("n_inside"),
        F.avg(F.col("in_aoi").cast("int")).alias("inside_share"),
    )


def regrid_nearest(target: DataFrame, source: DataFrame, to: Grid, frm: Grid, value: str) -> DataFrame:
    """Value of the source cell that holds each target cell's centre."""
    centers = cell_centers(target, to)
    keyed = centers.withColumns(
        {
            "__r": F.floor((F.lit(frm.y_max) - F.col("y")) / frm.dy).cast("int"),
            "__c": F.floor((F.col("x") - frm.x_min) / frm.dx).cast("int"),
        }
    )
    src = source.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    return keyed.join(src, ["__r", "__c"], "left").drop("__r", "__c", "x", "y")


def regrid_bilinear(target: DataFrame, source: DataFrame, to: Grid, frm: Grid, value: str) -> DataFrame:
    """Weighted mean of the four source cells around each target centre.

    Cells outside the source or without a value leave the mean of the others;
    none at all gives null.
    """
    centers = cell_centers(target, to).withColumns(
        {
            "__y": (F.lit(frm.y_max) - F.col("y")) / frm.dy - 0.5,
            "__x": (F.col("x") - frm.x_min) / frm.dx - 0.5,
        }
    )
    r0, c0 = F.floor("__y"), F.floor("__x")
    fr, fc = F.col("__y") - r0, F.col("__x") - c0

    def corner(dr: int, dc: int) -> Column:
        weight = (fr if dr else 1 - fr) * (fc if dc else 1 - fc)
        return F.struct(
            (r0 + dr).cast("int").alias("__r"), (c0 + dc).cast("int").alias("__c"), weight.alias("__w")
        )

    corners = F.array(*[corner(dr, dc) for dr in (0, 1) for dc in (0, 1)])
    src = source.select(
        F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v")
    ).filter(B.finite(F.col("__v").cast("double")))
    weighted = F.when(F.col("__v").isNotNull(), F.col("__w"))
    return (
        centers.select("row", "col", F.inline(corners))
        .filter("__w > 0")
        .join(src, ["__r", "__c"], "left")
        .groupBy("row", "col")
        .agg(F.try_divide(F.sum(weighted * F.col("__v")), F.sum(weighted)).alias(value))
    )


def resample_bilinear(
    source: DataFrame, to: Grid, frm: Grid, value: str, *, keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """All cells of a grid whose centre lies in a cell of ``source``, with the weighted mean of the four cells around it.

    As ``regrid_bilinear``, for whole layers: the target's cells are not given
    but follow from the grids. Source cells are shuffled once, by tile, those
    on a tile's edge to its neighbour too; everything else happens in a tile.
    """
    held = list(keys)
    own = source.select(*held, "row", "col", F.col(value).cast("double").alias("__v"))
    at = [*held, "__tr", "__tc"]
    # A cell is a corner of the four squares between centres that it touches; its own tile and that above and to the left.
    tiles = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - 1) / tile).cast("int"), F.floor(F.col(c) / tile).cast("int")))
    dealt = own.withColumn("__tr", F.explode(tiles("row"))).withColumn("__tc", F.explode(tiles("col"))).repartition(*at)
    corners = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (0, 1) for c in (0, 1)])
    squares = (
        dealt.select("*", F.inline(corners))
        .withColumns({"__r": F.col("row") - F.col("dr"), "__c": F.col("col") - F.col("dc")})
        .filter((F.floor(F.col("__r") / tile) == F.col("__tr")) & (F.floor(F.col("__c") / tile) == F.col("__tc")))
    )
    names, picks = [], []
    good = B.finite(F.col("__v"))
    for r in (0, 1):
        for c in (0, 1):
            here = (F.col("dr") == r) & (F.col("dc") == c)
            names.append((r, c, f"__v{r}{c}", f"__p{r}{c}"))
            picks += [F.max(F.when(here & good, F.col("__v"))).alias(f"__v{r}{c}"), F.coalesce(F.bool_or(here), F.lit(False)).alias(f"__p{r}{c}")]
    squares = squares.groupBy(*at, "__r", "__c").agg(*picks)

    # Target centres at a distance of [0, 1) below and right of a square's first centre.
    def numbers(first: Column, origin: float, step: float, size: int | None) -> Column:
        low = F.greatest(F.ceil((first - origin) / step - 0.5), F.lit(0)).cast("int")
        high = (F.ceil((first + 1 - origin) / step - 0.5) - 1).cast("int")
        high = high if size is None else F.least(high, F.lit(size - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    # In source cells, from the centre of its first cell.
    y0, x0 = (frm.y_max - to.y_max) / frm.dy - 0.5, (to.x_min - frm.x_min) / frm.dx - 0.5
    sy, sx = to.dy / frm.dy, to.dx / frm.dx
    cells = squares.withColumn("row", F.explode(numbers(F.col("__r"), y0, sy, to.height))).withColumn(
        "col", F.explode(numbers(F.col("__c"), x0, sx, to.width))
    )
    fr = y0 + (F.col("row") + 0.5) * sy - F.col("__r")
    fc = x0 + (F.col("col") + 0.5) * sx - F.col("__c")
    up, down, within = F.lit(0.0), F.lit(0.0), F.lit(False)
    for r, c, v, present in names:
        weight = (fr if r else 1 - fr) * (fc if c else 1 - fc)
        up = up + F.when(F.col(v).isNotNull() & (weight > 0), weight * F.col(v)).otherwise(0.0)
        down = down + F.when(F.col(v).isNotNull() & (weight > 0), weight).otherwise(0.0)
        within = within | (F.col(present) & ((fr >= 0.5) if r else (fr < 0.5)) & ((fc >= 0.5) if c else (fc < 0.5)))
    return cells.filter(within).select(*held, "row", "col", F.try_divide(up, F.when(down > 0, down)).alias(value))


def dem_mosaic(*tiles: DataFrame) -> DataFrame:
    """Mean elevation of all tiles covering a cell."""
    stacked = tiles[0]
    for tile in tiles[1:]:
        stacked = stacked.unionByName(tile)
    return stacked.groupBy("row", "col").agg(F.avg(B.nan_to_null(F.col("elevation"))).alias("elevation"))


def _with_halo(cells: DataFrame, tile: int) -> DataFrame:
    """Each cell in its own tile and, on a border, in the neighbour's halo."""
    def reach(axis: str) -> Column:
        at = F.col(axis)
        own = F.floor(at / tile).cast("int")
        return F.array_distinct(
            F.array(
                own,
                F.floor((at - 1) / tile).cast("int"),
                F.floor((at + 1) / tile).cast("int"),
            )
        )

    own = (F.col("__tr") == F.floor(F.col("row") / tile)) & (F.col("__tc") == F.floor(F.col("col") / tile))
    return (
        cells.withColumn("__tr", F.explode(reach("row")))
        .withColumn("__tc", F.explode(reach("col")))
        .withColumn("__own", own)
    )


def gradient_xy(
    cells: DataFrame, value: str = "elevation", spacing: float = 10.0, *, keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Adds dx (along the row) and dy (down the column).

    Central differences, one-sided where the grid ends; a neighbour without a
    value gives null. Cells are shuffled once, by storage tile with a one-cell
    halo; both passes sort inside the tile.
    """
    keys = list(keys)
    tiled = _with_halo(cells, tile).repartition(*keys, "__tr", "__tc")

    def slope_along(axis: str, across: str) -> Column:
        w = Window.partitionBy(*keys, "__tr", "__tc", across).orderBy(axis)
        here = F.col(value)
        before = F.lag(value).over(w)
        after = F.lead(value).over(w)
        has_before = F.coalesce(F.lag(axis).over(w) == F.col(axis) - 1, F.lit(False))
        has_after = F.coalesce(F.lead(axis).over(w) == F.col(axis) + 1, F.lit(False))
        return (
            F.when(has_before & has_after, (after - before) / (2.0 * spacing))
            .when(has_after, (after - here) / spacing)
            .when(has_before, (here - before) / spacing)
        )

    return (
        tiled.withColumn("dx", slope_along("col", "row"))
        .withColumn("dy", slope_along("row", "col"))
        .filter("__own")
        .drop("__tr", "__tc", "__own")
    )


def slope_aspect(
    cells: DataFrame, spacing: float = 10.0, *, convention: str = "upslope", keys: Sequence[str] = ()
) -> DataFrame:
    """Slope and aspect in degrees from elevation."""
    return (
        gradient_xy(cells, "elevation", spacing, keys=keys)
        .withColumn("slope", terrain.slope_degrees(F.col("dx"), F.col("dy")))
        .withColumn(
            "aspect",
            terrain.aspect_degrees(F.col("dx"), F.col("dy"), F.col("slope"), convention=convention),
        )
    )


def raster_stats(
    cells: DataFrame, value: str, keys: Sequence[str] = (), *, value_range: tuple[float, float]
) -> DataFrame:
    """Count, share of valid cells, range, mean, quartiles and a flag for negatives."""
    keys = list(keys)
    v = F.when(B.finite(F.col(value)), F.col(value))
    basic = cells.groupBy(*keys).agg(
        F.count("*").alias("n_cells"),
        F.count(v).alias("n_valid"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
    )
    quartiles = grouped_percentiles(
        cells.withColumn("__value", v), keys, "__value", (25, 50, 75), value_range=value_range
    ).drop("n")
    # Both have one row per key; stacked and folded rather than joined, so that
    # the keyless case needs no product.
    names = [c for c in (*basic.columns, *quartiles.columns) if c not in keys]
    both = (
        basic.unionByName(quartiles, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*[F.max(c).alias(c) for c in names])
    )
    return both.withColumn("valid_share", F.try_divide("n_valid", "n_cells")).withColumn(
        "has_negative", F.coalesce(F.col("min") < 0, F.lit(False))
    )


def alignment_check(layers: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Issues of each layer against the canonical grid of its area.

    Both carry epsg, res, width, height, x_min and y_max; codes are joined by
    commas and empty for a layer that fits.
    """
    want = expected.select(
        "aoi", *[F.col(c).alias("e_" + c) for c in ("epsg", "res", "width", "height", "x_min", "y_max")]
    )
    issue = lambda bad, code: F.when(bad, F.lit(code))
    off = lambda c: F.abs(F.col(c) - F.col("e_" + c)) > tolerance
    unknown_crs = F.col("epsg").isNull() | (F.col("epsg") != F.col("e_epsg"))
    shape = (F.col("width") != F.col("e_width")) | (F.col("height") != F.col("e_height"))
    issues = F.array_compact(
        F.array(
            issue(unknown_crs, "crs"),
            issue(off("res"), "resolution"),
            issue(shape, "shape"),
            issue(off("x_min") | off("y_max"), "origin"),
        )
    )
    kept = [c for c in layers.columns]
    return (
        layers.join(want, "aoi")
        .withColumn("issues", F.array_join(issues, ","))
        .withColumn("n_issues", F.size(issues))
        .select(*kept, "issues", "n_issues")
    )
