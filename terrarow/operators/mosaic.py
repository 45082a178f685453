"""One grid out of rasters of several grids and projections: snapped bounds, inverse warp, later rasters on top.

rasters: raster, place, zone, a, b, c, d, e, f, width, height. A pixel's corner (px, py) lies at (a px + b py + c,
d px + e py + f) in the UTM zone (north), in degrees where zone is 0. pixels: raster, px, py and values, absent ones are 0.
Rasters with a null among these don't count.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrarow.functions.grid import affine, lonlat_from_utm, utm_from_lonlat

EDGE = 21  #: steps of each edge when bounds are projected
NOISE = 1e-4  #: part of a cell by which bounds may miss a cell's edge
NUMBERS = ["raster", "place", "zone", "a", "b", "c", "d", "e", "f", "width", "height"]


class Grid(NamedTuple):
    """Cells of x by y metres (degrees), row 0 at the top edge y0, column 0 at the left edge x0."""

    zone: int
    x0: float
    y0: float
    x: float
    y: float
    width: int
    height: int


def _projected(df: DataFrame, zone: int, to: int) -> DataFrame:
    """x, y of one zone in another, in two named steps (one expression would repeat the first in each term of the second)."""
    if zone == to:
        return df
    if zone:
        lon, lat = lonlat_from_utm(F.col("x"), F.col("y"), zone)
        df = df.withColumns({"x": lon, "y": lat})
    if to:
        e, n = utm_from_lonlat(F.col("x"), F.col("y"), to)
        df = df.withColumns({"x": e, "y": n})
    return df


def _zones(rasters: DataFrame) -> list[int]:
    """The zones in use: 60 and degrees at most."""
    return sorted(r.zone for r in rasters.select("zone").distinct().collect())


def _points(rasters: DataFrame, points, zone: int, to: int) -> DataFrame:
    """The rasters of a zone once for each of the points (use, px, py), with x, y of that place in the other zone."""
    each = F.explode(F.array(*(F.struct(F.lit(use).alias("use"), (F.lit(0.0) + px).alias("px"), (F.lit(0.0) + py).alias("py")) for use, px, py in points)))
    at = rasters.where(F.col("zone") == zone).withColumn("_p", each)
    x, y = affine(F.col("_p.px"), F.col("_p.py"), tuple(F.col(c) for c in "abcdef"))
    return _projected(at.withColumns({"x": x, "y": y, "use": F.col("_p.use")}).drop("_p"), zone, to)


def _upright() -> Column:
    return (F.col("b") == 0) & (F.col("d") == 0) & (F.col("a") > 0) & (F.col("e") < 0)


def grid_of(rasters: DataFrame, mixed: int = 35) -> Grid | None:
    """The grid that holds all rasters; none without rasters. One line of sums comes to the driver.

    Its zone is that of all rasters, or mixed if they differ. Its cells are as wide and high as the smallest pixels.
    Its edges are whole cells from the corner of the first raster (by place) if that is upright in the zone, else from
    the left and top of all.
    """
    known = rasters.select(*NUMBERS).dropna()
    zones = _zones(known)
    if not zones:
        return None
    zone = zones[0] if len(zones) == 1 else mixed
    n = EDGE + 1
    edge = [("edge", F.col("width") * i / n, F.col("height") * j / n) for i in range(n + 1) for j in range(n + 1) if i in (0, n) or j in (0, n)]
    corners = [p for k, p in enumerate(edge) if k in (0, n, len(edge) - n - 1, len(edge) - 1)]
    unit = [("o", 0, 0), ("r", 1, 0), ("u", 0, 1)]
    placed = [_points(known, unit + (corners if z == zone else edge), z, zone) for z in zones]
    both = placed[0]
    for part in placed[1:]:
        both = both.union(part)
    of = lambda use, c: F.max(F.when(F.col("use") == use, F.col(c)))
    long = lambda to: F.hypot(of(to, "x") - of("o", "x"), of(to, "y") - of("o", "y"))
    on = F.col("use") == "edge"
    box = both.groupBy("raster", "place", "zone", *"abcdef").agg(*(f(F.when(on, F.col(c))).alias(k) for k, f, c in (("l", F.min, "x"), ("r", F.max, "x"), ("low", F.min, "y"), ("top", F.max, "y"))), long("r").alias("_x"), long("u").alias("_y"))
    own = (F.col("zone") == zone) & _upright()
    box = box.withColumns({"own": own, "_x": F.when(own, F.col("a")).otherwise(F.col("_x")), "_y": F.when(own, -F.col("e")).otherwise(F.col("_y"))})
    first = F.min_by(F.struct("own", "c", "f"), F.struct("place", "raster")).alias("first")
    s = box.agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("low").alias("b"), F.max("top").alias("t"), F.min("_x").alias("x"), F.min("_y").alias("y"), first).first()
    at_x, at_y = (s.first.c, s.first.f) if s.first.own else (s.l, s.t)
    snap = lambda v, at, step, way: at + _whole((v - at) / step, way) * step
    left, right, low, top = snap(s.l, at_x, s.x, -1), snap(s.r, at_x, s.x, 1), snap(s.b, at_y, s.y, -1), snap(s.t, at_y, s.y, 1)
    return Grid(zone, left, top, s.x, s.y, round((right - left) / s.x), round((top - low) / s.y))


def _whole(cells: float, way: int) -> int:
    """Down (-1) or up (1) to whole cells, but for noise."""
    return math.floor(cells + NOISE) if way < 0 else math.ceil(cells - NOISE)


def mosaic(rasters: DataFrame, pixels: DataFrame, values: list[str], grid: Grid, over: bool = True) -> DataFrame:
    """col, row and the values of the grid's cells that a raster covers; where several do, that with the last place.

    A raster on the grid's own cells is copied. Any other gives each cell of its window the pixel in which the cell's
    middle lies. The window is a box: with over, its cells beyond the raster's slanted edges are set too, to 0, and hide
    what lies below; without, they are left alone. Cells are made line by line after lines are dealt to tasks, so a
    large raster is no single task.
    """
    known = rasters.select(*NUMBERS).dropna().dropDuplicates(["raster"])
    zones = _zones(known)
    parts = [_aimed(known, z, grid) for z in zones]
    if not parts:
        return pixels.select(F.lit(0).cast("bigint").alias("col"), F.lit(0).cast("bigint").alias("row"), *values).limit(0)
    aimed = parts[0]
    for part in parts[1:]:
        aimed = aimed.union(part)
    if not over:
        aimed = aimed.where((F.col("px") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") >= 0) & (F.col("py") < F.col("height")))
    own = pixels.select("raster", F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"), *values).dropDuplicates(["raster", "px", "py"])
    seen = aimed.join(own, ["raster", "px", "py"], "left")
    zero = {v: F.coalesce(v, F.lit(0).cast(pixels.schema[v].dataType)) for v in values}
    top = seen.withColumns(zero).groupBy("col", "row").agg(F.max_by(F.struct(*values), F.struct("place", "raster")).alias("_v"))
    return top.select("col", "row", *(F.col("_v")[v].alias(v) for v in values))


def _aimed(rasters: DataFrame, zone: int, grid: Grid) -> DataFrame:
    """The cells of the windows of a zone's rasters, with the pixel that each takes."""
    corners = [(f"k{i}{j}", F.col("width") * i, F.col("height") * j) for i in (0, 1) for j in (0, 1)]
    at = _points(rasters, corners, zone, grid.zone).withColumns({"_c": (F.col("x") - grid.x0) / grid.x, "_r": (grid.y0 - F.col("y")) / grid.y})
    start = lambda c: F.max(F.when(F.col("use") == "k00", F.col(c)))
    box = at.groupBy(*NUMBERS).agg(F.min("_c").alias("_c0"), F.max("_c").alias("_c1"), F.min("_r").alias("_r0"), F.max("_r").alias("_r1"), start("_c").alias("_kc"), start("_r").alias("_kr"))
    near = lambda v, to, by: F.abs(v - to) <= by
    kc, kr = F.round("_kc"), F.round("_kr")
    alike = near(F.col("a"), grid.x, grid.x * 1e-6) & near(-F.col("e"), grid.y, grid.y * 1e-6) & near(F.col("_kc"), kc, 1e-3) & near(F.col("_kr"), kr, 1e-3)
    inside = (kc >= 0) & (kr >= 0) & (kc + F.col("width") <= grid.width) & (kr + F.col("height") <= grid.height)
    box = box.withColumn("_same", F.lit(zone == grid.zone) & _upright() & alike & inside)
    long = lambda c: c.cast("bigint")
    lo = lambda c: F.greatest(F.floor(F.col(c) + NOISE), F.lit(0))
    hi = lambda c, most: F.least(F.ceil(F.col(c) - NOISE), F.lit(most))
    box = box.withColumns({
        "_c0": long(F.when(F.col("_same"), kc).otherwise(lo("_c0"))),
        "_c1": long(F.when(F.col("_same"), kc + F.col("width")).otherwise(hi("_c1", grid.width))),
        "_r0": long(F.when(F.col("_same"), kr).otherwise(lo("_r0"))),
        "_r1": long(F.when(F.col("_same"), kr + F.col("height")).otherwise(hi("_r1", grid.height))),
    }).where("_c0 < _c1 and _r0 < _r1")
    lines = box.withColumn("row", F.explode(F.sequence("_r0", F.col("_r1") - 1))).repartition("raster", "row")
    cells = lines.withColumn("col", F.explode(F.sequence("_c0", F.col("_c1") - 1)))
    cells = _projected(cells.withColumns({"x": grid.x0 + (F.col("col") + 0.5) * grid.x, "y": grid.y0 - (F.col("row") + 0.5) * grid.y}), grid.zone, zone)
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    dx, dy = F.col("x") - F.col("c"), F.col("y") - F.col("f")
    px = F.when(F.col("_same"), F.col("col") - F.col("_c0")).otherwise(long(F.floor((F.col("e") * dx - F.col("b") * dy) / det)))
    py = F.when(F.col("_same"), F.col("row") - F.col("_r0")).otherwise(long(F.floor((F.col("a") * dy - F.col("d") * dx) / det)))
    return cells.select("raster", "place", "col", "row", px.alias("px"), py.alias("py"), "width", "height")
