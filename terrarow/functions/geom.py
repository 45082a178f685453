"""Geometry on array<struct<x:double,y:double>>: open rings and polylines, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _pairs(line: Column) -> Column:
    """Consecutive points of a polyline."""
    n = F.size(line)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(F.arrays_zip(F.slice(line, F.lit(1), n - 1).alias("a"), F.slice(line, F.lit(2), n - 1).alias("b")))


def closed(ring: Column) -> Column:
    """The ring with its first point repeated, unless it ends with it."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when(F.size(ring) == 0, ring).when(first == last, ring).otherwise(F.concat(ring, F.array(first)))


def opened(ring: Column) -> Column:
    """The ring without a repeated last point."""
    return F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def without_repeats(line: Column) -> Column:
    """The polyline without points equal to the one before."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def length(line: Column) -> Column:
    return F.aggregate(_pairs(line), F.lit(0.0), lambda s, p: s + F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_pairs(closed(ring)), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2


def area(rings: Column) -> Column:
    """Area of a polygon: its first ring less the others."""
    return F.aggregate(rings, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")), lambda t, r: F.struct((t["s"] + F.when(t["i"] == 0, F.abs(signed_area(r))).otherwise(-F.abs(signed_area(r)))).alias("s"), (t["i"] + 1).alias("i")))["s"]


def multi_length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda s, line: s + length(line))


def multi_area(polygons: Column) -> Column:
    return F.aggregate(polygons, F.lit(0.0), lambda s, rings: s + area(rings))


def box_ring(xtl: Column, ytl: Column, xbr: Column, ybr: Column) -> Column:
    return F.array(point(xtl, ytl), point(xbr, ytl), point(xbr, ybr), point(xtl, ybr))


def bbox(line: Column) -> Column:
    """xmin, ymin, xmax, ymax."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def mean_point(line: Column) -> Column:
    n = F.size(line)
    total = lambda c: F.aggregate(line, F.lit(0.0), lambda s, p: s + p[c])
    return point(total("x") / n, total("y") / n)


def at_distance(line: Column, s: Column) -> Column:
    """The point s along a polyline, held to its ends."""
    start = F.struct(F.lit(0.0).alias("d"), F.get(line, F.lit(0)).alias("p"))

    def step(t, pair):
        d = F.hypot(pair["b"]["x"] - pair["a"]["x"], pair["b"]["y"] - pair["a"]["y"])
        part = F.when(d == 0, F.lit(1.0)).otherwise(F.least(F.greatest((s - t["d"]) / d, F.lit(0.0)), F.lit(1.0)))
        here = point(pair["a"]["x"] + part * (pair["b"]["x"] - pair["a"]["x"]), pair["a"]["y"] + part * (pair["b"]["y"] - pair["a"]["y"]))
        return F.struct((t["d"] + d).alias("d"), F.when(s > t["d"], here).otherwise(t["p"]).alias("p"))

    return F.aggregate(_pairs(line), start, step)["p"]


def representative(kind: Column, line: Column) -> Column:
    """A point's own place, a line's middle, the vertex mean of a ring."""
    return F.when(kind == "point", F.get(line, F.lit(0))).when(kind == "line", at_distance(line, length(line) / 2)).otherwise(mean_point(opened(line)))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring holds a point, by the parity of crossings of a ray to the right.

    Of a box the left and lower edges belong to it, the right and upper ones don't.
    """

    def crosses(p):
        ay, by, ax, bx = p["a"]["y"], p["b"]["y"], p["a"]["x"], p["b"]["x"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + ax)

    return F.aggregate(_pairs(closed(ring)), F.lit(False), lambda s, p: s != crosses(p))


def subtract_intervals(start: Column, end: Column, cuts: Column) -> Column:
    """What is left of [start, end) without cuts, array<struct<a,b>> sorted by a."""
    first = F.struct(start.cast("double").alias("at"), F.array().cast("array<struct<a:double,b:double>>").alias("out"))

    def step(t, c):
        gap = F.struct(t["at"].alias("a"), F.least(c["a"], end).cast("double").alias("b"))
        return F.struct(F.greatest(t["at"], F.least(c["b"], end)).cast("double").alias("at"), F.when(gap["b"] > gap["a"], F.concat(t["out"], F.array(gap))).otherwise(t["out"]).alias("out"))

    def rest(t):
        return F.when(end > t["at"], F.concat(t["out"], F.array(F.struct(t["at"].alias("a"), end.cast("double").alias("b"))))).otherwise(t["out"])

    return F.aggregate(cuts, first, step, rest)


def clip_range(px: Column, py: Column, ux: Column, uy: Column, size: float) -> tuple[Column, Column]:
    """Parameters t at which the line p + t u enters and leaves the box [0, size]; enter > leave if it misses."""
    big = F.lit(1e18)

    def axis(p, u):
        a, b = (F.lit(0.0) - p) / F.when(u == 0, F.lit(1.0)).otherwise(u), (F.lit(size) - p) / F.when(u == 0, F.lit(1.0)).otherwise(u)
        inside = p.between(0.0, size)
        return F.when(u == 0, F.when(inside, -big).otherwise(big)).otherwise(F.least(a, b)), F.when(u == 0, F.when(inside, big).otherwise(-big)).otherwise(F.greatest(a, b))

    (x0, x1), (y0, y1) = axis(px, ux), axis(py, uy)
    return F.greatest(x0, y0), F.least(x1, y1)


def wkt(rings: Column, decimals: int = 2) -> Column:
    """POLYGON text of open rings, closed on the way."""
    text = lambda p: F.format_string(f"%.{decimals}f %.{decimals}f", p["x"], p["y"])
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), F.array_join(F.transform(closed(r), text), ", "), F.lit(")"))), ", "), F.lit(")"))


def strip(line: Column, half: float) -> Column:
    """A ring about a polyline: points moved half to both sides along averaged normals, flat ends."""
    n = F.size(line)

    def moved(p, i, side):
        before, after = F.get(line, F.greatest(i - 1, F.lit(0))), F.get(line, F.least(i + 1, n - 1))
        dx, dy = after["x"] - before["x"], after["y"] - before["y"]
        d = F.hypot(dx, dy)
        d = F.when(d == 0, F.lit(1.0)).otherwise(d)
        return point(p["x"] - side * half * dy / d, p["y"] + side * half * dx / d)

    return F.concat(F.transform(line, lambda p, i: moved(p, i, 1)), F.reverse(F.transform(line, lambda p, i: moved(p, i, -1))))
