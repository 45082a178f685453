"""Walkable graphs of passages: Delaunay triangles of densified outlines, tile by tile with a border, and the edges between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrarow.storage import stored

from . import spatial
from .graph import components
from .unify import crossings

#: Cells of the joins between edges and outlines, in metres.
CELL = 32.0
POINT = "passage long, x long, y long, px long, py long, nx long, ny long"
TRIANGLE = "passage long, ax long, ay long, bx long, by long, cx long, cy long, area2 long, radius double"


def _let(value: Column, f) -> Column:
    """f(value) with value made once, however often f names it: lambdas would make a column's expression anew each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spread(df: DataFrame) -> DataFrame:
    """df dealt by passage to more tasks than there are cores: it is small in bytes for the work that it makes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "passage")


def outline_points(rings: DataFrame, step: float = 8.0) -> DataFrame:
    """The points of outlines in whole millimetres (POINT), each with those before (p) and after it (n), land on the left.

    rings: passage (long), hole (boolean), ring (array of x, y in metres, in either sense, closed or not). Every side is
    cut into equal parts of step or less. A ring of fewer than three corners, and one with a null in it, is none; a point
    that repeats the one before it counts once. Rings of one passage may not touch.
    """
    whole = _spread(rings).where("ring IS NOT NULL AND passage IS NOT NULL AND NOT exists(ring, p -> p.x IS NULL OR p.y IS NULL)")
    turned = lambda r: F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    length = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    mm = lambda v: F.floor(v * 1000 + 0.5).cast("long")
    steps = lambda p, q: F.greatest(F.lit(1), F.ceil(length(p, q) / step)).cast("int")
    at = lambda p, q, k: F.struct(mm(p["x"] + (k / steps(p, q)) * (q["x"] - p["x"])).alias("x"), mm(p["y"] + (k / steps(p, q)) * (q["y"] - p["y"])).alias("y"))
    opened = lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)

    def area(r):
        # by corners relative to the first, as map coordinates are large
        x, y = lambda p: p["x"] - F.get(r, F.lit(0))["x"], lambda p: p["y"] - F.get(r, F.lit(0))["y"]
        return F.aggregate(F.zip_with(r, turned(r), lambda p, q: x(p) * y(q) - x(q) * y(p)), F.lit(0.0), lambda s, v: s + v)

    ring = _let(F.col("ring"), opened)
    ring = _let(ring, lambda r: F.when(F.size(r) < 3, F.slice(r, 1, 0)).when((area(r) > 0) == F.coalesce("hole", F.lit(False)), F.reverse(r)).otherwise(r))
    # an empty ring has no first corner to turn
    dense = _let(ring, lambda r: F.when(F.size(r) > 0, F.flatten(F.zip_with(r, turned(r), lambda p, q: F.transform(F.sequence(F.lit(0), steps(p, q) - 1), lambda k: at(p, q, k))))))
    unlike = _let(dense, lambda d: F.filter(d, lambda p, i: p != F.get(d, F.pmod(i - 1, F.size(d)))))
    beside = lambda d, i, name: F.get(d, F.pmod(i, F.size(d)))[name]
    point = lambda d: F.transform(d, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), beside(d, i - 1, "x").alias("px"), beside(d, i - 1, "y").alias("py"), beside(d, i + 1, "x").alias("nx"), beside(d, i + 1, "y").alias("ny")))
    return whole.select("passage", _let(unlike, lambda d: F.when(F.size(d) >= 3, point(d))).alias("points")).select("passage", F.explode("points").alias("p")).select("passage", "p.*")


def outline_areas(points: DataFrame) -> DataFrame:
    """passage, area2 (twice the area inside its outlines, square millimetres) and extent (metres, of its box)."""
    wide = "decimal(20,0)"
    cross = F.col("x").cast(wide) * F.col("ny").cast(wide) - F.col("nx").cast(wide) * F.col("y").cast(wide)
    return points.groupBy("passage").agg(F.sum(cross).cast("long").alias("area2"), ((F.max("x") - F.min("x") + F.max("y") - F.min("y")) / 1000).alias("extent"))


def _moved(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifts of under half a millimetre by the coordinates alone, so that no four points lie on a circle and all tiles agree."""
    h = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    unit = lambda v: (v & np.uint64(0xFFFFFF)).astype(float) / 2**24 - 0.5
    return 0.9 * unit(h), 0.9 * unit(h >> np.uint64(24))


def _in_circle(t: list[tuple[int, int]], p: tuple[int, int]) -> bool:
    """Whether p lies within the circle through the counter-clockwise corners t, in whole numbers."""
    (ax, ay), (bx, by), (cx, cy) = ((x - p[0], y - p[1]) for x, y in t)
    return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


def delaunay(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, circles) of the Delaunay triangles of points in general position: counter-clockwise indices; x, y, r * r.

    Points, taken on a grid of 1/4096, come in from left to right; a triangle whose circle lies left of the next point is
    done and no longer looked at. Where floats can't tell whether a point lies within a circle, whole numbers do.
    """
    n, unit = len(x), 4096.0
    x0, y0 = x.min(), y.min()
    gx, gy = np.rint((x - x0) * unit), np.rint((y - y0) * unit)
    span = 1e4 * np.rint(max(gx.max(), gy.max()) + 1)
    xs, ys = np.append(gx, [-span, span, 0.0]), np.append(gy, [-span, -span, span])

    def circles(t):
        """ax, ay, and the centre and its relative error as seen from there."""
        ax, ay = xs[t[:, 0]], ys[t[:, 0]]
        bx, by, cx, cy = xs[t[:, 1]] - ax, ys[t[:, 1]] - ay, xs[t[:, 2]] - ax, ys[t[:, 2]] - ay
        p, q = bx * cy, by * cx
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 2 * (p - q)
            error = 1e-14 * (np.abs(p) + np.abs(q) + 1) / np.abs(p - q)
            size = np.abs(cy * b2) + np.abs(by * c2) + np.abs(bx * c2) + np.abs(cx * b2)
            return np.column_stack([ax, ay, (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d, error * size / np.abs(d)])

    open_ = np.array([[n, n + 1, n + 2]])
    round_ = circles(open_)
    done, done_round = [], []
    for i in np.lexsort((ys[:n], xs[:n])):
        dx, dy = xs[i] - round_[:, 0], ys[i] - round_[:, 1]
        ux, uy, error = round_[:, 2], round_[:, 3], round_[:, 4]
        power = dx * dx + dy * dy - 2 * (dx * ux + dy * uy)
        hit = power < 0
        for j in np.flatnonzero(~(np.abs(power) > 2 * error * (np.abs(dx) + np.abs(dy)) + 1e-14 * (dx * dx + dy * dy))):
            hit[j] = _in_circle([(int(xs[k]), int(ys[k])) for k in open_[j]], (int(xs[i]), int(ys[i])))
        size = np.sqrt(ux * ux + uy * uy)
        over = ~hit & (dx - ux > size * (1 + 1e-9) + 3 * error)
        if over.any():
            done.append(open_[over])
            done_round.append(round_[over])
        sides = {(a, b) for t in open_[hit].tolist() for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        fresh = np.array([(a, b, i) for a, b in sorted(sides) if (b, a) not in sides], dtype=int).reshape(-1, 3)
        stay = ~over & ~hit
        open_, round_ = np.vstack([open_[stay], fresh]), np.vstack([round_[stay], circles(fresh)])
    corners, found = np.vstack([*done, open_]), np.vstack([*done_round, round_])
    own = (corners < n).all(axis=1)
    corners, found = corners[own], found[own]
    return corners, np.column_stack([(found[:, 0] + found[:, 2]) / unit + x0, (found[:, 1] + found[:, 3]) / unit + y0, (found[:, 2] ** 2 + found[:, 3] ** 2) / unit**2])


def _inside(t: np.ndarray, p: np.ndarray) -> bool:
    """Whether the centroid of triangle t (indices) lies inside the outlines p (x, y, px, py, nx, ny by point).

    The sides at one corner tell which side of them the way from it to the centroid starts on; every other side that
    the way crosses changes that. Both are exact, in integers three times as large.
    """
    v = p[t[0]]
    x, y, px, py, nx, ny = (3 * int(c) for c in v)
    gx, gy = int(p[t, 0].sum()), int(p[t, 1].sum())
    dx, dy = gx - x, gy - y
    before, behind = (x - px) * dy - (y - py) * dx > 0, (nx - x) * dy - (ny - y) * dx > 0
    convex = (x - px) * (ny - y) - (y - py) * (nx - x) >= 0
    inside = (before and behind) if convex else (before or behind)
    ux, uy, wx, wy = 3 * p[:, 0] - x, 3 * p[:, 1] - y, 3 * p[:, 4] - x, 3 * p[:, 5] - y
    apart = ((ux != 0) | (uy != 0)) & ((wx != 0) | (wy != 0))
    # a way through a corner belongs to the side below it, by > against <=
    su, sw = dx * uy - dy * ux > 0, dx * wy - dy * wx > 0
    area = ux * wy - uy * wx
    ends = (dx - ux) * (wy - uy) - (dy - uy) * (wx - ux)
    crossed = apart & (su != sw) & ((area > 0) != (-ends > 0))
    return bool(inside ^ (int(crossed.sum()) % 2 == 1))


def _tile_kernel(tile: float, most: float, least: float):
    def kernel(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        passage, tx, ty = key
        df = df.drop_duplicates(["x", "y"])
        ox, oy = int(tx * tile * 1000), int(ty * tile * 1000)
        p = df[["x", "y", "px", "py", "nx", "ny"]].to_numpy(dtype=np.int64) - np.array([ox, oy] * 3)
        empty = pd.DataFrame(columns=[c.split()[0] for c in TRIANGLE.split(", ")])
        if len(p) < 3:
            return empty
        mx, my = _moved(p[:, 0] + ox, p[:, 1] + oy)
        corners, circle = delaunay(p[:, 0] + mx, p[:, 1] + my)
        radius = np.sqrt(circle[:, 2]) / 1000
        own = (np.floor(circle[:, 0] / 1000 / tile) == 0) & (np.floor(circle[:, 1] / 1000 / tile) == 0) & (radius <= most) & (radius > least)
        q = p[corners]
        area2 = (q[:, 1, 0] - q[:, 0, 0]) * (q[:, 2, 1] - q[:, 0, 1]) - (q[:, 1, 1] - q[:, 0, 1]) * (q[:, 2, 0] - q[:, 0, 0])
        take = [i for i in np.flatnonzero(own & (area2 != 0)) if _inside(corners[i], p)]
        if not take:
            return empty
        # corners in one order whatever tile they come from
        rows = [(passage, *(c for point in sorted((int(a) + ox, int(b) + oy) for a, b in q[i, :, :2]) for c in point), abs(int(area2[i])), float(radius[i])) for i in take]
        return pd.DataFrame(rows, columns=empty.columns)

    return kernel


#: A passage of up to so many points, and so many millimetres each way, is made whole: products of places then fit 64 bits.
WHOLE, WIDE = 1000, 400_000


def _best_apex(dot: np.ndarray, cross: np.ndarray) -> int:
    """The index of the smallest dot / cross (cross > 0), in whole numbers."""
    best = 0
    for i in range(1, len(dot)):
        if int(dot[i]) * int(cross[best]) < int(dot[best]) * int(cross[i]):
            best = i
    return best


def _apexes(sides: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """For each directed side the point that makes a Delaunay triangle on its left, or -1.

    Circles through both ends have their centres on one line; the point on the left that the circle meets first is the
    corner, if no point on the right lies in that circle. gx, gy: whole numbers of up to 2**31, so products are exact.
    """
    out = np.full(len(sides), -1)
    for at in range(0, len(sides), max(1, 1_000_000 // len(gx))):
        a, b = sides[at:at + max(1, 1_000_000 // len(gx))].T
        ux, uy = gx - gx[a, None], gy - gy[a, None]
        vx, vy = (gx[b] - gx[a])[:, None], (gy[b] - gy[a])[:, None]
        cross, dot = vx * uy - vy * ux, ux * (ux - vx) + uy * (uy - vy)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = dot / cross
        left = np.where(cross > 0, t, np.inf)
        first = left.argmin(axis=1)
        least = left[np.arange(len(a)), first]
        slack = 1e-14 * np.abs(least)
        most = np.where(cross < 0, t, -np.inf).max(axis=1)
        with np.errstate(invalid="ignore"):
            several = np.flatnonzero((left <= (least + slack)[:, None]).sum(axis=1) > 1)
            close = np.isfinite(least) & (np.abs(most - least) <= slack)
        for i in several[np.isfinite(least[several])]:
            like = np.flatnonzero(left[i] <= least[i] + slack[i])
            first[i] = like[_best_apex(dot[i, like], cross[i, like])]
        free = np.isfinite(least) & (most < least)
        for i in np.flatnonzero(close):
            right = np.flatnonzero((cross[i] < 0) & (t[i] >= least[i] - slack[i]))
            d, c = int(dot[i, first[i]]), int(cross[i, first[i]])
            free[i] = all(int(-dot[i, j]) * c <= d * int(-cross[i, j]) for j in right)
        out[at:at + len(a)] = np.where(free, first, -1)
    return out


def _all_inside(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """_inside of many triangles at once. p: whole numbers of up to WIDE as floats, so three times them and products of those are exact."""
    x, y, px, py, nx, ny = (3 * p[t[:, 0]]).T[:, :, None]
    dx, dy = p[t, 0].sum(axis=1)[:, None] - x, p[t, 1].sum(axis=1)[:, None] - y
    before, behind = (x - px) * dy - (y - py) * dx > 0, (nx - x) * dy - (ny - y) * dx > 0
    convex = (x - px) * (ny - y) - (y - py) * (nx - x) >= 0
    inside = np.where(convex, before & behind, before | behind)[:, 0]
    q = 3 * p.T
    ux, uy, wx, wy = q[0] - x, q[1] - y, q[4] - x, q[5] - y
    su, sw = dx * uy - dy * ux > 0, dx * wy - dy * wx > 0
    # few sides have their ends on either side of the way's line
    i, j = np.nonzero(su != sw)
    ux, uy, wx, wy, dx, dy = ux[i, j], uy[i, j], wx[i, j], wy[i, j], dx[i, 0], dy[i, 0]
    apart = ((ux != 0) | (uy != 0)) & ((wx != 0) | (wy != 0))
    ends = (dx - ux) * (wy - uy) - (dy - uy) * (wx - ux)
    crossed = apart & ((ux * wy - uy * wx > 0) != (-ends > 0))
    return inside ^ (np.bincount(i[crossed], minlength=len(t)) % 2 == 1)


def whole_mesh(p: np.ndarray, border: float = 16.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, twice the areas, radii) of a passage's Delaunay triangles whose centroid lies inside its outlines.

    p: x, y, px, py, nx, ny by point, sorted by x and y, without repeats. Triangles are looked for on all open sides at
    once: on the land side of the outlines first, then across the sides of those found inside. Where these don't fill
    the outlines' area, because a side of theirs is no side of a triangle, all triangles of the points are looked through.
    As by tiles, circles count up to border (metres), or four, sixteen, ... times that, until the area is filled: points
    of one straight side, being rounded and moved, make flat triangles of far larger circles on their neighbours.
    """
    n, none = len(p), np.zeros((0, 3), dtype=np.int64)
    x0, y0 = p[:, 0].min(), p[:, 1].min()
    mx, my = _moved(p[:, 0], p[:, 1])
    own = p - np.array([x0, y0] * 3)
    gx, gy = (np.rint((own[:, i] + m + 1) * 4096).astype(np.int64) for i, m in ((0, mx), (1, my)))
    name = own[:, 0] * 2**20 + own[:, 1]
    after = np.searchsorted(name, own[:, 4] * 2**20 + own[:, 5])
    double = lambda t: (own[t[:, 1], 0] - own[t[:, 0], 0]) * (own[t[:, 2], 1] - own[t[:, 0], 1]) - (own[t[:, 1], 1] - own[t[:, 0], 1]) * (own[t[:, 2], 0] - own[t[:, 0], 0])
    area = int((own[:, 0] * own[:, 5] - own[:, 4] * own[:, 1]).sum())

    exact = own.astype(float)

    def grown(sides: np.ndarray, everywhere: bool) -> np.ndarray:
        seen, found = np.zeros(n * n, dtype=bool), [none]
        while len(sides):
            seen[sides[:, 0] * n + sides[:, 1]] = True
            c = _apexes(sides, gx, gy)
            a, b = sides[c >= 0].T
            c = c[c >= 0]
            # each triangle once, from its smallest corner on
            names = np.sort(np.minimum(np.minimum((a * n + b) * n + c, (b * n + c) * n + a), (c * n + a) * n + b))
            names = names[np.append(True, names[1:] != names[:-1])] if len(names) else names
            t = np.column_stack([names // (n * n), names // n % n, names % n])
            for i in range(3):
                seen[t[:, i] * n + t[:, (i + 1) % 3]] = True
            inside = _all_inside(t, exact) & (double(t) != 0)
            found.append(t[inside])
            reach = t if everywhere else t[inside]
            beyond = np.zeros(n * n, dtype=bool)
            for i, j in ((1, 0), (2, 1), (0, 2)):
                beyond[reach[:, i] * n + reach[:, j]] = True
            beyond = np.flatnonzero(beyond & ~seen)
            sides = np.column_stack([beyond // n, beyond % n])
        return np.concatenate(found)

    def radii(t: np.ndarray) -> np.ndarray:
        a, b, c = (np.column_stack([gx[t[:, i]], gy[t[:, i]]]).astype(float) for i in range(3))
        u, v, w = b - a, c - a, c - b
        return np.hypot(*u.T) * np.hypot(*v.T) * np.hypot(*w.T) / (2 * np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])) / 4096 / 1000

    def filling(t: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        size, radius, most = np.abs(double(t)), radii(t), border
        extent = float(own[:, 0].max() + own[:, 1].max()) / 1000
        while size[radius <= most].sum() < area and extent * 10 > most:
            most *= 4
        take = radius <= most
        return int(size[take].sum()), np.sort(t[take], axis=1), size[take], radius[take]

    outline = np.column_stack([np.arange(n), after])
    filled, *found = filling(grown(outline, False))
    if filled != area:
        d = (gx[:, None] - gx) ** 2 + (gy[:, None] - gy) ** 2
        d[np.arange(n), np.arange(n)] = np.iinfo(np.int64).max
        near = np.column_stack([np.arange(n), d.argmin(axis=1)])  # a point and the next to it are a side of a triangle
        _, *found = filling(grown(np.unique(np.concatenate([near, near[:, ::-1]]), axis=0), True))
    return tuple(found)


def whole_outlines(of: np.ndarray, size: np.ndarray, hole: np.ndarray, x: np.ndarray, y: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(of, points): the points of many rings as outline_points makes them (x, y, px, py, nx, ny), sorted by of, x and y.

    of, size, hole: number of the passage, corners and kind of each ring; x, y: all their corners one after the other.
    """
    start = np.cumsum(size) - size
    ring = np.repeat(np.arange(len(size)), size)
    last, first = (np.minimum(start + k, max(len(x) - 1, 0)) for k in (size - 1, 0))
    closed = (size > 1) & (x[first] == x[last]) & (y[first] == y[last])
    open_ = size - closed
    keep = (np.arange(len(x)) - start[ring] < open_[ring]) & (open_[ring] >= 3)
    x, y, ring = x[keep], y[keep], ring[keep]
    size = np.where(open_ >= 3, open_, 0)
    start = np.cumsum(size) - size
    place = np.arange(len(x)) - start[ring]
    turned = lambda k: start[ring] + k % size[ring]
    u, v = x - x[start[ring]], y - y[start[ring]]
    area = np.bincount(ring, u * v[turned(place + 1)] - u[turned(place + 1)] * v, minlength=len(size))
    back = turned(size[ring] - 1 - place)
    order = np.where(((area > 0) == hole)[ring], back, np.arange(len(x)))
    x, y = x[order], y[order]
    wx, wy = x[turned(place + 1)] - x, y[turned(place + 1)] - y
    steps = np.maximum(1, np.ceil(np.sqrt(wx * wx + wy * wy) / step)).astype(np.int64)
    corner = np.repeat(np.arange(len(x)), steps)
    share = (np.arange(len(corner)) - (np.cumsum(steps) - steps)[corner]) / steps[corner]
    d = np.column_stack([np.floor((c[corner] + share * w[corner]) * 1000 + 0.5) for c, w in ((x, wx), (y, wy))]).astype(np.int64)
    ring = ring[corner]

    def beside(ring: np.ndarray, by: int) -> np.ndarray:
        count = np.bincount(ring, minlength=len(size))
        begin = (np.cumsum(count) - count)[ring]
        return begin + (np.arange(len(ring)) - begin + by) % count[ring]

    unlike = (d != d[beside(ring, -1)]).any(axis=1)
    d, ring = d[unlike], ring[unlike]
    enough = np.bincount(ring, minlength=len(size))[ring] >= 3
    d, ring = d[enough], ring[enough]
    points, of = np.column_stack([d, d[beside(ring, -1)], d[beside(ring, 1)]]), of[ring]
    order = np.lexsort((points[:, 1], points[:, 0], of))
    return of[order], points[order]


def whole_ways(p: np.ndarray, walls: np.ndarray, t: np.ndarray, most: float, penalty: float, near: np.ndarray | None = None, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(ways, of): what passage_edges makes of triangles t (indices of p): thrice the places of both ends, off and w by row.

    p: points sorted by x and y, without repeats; walls: all points with those before and after them. of: the index in p of
    a corner of each way. With near (see _neighbours) p may hold several passages, its walls are walls, and a way looks at the walls
    that begin within reach of that corner; where that is not enough off is nan.
    """
    sums = p[t, :2].sum(axis=1)
    # names are compared as texts
    names = np.array([f"{x}:{y}" for x, y in sums.tolist()], dtype="S")
    rank = np.empty(len(t), dtype=np.int64)
    rank[np.argsort(names, kind="stable")] = np.arange(len(t))
    side = np.concatenate([t[:, i] * len(p) + t[:, j] for i, j in ((0, 1), (0, 2), (1, 2))])
    by = np.concatenate([rank] * 3)
    order = np.lexsort((by, side))
    side, by = side[order], by[order]
    first = np.append(True, side[1:] != side[:-1]) if len(side) else np.zeros(0, dtype=bool)
    last = np.append(first[1:], True) if len(side) else first
    at = np.argsort(rank)
    s, e, of = at[by[first]], at[by[last]], side[first] // len(p)
    two = (sums[s] != sums[e]).any(axis=1)
    s, e, of = sums[s[two]], sums[e[two]], of[two]
    (x0, y0), (x1, y1) = (s / 3000).T, (e / 3000).T
    dx, dy = x1 - x0, y1 - y0
    size = np.sqrt(dx * dx + dy * dy)
    places = p[:, :2] / 1000
    if near is None:
        beside = dx[:, None] * (places[:, 1] - y0[:, None]) - dy[:, None] * (places[:, 0] - x0[:, None]) > 0
        name = p[:, 0] * 2**31 + p[:, 1] - p[:, 1].min()
        index = lambda c: np.searchsorted(name, walls[:, c] * 2**31 + walls[:, c + 1] - p[:, 1].min())
        u, w = index(0), index(4)
        i, j = np.nonzero(beside[:, u] != beside[:, w])
        (ux, uy), (wx, wy) = places[u[j]].T, places[w[j]].T
    else:
        c, ends = near[of], walls[:, 4:6] / 1000
        beside = lambda x, y: dx[:, None] * (y[c] - y0[:, None]) - dy[:, None] * (x[c] - x0[:, None]) > 0
        i, j = np.nonzero((c >= 0) & (beside(*places.T) != beside(*ends.T)))
        (ux, uy), (wx, wy) = places[c[i, j]].T, ends[c[i, j]].T
    share = ((ux - x0[i]) * (wy - uy) - (uy - y0[i]) * (wx - ux)) / (dx[i] * (wy - uy) - dy[i] * (wx - ux))
    cut = (share > 0) & (share < 1)
    i, share = i[cut], share[cut]
    order = np.lexsort((share, i))
    i, share = i[order], share[order]
    count = np.bincount(i, minlength=len(s))
    odd = (np.arange(len(i)) - (np.cumsum(count) - count)[i]) % 2 == 1
    off = (np.bincount(i, np.where(odd, share, -share), minlength=len(s)) + (count % 2 == 1)) * size
    if near is not None:
        wall = np.hypot(*(ends - places).T).max()
        off[np.hypot(*(s / 3000 - places[of]).T) + size + wall >= reach / 1000] = np.nan
    keep = ~(off > most)
    return np.column_stack([s, e, off, size + penalty * off])[keep], of[keep]


def _once(v: np.ndarray) -> np.ndarray:
    """v sorted, each value once."""
    v = np.sort(v)
    return v[np.append(True, v[1:] != v[:-1])] if len(v) else v


def _neighbours(gid: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """For each point all points of its gid within reach, and perhaps more, as rows of indices filled up with -1."""
    cx, cy = (x // reach).astype(np.int64), (y // reach).astype(np.int64)
    wide = int(max(cx.max(), cy.max())) + 3
    cell = (gid * wide + cx + 1) * wide + cy + 1
    order = np.argsort(cell, kind="stable")
    names = cell[order]
    # three cells that follow each other in y are one stretch of the order
    lo = np.stack([np.searchsorted(names, cell + i * wide - 1) for i in (-1, 0, 1)])
    hi = np.stack([np.searchsorted(names, cell + i * wide + 1, side="right") for i in (-1, 0, 1)])
    size = (hi - lo).ravel(order="F")
    row = np.repeat(np.arange(len(cell)), size.reshape(-1, 3).sum(axis=1))
    first = np.cumsum(size) - size
    other = order[np.repeat(lo.ravel(order="F") - first, size) + np.arange(size.sum())]
    near = (x[other] - x[row]) ** 2 + (y[other] - y[row]) ** 2 <= reach * reach
    row, other = row[near], other[near]
    count = np.bincount(row, minlength=len(cell))
    out = np.full((len(cell), count.max()), -1)
    out[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = other
    return out


def _near_apexes(a: np.ndarray, b: np.ndarray, gx: np.ndarray, gy: np.ndarray, near: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(corners, sure): _apexes of sides a, b among the points near a; sure where that side's circle lies within reach of a."""
    c = near[a]
    there = c >= 0
    ux, uy = gx[c] - gx[a, None], gy[c] - gy[a, None]
    vx, vy = (gx[b] - gx[a])[:, None], (gy[b] - gy[a])[:, None]
    cross, dot = vx * uy - vy * ux, ux * (ux - vx) + uy * (uy - vy)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = dot / cross
    row = np.arange(len(a))
    left = np.where((cross > 0) & there, t, np.inf)
    first = left.argmin(axis=1)
    least = left[row, first]
    found = np.isfinite(least)
    slack = 1e-14 * np.abs(least)
    most = np.where((cross < 0) & there, t, -np.inf).max(axis=1)
    with np.errstate(invalid="ignore"):
        several = (left <= (least + slack)[:, None]).sum(axis=1) > 1
        close = np.abs(most - least) <= slack
        # the centre lies t / 2 sides off the middle of the side
        size = np.hypot(vx[:, 0], vy[:, 0])
        sure = found & ~several & ~close & (size / 2 + np.hypot(size / 2, size * least / 2) + np.abs(size * least / 2) < 0.999 * reach)
    return np.where(most < least, c[row, first], -1), sure


def whole_meshes(gid: np.ndarray, p: np.ndarray, border: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(corners, twice the areas, radii, done, near): whole_mesh of many passages at once; those that are not done are to be made alone.

    gid, p: the passages' numbers and their points (see whole_mesh), one passage after the other. Each side looks at the points within
    reach (millimetres) of its ends only, which is all that matters where its circle, or the way that is tested, lies within that.
    """
    starts = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
    ends = np.append(starts[1:], len(gid))
    x0, y0 = (np.minimum.reduceat(p[:, i], starts)[gid] for i in (0, 1))
    mx, my = _moved(p[:, 0], p[:, 1])
    own = p - np.column_stack([x0, y0] * 3)
    gx, gy = (np.rint((own[:, i] + m + 1) * 4096).astype(np.int64) for i, m in ((0, mx), (1, my)))
    name = (gid * 2**20 + own[:, 0]) * 2**20 + own[:, 1]
    after = np.searchsorted(name, (gid * 2**20 + own[:, 4]) * 2**20 + own[:, 5])
    x, y = own[:, 0].astype(float), own[:, 1].astype(float)
    near = _neighbours(gid, x, y, reach + 2)
    wall = np.hypot(x[after] - x, y[after] - y).max()
    n = len(p)
    done = np.ones(len(starts), dtype=bool)
    double = lambda t: (own[t[:, 1], 0] - own[t[:, 0], 0]) * (own[t[:, 2], 1] - own[t[:, 0], 1]) - (own[t[:, 1], 1] - own[t[:, 0], 1]) * (own[t[:, 2], 0] - own[t[:, 0], 0])

    def inside(t: np.ndarray) -> np.ndarray:
        """_inside, by the walls that begin near the first corner."""
        three = 3 * own[t[:, 0]].astype(float)
        px, py, nx, ny = (three[:, i] - three[:, i % 2] for i in (2, 3, 4, 5))
        dx, dy = (own[t, i].sum(axis=1) - 3.0 * own[t[:, 0], i] for i in (0, 1))
        before, behind = -px * dy + py * dx > 0, nx * dy - ny * dx > 0
        got = np.where(-px * ny + py * nx >= 0, before & behind, before | behind)
        done[gid[t[(np.hypot(dx, dy) / 3 + wall >= reach), 0]]] = False
        c = near[t[:, 0]]
        there = c >= 0
        ux, uy = 3 * x[c] - three[:, 0, None], 3 * y[c] - three[:, 1, None]
        d = after[c]
        wx, wy = 3 * x[d] - three[:, 0, None], 3 * y[d] - three[:, 1, None]
        dx, dy = dx[:, None], dy[:, None]
        i, j = np.nonzero(there & ((dx * uy - dy * ux > 0) != (dx * wy - dy * wx > 0)))
        ux, uy, wx, wy, dx, dy = ux[i, j], uy[i, j], wx[i, j], wy[i, j], dx[i, 0], dy[i, 0]
        apart = ((ux != 0) | (uy != 0)) & ((wx != 0) | (wy != 0))
        away = (dx - ux) * (wy - uy) - (dy - uy) * (wx - ux)
        crossed = apart & ((ux * wy - uy * wx > 0) != (-away > 0))
        return got ^ (np.bincount(i[crossed], minlength=len(t)) % 2 == 1)

    # what lies across an outline is no land, and would be far
    seen, found = after * n + np.arange(n), [np.zeros((0, 3), dtype=np.int64)]
    sides = np.arange(n) * n + after
    while len(sides):
        a, b = sides // n, sides % n
        c, sure = _near_apexes(a, b, gx, gy, near, 4096.0 * reach)
        unsure = np.flatnonzero(~sure & done[gid[a]])
        for k in np.split(unsure, np.flatnonzero(np.diff(gid[a[unsure]])) + 1) if len(unsure) else ():
            s = slice(starts[gid[a[k[0]]]], ends[gid[a[k[0]]]])
            alone = _apexes(np.column_stack([a[k], b[k]]) - s.start, gx[s], gy[s])
            c[k] = np.where(alone >= 0, alone + s.start, -1)
        take = (c >= 0) & done[gid[a]]
        a, b, c = a[take], b[take], c[take]
        la, lb, lc = (v - starts[gid[a]] for v in (a, b, c))
        local = np.minimum(np.minimum((la * 1024 + lb) * 1024 + lc, (lb * 1024 + lc) * 1024 + la), (lc * 1024 + la) * 1024 + lb)
        names = _once(gid[a] * 2**30 + local)
        t = (starts[names >> 30] + np.stack([names >> 20 & 1023, names >> 10 & 1023, names & 1023])).T
        around = lambda t: np.concatenate([t[:, i] * n + t[:, j] for i, j in ((0, 1), (1, 2), (2, 0))])
        seen = _once(np.concatenate([seen, sides, around(t)]))
        t = t[inside(t) & (double(t) != 0)]
        found.append(t)
        codes = around(t)
        codes = _once(codes % n * n + codes // n)
        sides = codes[seen[np.minimum(np.searchsorted(seen, codes), len(seen) - 1)] != codes]
    t = np.concatenate(found)
    t = t[np.argsort(gid[t[:, 0]], kind="stable")]
    size = np.abs(double(t))
    a, b, c = (np.column_stack([gx[t[:, i]], gy[t[:, i]]]).astype(float) for i in range(3))
    u, v, w = b - a, c - a, c - b
    radius = np.hypot(*u.T) * np.hypot(*v.T) * np.hypot(*w.T) / (2 * np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])) / 4096 / 1000
    keep = radius <= border
    t, size, radius = t[keep], size[keep], radius[keep]
    total = np.zeros(len(starts), dtype=np.int64)
    np.add.at(total, gid[t[:, 0]], size)
    done &= total == np.add.reduceat(own[:, 0] * own[:, 5] - own[:, 4] * own[:, 1], starts)
    return np.sort(t, axis=1), size, radius, done, near


#: What graphs gives for each passage.
_CORNERS, _ENDS = ("ax", "ay", "bx", "by", "cx", "cy"), ("ax3", "ay3", "bx3", "by3")
GRAPH = f"passage long, triangles array<struct<{', '.join(f'{c}: long' for c in (*_CORNERS, 'area2'))}, radius: double>>, ways array<struct<{', '.join(f'{c}: long' for c in _ENDS)}, off: double, w: double>>"


def _whole_graphs(batches: Iterator[pa.RecordBatch], step: float, border: float, most: float, penalty: float, at_once: int = 40) -> Iterator[pa.RecordBatch]:
    """GRAPH of passages whose rings (passage, hole, ring) come one passage after the other."""
    ids, meshes, ways = [], [], []
    reach = 1800.0 * border

    def packed() -> pa.RecordBatch:
        def lists(parts: list[np.ndarray], whole: tuple, real: tuple) -> pa.ListArray:
            flat = np.concatenate(parts)
            own = [pa.array(flat[:, i].astype(np.int64)) for i in range(len(whole))] + [pa.array(flat[:, len(whole) + i].astype(float)) for i in range(len(real))]
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.StructArray.from_arrays(own, names=[*whole, *real]))

        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(meshes, (*_CORNERS, "area2"), ("radius",)), lists(ways, _ENDS, ("off", "w"))], names=["passage", "triangles", "ways"])
        ids.clear(), meshes.clear(), ways.clear()
        return out

    def alone(passage: int, walls: np.ndarray) -> None:
        p = walls[np.append(True, (walls[1:, :2] != walls[:-1, :2]).any(axis=1))]
        if len(p) < 3:
            return
        t, area2, radius = whole_mesh(p, border)
        if len(t):
            ids.append(passage)
            meshes.append(np.column_stack([p[t, :2].reshape(-1, 6), area2, radius]))
            ways.append(whole_ways(p, walls, t, most, penalty)[0])

    def add(held: list[tuple[int, np.ndarray]]) -> None:
        plain = [(k, w) for k, w in held if len(w) >= 3 and (w[1:, :2] != w[:-1, :2]).any(axis=1).all()]
        numbers = {k for k, _ in plain}
        for k, w in held:
            if k not in numbers and len(w):
                alone(k, w)
        if not plain:
            return
        gid, p = np.repeat(np.arange(len(plain)), [len(w) for _, w in plain]), np.concatenate([w for _, w in plain])
        t, area2, radius, done, near = whole_meshes(gid, p, border, reach)
        t, area2, radius = (v[done[gid[t[:, 0]]]] for v in (t, area2, radius))
        if len(t):
            way, of = whole_ways(p, p, t, most, penalty, near, reach)
            done[gid[of[np.isnan(way[:, 4])]]] = False
            own, mesh = gid[t[:, 0]], np.column_stack([p[t, :2].reshape(-1, 6), area2, radius])
            where = gid[of]
            way = way[np.argsort(where, kind="stable")]
            cut = np.cumsum(np.bincount(own, minlength=len(plain)))[:-1], np.cumsum(np.bincount(where, minlength=len(plain)))[:-1]
            for k, (passage, _), m, w in zip(range(len(plain)), plain, np.split(mesh, cut[0]), np.split(way, cut[1]), strict=True):
                if done[k] and len(m):
                    ids.append(passage), meshes.append(m), ways.append(w)
        for k in np.flatnonzero(~done):
            alone(*plain[k])

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table["passage"].to_numpy()
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        for first in range(0, len(starts), at_once):
            lo, hi = int(starts[first]), int(starts[first + at_once]) if first + at_once < len(starts) else len(names)
            part = table.slice(lo, hi - lo)
            rings, own = part["ring"].combine_chunks(), starts[first : first + at_once] - lo
            x, y = (rings.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            number = np.searchsorted(own, np.arange(hi - lo), side="right") - 1
            of, points = whole_outlines(number, np.diff(rings.offsets.to_numpy()), part["hole"].to_numpy(zero_copy_only=False).astype(bool), x, y, step)
            add([(int(names[lo + own[points_of]]), w) for points_of, w in zip(np.unique(of).tolist(), np.split(points, np.flatnonzero(np.diff(of)) + 1), strict=False)])
            if ids:
                yield packed()

    held = None
    for batch in batches:
        batch = pa.Table.from_batches([batch])
        held = batch if held is None else pa.concat_tables([held, batch])
        if held.num_rows:
            last = int(np.searchsorted(held["passage"].to_numpy(), held["passage"][-1].as_py()))
            if last:
                yield from made(held.slice(0, last).combine_chunks())
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield from made(held.combine_chunks())


def graphs(rings: DataFrame, step: float = 8.0, tile: float = 128.0, border: float | None = None, most: float = 2.0, penalty: float = 9.0, whole: int = WHOLE) -> DataFrame:
    """triangles and passage_edges of rings (see outline_points) as GRAPH: arrays by passage, which may come in several rows.

    Passages of up to whole points, and WIDE each way, are made from their rings to their ways in one pass over sorted partitions,
    so neither points, triangles nor ways are shuffled or stored. Ends of ways are thrice their places, in millimetres.
    """
    clean = rings.where("ring IS NOT NULL AND passage IS NOT NULL AND NOT exists(ring, p -> p IS NULL OR p.x IS NULL OR p.y IS NULL)").select(F.col("passage").cast("long").alias("passage"), F.coalesce("hole", F.lit(False)).alias("hole"), F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring")).where("size(ring) >= 3")
    following = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    steps = F.zip_with("ring", following, lambda p, q: F.ceil(F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])) / step) + 1)
    sides = [f(F.col(f"ring.{c}")).alias(f"_{c}{i}") for c in "xy" for i, f in enumerate((F.array_min, F.array_max))]
    sized = clean.select("passage", F.aggregate(steps, F.lit(0).cast("long"), lambda s, v: s + v).alias("_n"), *sides).groupBy("passage").agg(F.sum("_n").alias("_n"), F.greatest(F.max("_x1") - F.min("_x0"), F.max("_y1") - F.min("_y0")).alias("_wide"))
    # points are counted with a step to spare for every side
    large = stored(sized.where((F.col("_n") > whole) | (F.col("_wide") * 1000 > WIDE - 2)).select("passage"), "large-passages")
    tiled = not large.isEmpty()
    near = clean.join(large.hint("merge"), "passage", "left_anti") if tiled else clean
    around = border or 2 * step
    made = _spread(near).sortWithinPartitions("passage").mapInArrow(lambda batches: _whole_graphs(batches, step, around, most, penalty), GRAPH)
    if not tiled:
        return made
    points = stored(outline_points(clean.join(large.hint("merge"), "passage", "left_semi"), step), "outline-points")
    found = triangles(points, step, tile, border, 0)
    kinds = dict(made.dtypes)
    thrice = lambda c: F.floor(F.col(c) * 3000 + 0.5).cast("long")
    ways = passage_edges(found, points, None, most, penalty).select("passage", F.struct(thrice("x0").alias("ax3"), thrice("y0").alias("ay3"), thrice("x1").alias("bx3"), thrice("y1").alias("by3"), "off", "w").alias("way"))
    none = lambda c: F.array().cast(kinds[c]).alias(c)
    return made.union(found.select("passage", F.array(F.struct(*_CORNERS, "area2", "radius")).cast(kinds["triangles"]), none("ways"))).union(ways.select("passage", none("triangles"), F.array("way").cast(kinds["ways"])))


def _whole_passages(batches, border: float):
    """Triangles of passages whose points come one passage after the other, sorted by x and y."""
    names = [c.split()[0] for c in TRIANGLE.split(", ")]
    held = None

    def made(rows: np.ndarray) -> pd.DataFrame | None:
        cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
        ids, corners, areas, radii = [], [], [], []
        for part in np.split(rows, cuts):
            p = part[:, 1:]
            p = p[np.append(True, (p[1:, :2] != p[:-1, :2]).any(axis=1))]
            if len(p) < 3:
                continue
            t, area2, radius = whole_mesh(p, border)
            ids.append(np.full(len(t), part[0, 0]))
            corners.append(p[t, :2].reshape(-1, 6))
            areas.append(area2)
            radii.append(radius)
        if not ids:
            return None
        columns = [np.concatenate(ids), *np.concatenate(corners).T, np.concatenate(areas), np.concatenate(radii)]
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    for df in batches:
        rows = df.to_numpy(dtype=np.int64)
        held = rows if held is None else np.concatenate([held, rows])
        if not len(held):
            continue
        last = np.searchsorted(held[:, 0], held[-1, 0])
        if last:
            out, held = made(held[:last]), held[last:]
            if out is not None:
                yield out
    if held is not None and len(held):
        out = made(held)
        if out is not None:
            yield out


def triangles(points: DataFrame, step: float = 8.0, tile: float = 128.0, border: float | None = None, whole: int = WHOLE) -> DataFrame:
    """The Delaunay triangles of each passage's points whose centroid lies inside its outlines, as TRIANGLE; millimetres.

    A tile gets the points within its border and a step; it gives the triangles whose circle's centre it holds and whose
    radius is border (2 * step by default) at most, which are those of all the points. Triangles between outlines that
    are wider apart have larger circles: passages whose triangles don't yet fill their area come again by tiles and
    borders four times as large, for the larger circles only, until they are filled or the border is ten times their extent. Where a passage is narrower
    than step, triangles may cross its sides and never fill it. A task holds the points of one passage on one tile.
    Passages of up to whole points, and WIDE each way, need no tiles: they are read one after another out of sorted partitions.
    """
    border = border or 2 * step
    wide = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    sizes = stored(points.groupBy("passage").agg(F.count("*").alias("_n"), wide.alias("_wide")), "passage-sizes")
    small, large = sizes.where((F.col("_n") <= whole) & (F.col("_wide") <= WIDE)), sizes.where((F.col("_n") > whole) | (F.col("_wide") > WIDE))
    part, least, found = points, 0.0, None
    if not small.isEmpty():
        tiled = not large.isEmpty()
        near = points.join(small.select("passage").hint("merge"), "passage", "left_semi") if tiled else points
        sorted_ = near.select(*(c.split()[0] for c in POINT.split(", ")))
        sorted_ = _spread(sorted_).sortWithinPartitions("passage", "x", "y")
        found = stored(sorted_.mapInPandas(lambda batches: _whole_passages(batches, border), TRIANGLE), "triangles")
        if not tiled:
            return found
        points = part = points.join(large.select("passage").hint("merge"), "passage", "left_semi")
    left = stored(outline_areas(points), "outline-areas")
    while True:
        halo = border + step
        spans = lambda c: F.explode(F.sequence(F.floor((F.col(c) / 1000 - halo) / tile), F.floor((F.col(c) / 1000 + halo) / tile)))  # noqa: E731,B023
        dealt = part.withColumn("tx", spans("x")).withColumn("ty", spans("y"))
        new = stored(dealt.groupBy("passage", "tx", "ty").applyInPandas(_tile_kernel(tile, border, least), TRIANGLE), "triangles")
        found = new if found is None else found.union(new)
        filled = found.groupBy("passage").agg(F.sum("area2").alias("_filled"))
        left = stored(left.join(filled, "passage", "left").where((F.coalesce("_filled", F.lit(0)) < F.col("area2")) & (F.col("extent") * 10 > border)).drop("_filled"), "outline-areas")
        if left.isEmpty():
            return found
        part = points.join(left.select("passage"), "passage", "left_semi")
        least, border, tile = border, border * 4, tile * 4


def _name(passage: Column, x: Column, y: Column) -> Column:
    return F.concat_ws(":", passage, x, y)


def passage_nodes(found: DataFrame) -> DataFrame:
    """passage, node, x, y: the triangles' centroids in metres; node is named by its passage and three times its place."""
    x, y = F.col("ax") + F.col("bx") + F.col("cx"), F.col("ay") + F.col("by") + F.col("cy")
    return found.select("passage", _name(F.col("passage"), x, y).alias("node"), (x / 3000).alias("x"), (y / 3000).alias("y"))


def passage_edges(found: DataFrame, points: DataFrame, forbidden: DataFrame | None = None, most: float = 2.0, penalty: float = 9.0) -> DataFrame:
    """passage, a, b, x0, y0, x1, y1, off, w: ways between the centroids of triangles that share a side.

    A way may cut a corner: off is its length outside the outlines, in metres. Ways with more than most of it go, and so
    do those that a forbidden zone (passage, ring: convex, counter-clockwise) crosses; w is the length and penalty times off.
    """
    nodes = F.struct(_name(F.col("passage"), F.col("ax") + F.col("bx") + F.col("cx"), F.col("ay") + F.col("by") + F.col("cy")).alias("node"), ((F.col("ax") + F.col("bx") + F.col("cx")) / 3000).alias("x"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3000).alias("y"))
    corner = lambda p, q: F.struct(*(F.col(c).alias(n) for c, n in zip((p + "x", p + "y", q + "x", q + "y"), ("px", "py", "qx", "qy"), strict=True)))
    sides = found.select("passage", nodes.alias("t"), F.array(corner("a", "b"), corner("a", "c"), corner("b", "c")).alias("sides")).select("passage", "t", F.explode("sides").alias("side"))
    met = sides.groupBy("passage", "side").agg(F.min("t").alias("s"), F.max("t").alias("e")).where("s.node < e.node")
    ways = met.select("passage", F.col("s.node").alias("a"), F.col("e.node").alias("b"), F.col("s.x").alias("x0"), F.col("s.y").alias("y0"), F.col("e.x").alias("x1"), F.col("e.y").alias("y1"))
    ways = stored(ways, "ways")
    boxed = ways.withColumns({"xtl": F.least("x0", "x1") - 0.001, "ytl": F.least("y0", "y1") - 0.001, "xbr": F.greatest("x0", "x1") + 0.001, "ybr": F.greatest("y0", "y1") + 0.001})
    m = lambda c: F.col(c) / 1000
    walls = points.select("passage", m("x").alias("ux"), m("y").alias("uy"), m("nx").alias("wx"), m("ny").alias("wy"))
    walls = walls.withColumns({"xtl_b": F.least("ux", "wx") - 0.001, "ytl_b": F.least("uy", "wy") - 0.001, "xbr_b": F.greatest("ux", "wx") + 0.001, "ybr_b": F.greatest("uy", "wy") + 0.001})
    side = lambda x, y: (F.col("x1") - F.col("x0")) * (F.col(y) - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col(x) - F.col("x0"))
    turn = (F.col("x1") - F.col("x0")) * (F.col("wy") - F.col("uy")) - (F.col("y1") - F.col("y0")) * (F.col("wx") - F.col("ux"))
    at = ((F.col("ux") - F.col("x0")) * (F.col("wy") - F.col("uy")) - (F.col("uy") - F.col("y0")) * (F.col("wx") - F.col("ux"))) / turn
    cut = spatial.box_pairs(boxed, walls, CELL, ["passage"]).where((side("ux", "uy") > 0) != (side("wx", "wy") > 0)).withColumn("_t", at).where("_t > 0 AND _t < 1")
    # a way starts inside: it is outside from every odd crossing to the next
    turns = cut.groupBy("passage", "a", "b").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    outside = F.aggregate(F.transform("_ts", lambda t, i: F.when(i % 2 == 0, -t).otherwise(t)), F.lit(0.0), lambda s, v: s + v) + F.when(F.size("_ts") % 2 == 1, 1.0).otherwise(0.0)
    size = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    charged = ways.join(turns.select("passage", "a", "b", outside.alias("_share")), ["passage", "a", "b"], "left").withColumn("off", F.coalesce("_share", F.lit(0.0)) * size).drop("_share").where(F.col("off") <= most).withColumn("w", size + penalty * F.col("off"))
    if forbidden is None:
        return charged
    barred = crossings(charged, forbidden, ["a", "b"]).select("a", "b").distinct()
    return charged.join(barred, ["a", "b"], "left_anti")


def reachable(edges: DataFrame) -> DataFrame:
    """edges of the component with the most nodes (of equal ones, the one with the smallest name)."""
    labels = components(edges.select("a", "b"))
    top = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select("label")
    kept = labels.join(F.broadcast(top), "label", "left_semi").select(F.col("id").alias("a"))
    return edges.join(kept, "a", "left_semi")


def entered(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, w: for each start (start, x, y) the nearest node of edges and the way to it; equal ones by name.

    Nodes are looked for within rings that double, so each start meets few of them; starts without any node give none.
    """
    ends = stored(edges.select(F.array(F.struct(F.col("a").alias("node"), F.col("x0").alias("nx"), F.col("y0").alias("ny")), F.struct(F.col("b").alias("node"), F.col("x1").alias("nx"), F.col("y1").alias("ny"))).alias("es")).select(F.explode("es").alias("e")).select("e.*").distinct(), "nodes")
    far = ends.select(F.max(F.abs("nx")) + F.max(F.abs("ny"))).first()[0]
    left, found, reach = starts.select("start", "x", "y"), None, 2 * CELL
    if far is None:
        return starts.select("start", F.lit(None).cast("string").alias("node"), F.lit(None).cast("double").alias("w")).limit(0)
    far += starts.select(F.coalesce(F.max(F.abs("x")) + F.max(F.abs("y")), F.lit(0.0))).first()[0]
    while True:
        best = Window.partitionBy("start").orderBy("d2", "node")
        near = spatial.distance_pairs(left, ends, "x", "y", "nx", "ny", reach).withColumn("_r", F.row_number().over(best)).where("_r = 1")
        new = stored(near.select("start", "node", F.sqrt("d2").alias("w")), "entries")
        found = new if found is None else found.union(new)
        left = stored(left.join(new, "start", "left_anti"), "starts")
        if reach > far or left.isEmpty():
            return found
        reach *= 2
