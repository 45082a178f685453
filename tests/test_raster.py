"""Territories and canopies against brute force on small rasters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarow.operators import canopies, grating, mosaic, territory


def cells_of(spark, vine, barrier, valid=None):
    """One line per valid pixel of the masks."""
    valid = np.ones_like(vine) if valid is None else valid
    rows = [(int(x), int(y), bool(vine[y, x]), not bool(barrier[y, x])) for y, x in zip(*np.nonzero(valid))]
    return spark.createDataFrame(rows, "x int, y int, vine boolean, free boolean")


def flood(mask, seeds, around):
    seen, todo = set(seeds), list(seeds)
    while todo:
        y, x = todo.pop()
        for dy, dx in around:
            p = (y + dy, x + dx)
            if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def brute(vine, barrier, valid, steps, least_vine, least_area):
    """Cell by cell: grow, part, fill each part alone in scan order; later parts overwrite."""
    free = valid & ~barrier
    mask = vine & free
    for _ in range(steps):
        mask = np.array([[free[y, x] and mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(mask.shape[1])] for y in range(mask.shape[0])])
    out, seen = {}, set()
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        part = flood(mask, [(y, x)], EIGHT)
        seen |= part
        padded = np.ones((mask.shape[0] + 2, mask.shape[1] + 2), bool)
        for a, b in part:
            padded[a + 1, b + 1] = False
        outside = flood(padded, [(0, 0)], FOUR)
        filled = [(a, b) for a, b in zip(*np.nonzero(free)) if (a + 1, b + 1) not in outside]
        if sum(vine[p] for p in part) >= least_vine and len(filled) >= least_area:
            out |= {(int(b), int(a)): int(y) * territory.LINE + int(x) for a, b in filled}
    return out


def found(df):
    return {(r.x, r.y): r.territory for r in df.collect()}


def test_a_narrow_gap_is_grown_over_a_wide_one_is_not(spark):
    vine = np.zeros((1, 12), bool)
    vine[0, [0, 4, 11]] = True
    got = found(territory.territories(cells_of(spark, vine, np.zeros_like(vine)), 2, 1, 1))
    assert got[0, 0] == got[4, 0] != got[11, 0]


def test_a_barrier_parts_a_narrow_gap(spark):
    vine, barrier = np.zeros((1, 8), bool), np.zeros((1, 8), bool)
    vine[0, [0, 4]], barrier[0, 2] = True, True
    got = found(territory.territories(cells_of(spark, vine, barrier), 2, 1, 1))
    assert got[0, 0] != got[4, 0] and (2, 0) not in got


def test_numbers_run_from_the_north(spark):
    rows = [(x, y, 7) for x in (0, 1) for y in (4, 5)] + [(x, y, 9) for x in (2, 3) for y in (0, 1)]
    got = territory.north_west_order(spark.createDataFrame(rows, "x int, y int, territory long")).collect()
    assert {r.territory: (r.place, r.cells) for r in got} == {9: (1, 4), 7: (2, 4)}


def test_nested_rings(spark):
    vine = np.zeros((17, 17), bool)
    for a, b in ((0, 17), (3, 14), (6, 11), (8, 9)):
        vine[a:b, a:b] = True
        vine[a + 1 : b - 1, a + 1 : b - 1] = False
    none = np.zeros_like(vine)
    for least_area in (1, 60, 130):  # all four; the inner ones fall to what is around them
        assert found(territory.territories(cells_of(spark, vine, none), 0, 1, least_area)) == brute(vine, none, ~none, 0, 1, least_area)


@pytest.mark.parametrize("seed,steps", [(1, 0), (3, 1), (4, 2)])
def test_territories_against_brute_force(spark, seed, steps):
    r = np.random.default_rng(seed)
    vine, barrier, valid = r.random((24, 30)) < (0.5, 0.08, 0.03)[steps], r.random((24, 30)) < 0.15, r.random((24, 30)) < 0.97
    want = brute(vine & valid, barrier, valid, steps, 2, 5)
    assert want and found(territory.territories(cells_of(spark, vine, barrier, valid), steps, 2, 5, tile=7)) == want


def test_no_cells_repeated_lines_and_nulls(spark):
    schema = "x int, y int, vine boolean, free boolean"
    assert territory.territories(spark.createDataFrame([], schema), 1, 1, 1).count() == 0
    rows = [(0, 0, None, True), (0, 0, True, True), (1, 0, True, True), (1, 0, True, False), (2, 0, True, None), (None, 0, True, True)]
    assert found(territory.territories(spark.createDataFrame(rows, schema), 1, 1, 1)) == {(0, 0): 0}


def canopy_cells(spark, *masks):
    rows = [(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "canopy int, x int, y int")


def blobs(seed):
    """Discs that overlap, with some cells knocked out."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:40, :60]
    m = np.zeros((40, 60), bool)
    for cx, cy, s in ((12, 14, 9), (28, 18, 8), (44, 22, 10), (30, 33, 5)):
        m |= (x - cx) ** 2 + (y - cy) ** 2 <= s * s
    return m & (r.random(m.shape) < 0.995)


def brute_heights(m):
    p = np.pad(m, 1)
    out = np.argwhere(~p)
    return {(int(x) - 1, int(y) - 1): int(((out - (y, x)) ** 2).sum(1).min()) for y, x in np.argwhere(p)}


def brute_opening(m):
    p = np.pad(m, 1)
    core = {(y, x) for y, x in np.argwhere(m) if all(p[y + 1 + a, x + 1 + b] for a, b in FOUR)}
    return {(int(x + b), int(y + a)) for y, x in core for a, b in [*FOUR, (0, 0)]}


def test_opening_and_heights_against_brute_force(spark):
    masks = [blobs(1), np.ones((5, 9), bool), np.random.default_rng(5).random((20, 20)) < 0.8]
    cells = canopy_cells(spark, *masks)
    got = {(r.canopy, r.x, r.y) for r in canopies.opened(cells.union(cells)).collect()}
    assert got == {(i, *p) for i, m in enumerate(masks) for p in brute_opening(m)}
    high = {(r.canopy, r.x, r.y): r.height2 for r in canopies.heights(cells, columns=7).collect()}
    assert high == {(i, *p): h for i, m in enumerate(masks) for p, h in brute_heights(m).items()}


def test_touching_canopies_are_parted(spark):
    m = blobs(2)
    small, neck = np.ones((6, 7), bool), np.zeros((15, 40), bool)
    neck[:, :15] = neck[:, 25:] = True
    neck[7, :] = True
    df = canopies.parted(canopy_cells(spark, m, small, neck), 5, 3.0, compact=20)
    parts = {(r.canopy, r.x, r.y): r.part for r in df.collect()}

    opening = brute_opening(m)
    mask = np.zeros_like(m)
    for x, y in opening:
        mask[y, x] = True
    high = brute_heights(mask)
    tops = {p for p, h in high.items() if h > 9 and all(high.get((p[0] + a, p[1] + b), 0) <= h for a in range(-5, 6) for b in range(-5, 6))}
    peak_mask = np.zeros_like(m)
    for x, y in tops:
        peak_mask[y, x] = True
    marker = {}
    for y, x in sorted((y, x) for x, y in tops):
        if (y, x) not in marker:
            marker |= {p: (y, x) for p in flood(peak_mask, [(y, x)], EIGHT)}
    assert len(set(marker.values())) >= 3
    want = {}
    for (y, x), name in marker.items():
        for a in range(-2, 3):
            for b in range(-2, 3):
                if a * a + b * b <= 5 and (x + b, y + a) in opening:
                    want[x + b, y + a] = max(name, want.get((x + b, y + a), (-1, -1)))
    edge = want
    while edge:
        step = {}
        for (x, y), name in edge.items():
            for a, b in FOUR:
                if (x + b, y + a) in opening and (x + b, y + a) not in want:
                    step[x + b, y + a] = min(name, step.get((x + b, y + a), (99, 99)))
        want |= step
        edge = step
    assert {(x, y): (p.y, p.x) for (c, x, y), p in parts.items() if c == 0} == want
    assert {p for (c, x, y), p in parts.items() if c == 1} == {(1, 0, 0)} and sum(c == 1 for c, _, _ in parts) == 42
    assert len({p for (c, x, y), p in parts.items() if c == 2}) == 2 and (2, 20, 7) not in parts  # the neck of one cell is gone


def test_no_canopies_and_sizes(spark):
    none = spark.createDataFrame([], "canopy int, x int, y int")
    assert canopies.parted(none, 5, 3.0).count() == 0
    cells = canopy_cells(spark, np.ones((5, 5), bool), np.ones((9, 9), bool), np.ones((12, 12), bool))
    got = canopies.parted(cells, 5, 9.0, 50, 100, compact=99).groupBy("canopy").count().collect()
    assert [(r.canopy, r["count"]) for r in got] == [(1, 81)]


def test_canopies_taken_apart_whole_and_by_cells(spark):
    """Small canopies need no joins of cells, and both ways give the same parts, repeated lines and boxes included."""
    r = np.random.default_rng(3)
    boxes = [(i, x, y, x + int(r.integers(4, 31)), y + int(r.integers(4, 21))) for i in range(60) for x, y in r.integers(-5, 20, (3, 2)).tolist()]
    spans = spark.createDataFrame(boxes + boxes[:9], "canopy long, x int, y int, x1 int, y1 int")
    got = canopies.parted(spans, 5, 3.0, 20, 700, compact=25)
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and "Window" not in got._jdf.queryExecution().toString()
    want = {tuple(x) for x in canopies.parted(spans, 5, 3.0, 20, 700, compact=25, wide=0).collect()}
    assert {tuple(x) for x in got.collect()} == want and len({x[3] for x in want}) > 60
    assert {tuple(x) for x in canopies.parted(spans, 5, 3.0, 20, 700, compact=25, wide=30).collect()} == want


#: Boxes of one canopy with a corner between a cell and a higher one.
CORNERED = [(14, 9, 39, 19), (19, 1, 31, 8), (9, 16, 16, 22)]


def test_peaks_look_at_the_whole_square(spark):
    """A higher cell counts where the column between has no cell on its line."""
    m = np.zeros((45, 60), bool)
    for x0, y0, x1, y1 in CORNERED:
        m[y0 : y1 + 1, x0 : x1 + 1] = True
    opening = np.zeros_like(m)
    for x, y in brute_opening(m):
        opening[y, x] = True
    high = brute_heights(opening)
    tops = {p for p, h in high.items() if h > 9 and all(high.get((p[0] + a, p[1] + b), 0) <= h for a in range(-5, 6) for b in range(-5, 6))}
    got = canopies.peaks(canopies.heights(canopy_cells(spark, opening)), 5, 3.0)
    assert {(r.x, r.y) for r in got.collect()} == tops


SHAPE = "raster int, place int, zone int, a double, b double, c double, d double, e double, f double, width int, height int"


def utm(lon, lat, zone):
    """Easting and northing by Krueger's series to the third order, in plain floats."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    s = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(math.radians(lat))) - s * math.atanh(s * math.sin(math.radians(lat))))
    lam = math.radians(lon - (zone * 6 - 183))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    al = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    r = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = eta + sum(k * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, k in enumerate(al, 1))
    return 500000 + r * e, r * (xi + sum(k * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, k in enumerate(al, 1)))


def full(spark, rasters):
    rows = [(r[0], x, y, r[0] * 1000 + y * r[9] + x) for r in rasters for y in range(r[10]) for x in range(r[9])]
    return spark.createDataFrame(rows, "raster int, px int, py int, v int")


def test_aligned_rasters_are_copied_and_the_last_is_on_top(spark):
    rasters = [(1, 1, 35, 0.5, 0.0, 100.0, 0.0, -0.5, 200.0, 4, 3), (2, 2, 35, 0.5, 0.0, 101.0, 0.0, -0.5, 199.5, 4, 3)]
    df = spark.createDataFrame([*rasters, (3, 3, 35, None, 0.0, 0.0, 0.0, -0.5, 0.0, 9, 9)], SHAPE)
    grid = mosaic.grid_of(df)
    assert grid == mosaic.Grid(35, 100.0, 200.0, 0.5, 0.5, 6, 4)
    got = {(r.col, r.row): r.v for r in mosaic.mosaic(df, full(spark, rasters), ["v"], grid).collect()}
    want = {(c + i * 2, r + i): (i + 1) * 1000 + r * 4 + c for i in (0, 1) for r in range(3) for c in range(4)}
    assert got == want
    assert mosaic.grid_of(df.where("raster > 2")) is None and mosaic.mosaic(df.limit(0), full(spark, rasters), ["v"], grid).count() == 0


def test_a_raster_in_degrees_lands_where_its_pixels_are(spark):
    east, north = utm(28.9, 47.1, 35)
    step = 1e-5
    rasters = [(1, 1, 35, 0.5, 0.0, east - 10, 0.0, -0.5, north + 5, 30, 30), (2, 2, 0, step, 0.0, 28.9, 0.0, -step, 47.1, 12, 9)]
    df = spark.createDataFrame(rasters, SHAPE)
    grid = mosaic.grid_of(df)
    assert grid.zone == 35 and (grid.x, grid.y) == (0.5, 0.5) and abs((grid.x0 - (east - 10)) % 0.5) < 1e-6
    got = {(r.col, r.row): r.v for r in mosaic.mosaic(df, full(spark, rasters), ["v"], grid, over=False).collect()}
    for y in range(9):
        for x in range(12):
            e, n = utm(28.9 + (x + 0.5) * step, 47.1 - (y + 0.5) * step, 35)
            assert got[math.floor((e - grid.x0) / 0.5), math.floor((grid.y0 - n) / 0.5)] == 2000 + y * 12 + x
    assert sum(v < 2000 for v in got.values()) > 600
    over = mosaic.mosaic(df, full(spark, rasters), ["v"], grid)
    assert over.where("v = 0").count() > 0 and over.count() >= len(got)


def field(angle, spacing, gsd=0.5, n=48):
    """Luminance of rows across an angle, with some noise."""
    y, x = np.mgrid[:n, :n]
    t = np.deg2rad(angle)
    a = 100 + 60 * np.cos(2 * np.pi * (x * np.cos(t) + y * np.sin(t)) * gsd / spacing) + np.random.default_rng(3).normal(0, 4, (n, n))
    return [(int(i), int(j), float(a[j, i]), float(a[j, i]), float(a[j, i])) for j in range(n) for i in range(n)], a


RGB = "x int, y int, red double, green double, blue double"


def test_grating_energies_against_plain_sums(spark):
    rows, a = field(30, 2.7)
    moved = [(x + 30, y + 30, *v) for x, y, *v in rows]  # over four tiles of 54, the smallest there are
    got = {(r.x - 30, r.y - 30): r for r in grating.energy(spark.createDataFrame(moved, RGB), 0.5, tile=1).collect()}
    assert len(got) == a.size
    size, n = 25, a.shape[0]
    p = np.pad(a, 12)
    mean = np.array([[p[y : y + size, x : x + size].sum() / size**2 for x in range(n)] for y in range(n)])
    square = np.array([[(p[y : y + size, x : x + size] ** 2).sum() / size**2 for x in range(n)] for y in range(n)])
    z = (a - mean) / np.sqrt(np.maximum(square - mean**2, 1e-4))

    def at(x, y, degrees):
        best = 0
        for s in grating.SPACINGS:
            k = grating.wave(s / 0.5, degrees)[::-1, ::-1]
            h = k.shape[0] // 2
            q = np.pad(z, h)
            part = [(q[j : j + 2 * h + 1, i : i + 2 * h + 1] * k).sum() ** 2 for j in range(y - 2, y + 3) for i in range(x - 2, x + 3) if 0 <= i < n and 0 <= j < n]
            best = max(best, sum(part) / 25)
        return best

    for x, y in ((0, 0), (24, 24), (47, 11), (30, 46)):
        all_ = [at(x, y, d) for d in grating.ANGLES]
        assert abs(got[x, y].peak - max(all_)) <= 1e-9 * max(all_) and abs(got[x, y].second - sorted(all_)[-2]) <= 1e-9 * max(all_)
        assert got[x, y].degrees == grating.ANGLES[int(np.argmax(all_))]
    assert sum(r.degrees == 30 for r in got.values()) > 0.9 * len(got)


def test_rows_score_above_noise(spark):
    rows, _ = field(120, 2.7)
    noise = [(x + 200, y, *[float(v)] * 3) for (x, y, *_), v in zip(rows, np.random.default_rng(4).normal(100, 30, len(rows)))]
    got = grating.scores(grating.energy(spark.createDataFrame(rows + noise, RGB), 0.5)).groupBy((F.col("x") >= 200).alias("noise")).agg(F.avg("score").alias("s"), F.avg("peakiness").alias("p")).collect()
    by = {r.noise: r for r in got}
    assert by[False].s > 5 * by[True].s and by[False].p > 1.35
    assert grating.scores(grating.energy(spark.createDataFrame([], RGB), 0.5)).count() == 0
