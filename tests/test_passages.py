"""Graphs of passages: every triangle against all points, areas, counts, ways and entries against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarow.operators import passages

RING = "passage long, hole boolean, ring array<struct<x:double,y:double>>"
SQUARE = [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]
BEND = [(0.0, 0.0), (60.0, 0.0), (60.0, 40.0), (54.0, 40.0), (54.0, 6.0), (0.0, 6.0)]


def ring_road(x0, y0, w, h, t):
    box = lambda d: [(x0 + d, y0 + d), (x0 + w - d, y0 + d), (x0 + w - d, y0 + h - d), (x0 + d, y0 + h - d)]
    return box(0.0), box(t)


@pytest.fixture(scope="module")
def rings(spark):
    out, hole = ring_road(500000.0, 6200000.0, 90.0, 70.0, 7.0)
    bow = [(300 + 60 * math.cos(a), 60 * math.sin(a)) for a in np.linspace(0, 4, 40)] + [(300 + 52 * math.cos(a), 52 * math.sin(a)) for a in np.linspace(4, 0, 40)]
    rows = [(1, False, BEND), (2, False, out[::-1]), (2, True, hole), (3, False, SQUARE), (4, False, [(float(x), float(y)) for x, y in bow]), (5, False, [(0.0, 0.0), (1.0, 0.0)]), (6, False, None), (7, False, []), (8, False, [(0.0, 0.0), (5.0, None), (5.0, 5.0)])]
    return spark.createDataFrame(rows, RING).cache()


def corners(df):
    return sorted(tuple(r)[:7] for r in df.drop("radius").collect())


def test_outlines_are_densified_and_turned(spark, rings):
    points = passages.outline_points(rings, 6.0)
    areas = {r.passage: r.area2 / 2e6 for r in passages.outline_areas(points).collect()}
    assert set(areas) == {1, 2, 3, 4}
    assert areas[1] == pytest.approx(60 * 6 + 6 * 34) and areas[2] == pytest.approx(90 * 70 - 76 * 56) and areas[3] == pytest.approx(40000)
    far = points.where((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2 > 6002.0**2)
    assert far.isEmpty()
    assert points.where("passage = 1").count() == 10 + 7 + 1 + 6 + 9 + 1
    closed = spark.createDataFrame([(1, False, [*BEND, BEND[0]])], RING)
    assert sorted(map(tuple, passages.outline_points(closed, 6.0).collect())) == sorted(map(tuple, points.where("passage = 1").collect()))


def test_every_circle_is_empty_and_outlines_are_filled(rings):
    points = passages.outline_points(rings, 6.0).cache()
    found = passages.triangles(points, 6.0, tile=40.0).cache()
    at = {}
    for r in points.collect():
        at.setdefault(r.passage, set()).add((r.x, r.y))
    for r in found.collect():
        (ax, ay), (bx, by), (cx, cy) = (r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        near = min(math.hypot(x - ax - ux, y - ay - uy) for x, y in at[r.passage])
        # points move by less than half a millimetre; how far that moves a circle hangs on the triangle's height
        radius = math.hypot(ux, uy)
        longest = max(math.hypot(bx, by), math.hypot(cx, cy), math.hypot(cx - bx, cy - by))
        assert near > radius - 4 * radius * longest / abs(d) - 4
    held = {r.passage: (r.n, r.s) for r in found.groupBy("passage").agg(F.count("*").alias("n"), F.sum("area2").alias("s")).collect()}
    whole = {r.passage: r.area2 for r in passages.outline_areas(points).collect()}
    assert {p: s for p, (_, s) in held.items()} == whole
    # n points around h holes make n + 2 h - 2 triangles
    assert {p: n for p, (n, _) in held.items()} == {p: len(at[p]) + (0 if p == 2 else -2) for p in at}


def test_tiles_do_not_change_triangles(rings):
    points = passages.outline_points(rings, 6.0).cache()
    whole = corners(passages.triangles(points, 6.0, tile=1000.0, border=400.0))
    assert corners(passages.triangles(points, 6.0, tile=24.0)) == whole
    assert corners(passages.triangles(points.union(points), 6.0, tile=64.0, border=7.0)) == whole


def test_ways_are_charged_for_what_lies_outside(spark, rings):
    points = passages.outline_points(rings.where("passage IN (1, 2)"), 6.0).cache()
    found = passages.triangles(points, 6.0).cache()
    ways = passages.passage_edges(found, points, most=100.0).cache()
    # n points around h holes: n + 3 h - 3 shared sides
    assert {r.passage: r["count"] for r in ways.groupBy("passage").count().collect()} == {p: n - 3 + 3 * (p == 2) for p, n in ((r.passage, r["count"]) for r in points.groupBy("passage").count().collect())}

    def inside(x, y, poly):
        return sum(((ay > y) != (by > y)) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1], strict=True)) % 2 == 1

    for r in ways.where("passage = 1").collect():
        share = np.mean([not inside(r.x0 + t * (r.x1 - r.x0), r.y0 + t * (r.y1 - r.y0), BEND) for t in (np.arange(2000) + 0.5) / 2000])
        size = math.hypot(r.x1 - r.x0, r.y1 - r.y0)
        assert r.off == pytest.approx(share * size, abs=0.003 * size + 1e-3) and r.w == pytest.approx(size + 9 * r.off)
    assert passages.passage_edges(found.limit(0), points).isEmpty()


def test_zones_part_the_graph_and_the_larger_part_is_kept(spark, rings):
    points = passages.outline_points(rings.where("passage = 1"), 6.0).cache()
    found = passages.triangles(points, 6.0).cache()
    zone = spark.createDataFrame([(1, [(40.0, -5.0), (41.0, -5.0), (41.0, 11.0), (40.0, 11.0)])], "passage long, ring array<struct<x:double,y:double>>")
    cut = passages.passage_edges(found, points, zone).cache()
    assert 0 < cut.count() < passages.passage_edges(found, points).count()
    assert cut.where("least(x0, x1) < 40 AND greatest(x0, x1) > 41").isEmpty()
    kept = passages.reachable(cut).cache()
    east, west = cut.where("x0 > 40").count(), cut.where("x0 < 40").count()
    assert kept.count() == max(east, west) and passages.reachable(cut.limit(0)).isEmpty()
    assert kept.select(F.countDistinct(F.col("x0") > 40)).first()[0] == 1


def test_entries_are_the_nearest_nodes(spark, rings):
    points = passages.outline_points(rings.where("passage IN (1, 4)"), 6.0).cache()
    ways = passages.passage_edges(passages.triangles(points, 6.0), points).cache()
    starts = spark.createDataFrame([(1, -3.0, 2.0), (2, 20000.0, 5.0), (3, 57.0, 33.0), (4, 300.0, 0.0)], "start int, x double, y double")
    nodes = {(r.a, r.x0, r.y0) for r in ways.collect()} | {(r.b, r.x1, r.y1) for r in ways.collect()}
    got = {r.start: (r.node, r.w) for r in passages.entered(ways, starts).collect()}
    for s in starts.collect():
        d, name = min((math.hypot(x - s.x, y - s.y), n) for n, x, y in nodes)
        assert got[s.start][0] == name and got[s.start][1] == pytest.approx(d)
    assert passages.entered(ways.limit(0), starts).isEmpty() and passages.entered(ways, starts.limit(0)).isEmpty()


def test_whole_passages_give_the_triangles_of_tiles(spark, rings):
    points = passages.outline_points(rings, 6.0).cache()
    want = corners(passages.triangles(points, 6.0, tile=40.0, whole=0))
    assert corners(passages.triangles(points, 6.0)) == want
    assert corners(passages.triangles(points, 6.0, whole=60)) == want  # some whole, some by tiles


def test_a_mesh_where_outlines_are_no_sides_of_triangles():
    rng = np.random.default_rng(5)
    for n in (3, 8, 60):  # stars: sides of theirs cross triangles
        a = np.sort(rng.uniform(0, 2 * math.pi, n))
        r = rng.uniform(2000, 60000, n)
        ring = np.column_stack([np.rint(70000 + r * np.cos(a)), np.rint(70000 + r * np.sin(a))]).astype(np.int64)
        p = np.column_stack([ring, np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)])
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        mx, my = passages._moved(p[:, 0], p[:, 1])
        t, _ = passages.delaunay(p[:, 0] + mx, p[:, 1] + my)
        want = sorted(tuple(sorted(c)) for c in t.tolist() if passages._inside(np.array(c), p))
        assert sorted(map(tuple, passages.whole_mesh(p, 1e6)[0].tolist())) == want


def test_a_passage_takes_a_few_milliseconds():
    import time

    out, hole = ring_road(0.0, 0.0, 90.0, 70.0, 7.0)
    p = []
    for ring in (out, hole[::-1]):
        dense = np.concatenate([np.linspace(q, r, 18, endpoint=False) for q, r in zip(np.array(ring), np.roll(np.array(ring), -1, axis=0))])
        mm = np.rint(dense * 1000).astype(np.int64)
        p.append(np.column_stack([mm, np.roll(mm, 1, axis=0), np.roll(mm, -1, axis=0)]))
    p = np.concatenate(p)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    assert len(passages.whole_mesh(p)[0]) == len(p)
    began = time.process_time()
    for _ in range(50):
        passages.whole_mesh(p)
    assert time.process_time() - began < 50 * 0.02  # by tiles and points one after another it took some 0.1 s


def test_graphs_are_made_in_one_pass(spark, rings):
    """Streamed graphs equal triangles and ways by their own operators; nothing but the rings is shuffled."""
    points = passages.outline_points(rings, 6.0).cache()
    found = passages.triangles(points, 6.0, whole=0).cache()
    want = corners(found)
    thrice = lambda c: F.floor(F.col(c) * 3000 + 0.5).cast("long")
    ways = passages.passage_edges(found, points).select("passage", *(thrice(c) for c in ("x0", "y0", "x1", "y1")), F.round("off", 6), F.round("w", 6))
    roads = {tuple(r) for r in ways.collect()}
    assert want and roads
    for whole in (1000, 60, 0):
        made = passages.graphs(rings, 6.0, whole=whole).cache()
        assert corners(made.select("passage", F.explode("triangles").alias("t")).select("passage", "t.*")) == want
        got = made.select("passage", F.explode("ways").alias("v")).select("passage", "v.ax3", "v.ay3", "v.bx3", "v.by3", F.round("v.off", 6), F.round("v.w", 6))
        assert sorted(map(tuple, got.collect())) == sorted(roads)
    plan = passages.graphs(rings, 7.0)._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_passages_at_once_equal_those_alone():
    """Roads around yards: meshes and ways of many at once, by points near by, equal those of one, by all points."""
    r = np.random.default_rng(4)
    rings = [np.array([(0, 0), (w, 0), (w, h), (0, h)], float) + r.uniform(0, 500, 2) for w, h in r.uniform(30, 90, (30, 2))]
    rings[3][1] += (-20, 9)
    size, x, y = np.full(60, 4), [], []
    for i, o in enumerate(rings):
        for q in (o, o.mean(0) + (o - o.mean(0)) * r.uniform(0.3, 0.9)):
            x, y = [*x, *q[:, 0]], [*y, *q[:, 1]]
    gid, p = passages.whole_outlines(np.repeat(np.arange(30), 2), size, np.arange(60) % 2 == 1, np.array(x), np.array(y), 5.0)
    t, area2, radius, done, near = passages.whole_meshes(gid, p, 10.0, 18000.0)
    assert done.sum() > 9
    ways, of = passages.whole_ways(p, p, t, 2.0, 9.0, near, 18000.0)
    for k in np.flatnonzero(done):
        own, q = gid[t[:, 0]] == k, p[gid == k]
        one = passages.whole_mesh(q, 10.0)
        assert sorted(map(tuple, (t[own] - np.flatnonzero(gid == k)[0]).tolist())) == sorted(map(tuple, one[0].tolist()))
        some = ways[gid[of] == k]
        if not np.isnan(some).any():
            assert sorted(map(tuple, some.tolist())) == sorted(map(tuple, passages.whole_ways(q, q, one[0], 2.0, 9.0)[0].tolist()))
