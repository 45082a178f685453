"""Fixtures with known outcomes: grid, rows, geometry, clusters, kernels, sources, streaming."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarow.functions import geom, grid, text
from terrarow.operators import graph, greedy, raster, routing, rows, spatial
from terrarow.sources import annotation_xml, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_grid_start_point(spark):
    e, n = F.lit(629504.70), F.lit(5220250.75)
    c, r = grid.tile_of_x(e), grid.tile_of_y(n)
    got = one(spark, r.alias("r"), c.alias("c"), grid.pixel_x(c, e).alias("px"), grid.pixel_y(r, n).alias("py"))
    assert (got.r, got.c) == (18, 10) and 20 <= got.px <= 35 and 1990 <= got.py <= 2010


def test_projection_pair(spark):
    e, n = grid.utm_from_lonlat(F.lit(28.7073776), F.lit(47.1230335))
    got = one(spark, e.alias("e"), n.alias("n"))
    assert abs(got.e - 629504.7) < 0.1 and abs(got.n - 5220250.75) < 0.1


def test_ring_functions(spark):
    ring = geom.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(3))
    line = F.array(*(geom.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (0, 0), (3, 4))))
    got = one(spark, geom.length(line).alias("l"), geom.area(F.array(ring)).alias("a"), F.size(geom.without_repeats(line)).alias("n"), geom.contains(ring, F.lit(1), F.lit(1)).alias("i"), geom.contains(ring, F.lit(5), F.lit(1)).alias("o"), geom.at_distance(line, F.lit(2.5))["x"].alias("x"), F.size(geom.strip(geom.without_repeats(line), 0.6)).alias("s"))
    assert (got.l, got.a, got.n, got.i, got.o, got.s) == (5.0, 12.0, 2, True, False, 4) and abs(got.x - 1.5) < 1e-9


def test_empty_line(spark):
    got = one(spark, geom.length(F.array().cast("array<struct<x:double,y:double>>")).alias("l"))
    assert got.l == 0.0


def test_interval_subtraction(spark):
    cut = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in ((2, 3), (5, 9))))
    got = one(spark, geom.subtract_intervals(F.lit(0), F.lit(8), cut).alias("x")).x
    assert [(p.a, p.b) for p in got] == [(0.0, 2.0), (3.0, 5.0)]


def test_points_round_trip(spark):
    got = one(spark, text.format_points(text.parse_points(F.lit("1.25,2; ;3,4.5"))).alias("t"))
    assert got.t in ("1.3,2.0;3.0,4.5", "1.2,2.0;3.0,4.5")


def test_gap_bounds_are_inclusive(spark):
    vines = spark.createDataFrame([(1, 1, i, 1, s, 0) for i, s in enumerate((0, 499, 999, 1499))], "block_no int, row_no int, l_orderkey int, l_linenumber int, s_cm bigint, t_cm bigint")
    top = [r for r in rows.gap_report(vines).collect() if r.level == "total"][0]
    assert (top.gap_count, top.max_gap_cm, top.disrupted_rows) == (2, 500, 1)


def test_cluster_threshold(spark):
    df = spark.createDataFrame([(1, v) for v in (0, 2, 5, 9)], "k int, v int")
    got = {r.v: r.cluster for r in rows.gap_clusters(df, ["k"], "v", 3).collect()}
    assert got == {0: 0, 2: 0, 5: 1, 9: 2}


def test_majority_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z")], "k int, v string")
    assert {r.k: r.winner for r in rows.majority(df, ["k"], "v").collect()} == {1: "a", None: "z"}


def test_long_row_ids(spark):
    got = one(spark, text.row_name(F.lit("V01"), F.lit(7), F.lit(99)).alias("a"), text.row_name(F.lit("V01"), F.lit(7), F.lit(100)).alias("b"))
    assert (got.a, got.b) == ("V01-R07", "V01-R007")


def test_distance_pairs_match_brute_force(spark):
    g = np.random.default_rng(1)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(g.uniform(-50, 50, (150, 2)))]
    a, b = spark.createDataFrame(p, "i int, x double, y double"), spark.createDataFrame(p, "j int, u double, v double")
    got = {(r.i, r.j) for r in spatial.distance_pairs(a, b, "x", "y", "u", "v", 9.0).collect()}
    assert got == {(i, j) for i, x, y in p for j, u, v in p if (x - u) ** 2 + (y - v) ** 2 <= 81}


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101)], "a bigint, b bigint"))
    got = {r.id: r.label for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_regions_and_barrier(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (4, 0)], "x int, y int")
    assert {(r.x, r.y): r.region for r in raster.regions(cells, "x", "y", 10).collect()} == {(0, 0): 0, (1, 1): 0, (4, 0): 4}


def test_window_starts(spark):
    assert one(spark, raster.window_starts(2048, 640, 512).alias("w")).w == [0, 512, 1024, 1408]


def test_suppression_keeps_the_best(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 40, 40, 0.55), (1, 2, 5, 5, 45, 45, 0.88), (1, 3, 0, 120, 40, 160, 0.75)], "t int, box_id int, xtl int, ytl int, xbr int, ybr int, score double")
    assert {r.box_id for r in greedy.polygon_suppression(b, "t").collect()} == {2, 3}


def test_clip_and_hull_and_union():
    ring = np.array([(-5, -5), (5, -5), (5, 5), (-5, 5)], float)
    cut = greedy.clip_polygon(ring, 0, 0, 10, 10)
    assert len(cut) == 4 and cut.min() == 0 and cut.max() == 5
    a, b = greedy.least_rectangle(np.array([(0, 0), (10, 0), (10, 2), (0, 2), (5, 1)], float))
    assert sorted([tuple(a), tuple(b)]) == [(0, 1), (10, 1)]
    assert greedy.union_area(np.array([(0, 0, 2, 2), (1, 1, 3, 3)], float)) == 7
    assert len(greedy.simplify(np.array([(0, 0), (1, 0.1), (2, 0)], float), 0.2)) == 2


def test_tour_without_obstacles():
    line, length, missed = routing.walk(np.zeros(2), np.array([(5.0, 0.0), (0.0, 5.0)]), [])
    assert abs(length - (10 + math.sqrt(50))) < 1e-9 and not missed and (line[0] == line[-1]).all()


def test_walk_goes_around_a_wall():
    wall = np.array([(1, -5), (2, -5), (2, 5), (1, 5)], float)
    line, length, missed = routing.walk(np.zeros(2), np.array([(3.0, 0.0)]), [wall])
    assert not missed and length > 6 and not any(routing.enters(wall, a, b) for a, b in zip(line, line[1:]))


def test_sealed_target_is_unreachable():
    room = [np.array(r, float) for r in ([(4, 4), (8, 4), (8, 5), (4, 5)], [(4, 7), (8, 7), (8, 8), (4, 8)], [(4, 4), (5, 4), (5, 8), (4, 8)], [(7, 4), (8, 4), (8, 8), (7, 8)])]
    _, _, missed = routing.walk(np.zeros(2), np.array([(6.0, 6.0), (1.0, 0.0)]), room)
    assert missed == [0]


XML = """<annotations><image id="0" name="a/t1.tif" width="100" height="80">
<polygon label="vineyard" points="0.0,0.0;4.0,0.0;4.0,3.0"><attribute name="vineyard_id">V02</attribute></polygon>
<box label="waste" xtl="1" ytl="2" xbr="3" ybr="5"/></image>
<image id="1" name="t1.tif" width="100" height="80"><polyline label="row" points="0,0;5,5"><attribute name="row_id"></attribute></polyline></image></annotations>"""


def test_xml_round_trip(spark, tmp_path):
    (tmp_path / "in.xml").write_text(XML)
    images = annotation_xml.read_images(spark, str(tmp_path / "in.xml"))
    assert images.count() == 2
    got = annotation_xml.shapes(images, annotation_xml.DEFAULTS).collect()
    assert [(r.image, r.shape, len(r.ring)) for r in got] == [("t1.tif", "polyline", 2)]  # the last image of a name stays
    assert got[0].attributes["vineyard_id"] == "V01"
    rows_ = annotation_xml.shapes(images.where("_id = 0"))
    annotation_xml.write_images(rows_, str(tmp_path / "out"))
    text_ = "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert 'points="0.0,0.0;4.0,0.0;4.0,3.0"' in text_ and 'xbr="3.0"' in text_ and "V02" in text_


def test_part_and_kind(spark):
    got = one(spark, tables.part_of(F.lit("/x/part_a/sub/t.tif")).alias("a"), tables.part_of(F.lit("/x/t.tif")).alias("b"), tables.file_kind(F.unhex(F.lit("49492A0008"))).alias("c"))
    assert (got.a, got.b, got.c) == ("part_a", "default", "tiff")


def test_geojson(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"1"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    r = tables.read_geojson(spark, str(tmp_path / "f.json")).first()
    assert (r.type, r.properties, r.coordinates) == ("Point", {"n": "1"}, "[1,2]")


def test_running_gaps_stream(spark, tmp_path):
    from terrarow.streaming.gaps import running_gaps

    spark.createDataFrame([("r", 0.0), ("r", 4.0), ("r", 9.5)], "row string, s double").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = running_gaps(spark.readStream.schema("row string, s double").parquet(str(tmp_path / "in")), "row", "s", 5.0).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.s, r.gap) for r in spark.sql("SELECT * FROM gaps").collect()] == [(9.5, 5.5)]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("bad", ["", "no tile"])
def test_names_without_tile(spark, bad):
    assert one(spark, grid.tile_row(F.lit(bad)).alias("r")).r is None


def test_interval_and_box_pairs_match_brute_force(spark):
    g = np.random.default_rng(4)
    p = [(i, int(a), int(a + w), int(b), int(b + h)) for i, (a, w, b, h) in enumerate(zip(g.integers(-200, 200, 120), g.integers(1, 90, 120), g.integers(-200, 200, 120), g.integers(1, 90, 120)))]
    a = spark.createDataFrame(p, "i int, xtl int, xbr int, ytl int, ybr int")
    b = spark.createDataFrame(p, "j int, xtl_b int, xbr_b int, ytl_b int, ybr_b int")
    meet = lambda p0, p1, q0, q1: p0 < q1 and q0 < p1
    lines = [(r.i, r.j) for r in spatial.interval_pairs(a, b, "xtl", "xbr", "xtl_b", "xbr_b", 32).collect()]
    want = {(x[0], y[0]) for x in p for y in p if meet(x[1], x[2], y[1], y[2])}
    assert len(lines) == len(want) and set(lines) == want
    boxes = [(r.i, r.j) for r in spatial.box_pairs(a, b, 32).collect()]
    want = {(x[0], y[0]) for x in p for y in p if meet(*x[1:3], *y[1:3]) and meet(*x[3:], *y[3:])}
    assert len(boxes) == len(want) and set(boxes) == want


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (8, 9, 1)], "a bigint, b bigint, w bigint")
    got = {r.id: r.dist for r in graph.shortest_paths(edges, spark.range(1)).collect()}
    assert got == {0: 0, 1: 3, 2: 1, 3: 8}


def test_shortest_paths_of_many_edges(spark):
    edges = spark.range(70).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).cast("bigint").alias("w"))
    assert {r.id: r.dist for r in graph.shortest_paths(edges, spark.range(1)).collect()} == {i: i for i in range(71)}


def test_points_on_the_edges_of_a_box(spark):
    ring = geom.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(2))
    points = {(0, 1): True, (2, 0): True, (0, 0): True, (4, 1): False, (2, 2): False, (4, 2): False}
    rows = spark.createDataFrame(list(points), "x int, y int")
    assert {(r.x, r.y): r.i for r in rows.select("x", "y", geom.contains(ring, F.col("x"), F.col("y")).alias("i")).collect()} == points


def test_greedy_matching_and_links(spark):
    pairs = spark.createDataFrame([(1, 1, 7, 2.0), (1, 1, 8, 1.0), (1, 2, 8, 1.5), (1, 2, 7, 3.0)], "g int, l int, r int, cost double")
    assert {(r.l, r.r) for r in greedy.one_to_one(pairs, "g", "l", "r", "cost").collect()} == {(1, 8), (2, 7)}
    links = spark.createDataFrame([(1, 1, 1, 2, 0, 1.0), (1, 2, 1, 3, 0, 2.0), (1, 3, 1, 1, 0, 3.0), (1, 2, 0, 4, 0, 0.5)], "g int, a int, a_end int, b int, b_end int, cost double")
    assert {(r.a, r.b) for r in greedy.link_ends(links, "g").collect()} == {(2, 4), (2, 3), (3, 1)}


def test_merging_and_parallel_rows(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 0, 10, 1.0), (1, 2, 0.3, 10, 20, 1.0), (1, 3, 5.0, 0, 10, 1.0)], "g int, id int, off double, s0 int, s1 int, weight double")
    assert {r.id: r.merged for r in greedy.merge_collinear(spans, "g", 0.4, 1).collect()} == {1: 1, 2: 1, 3: 3}
    pairs = spark.createDataFrame([(1, 1, 2, 3.0, 2.0), (1, 2, 3, 2.0, 1.0)], "g int, a int, b int, density_a double, density_b double")
    assert [r.dropped for r in greedy.drop_parallel(pairs, "g").collect()] == [2]


def test_chains_use_each_end_once_over_all_links(spark):
    """Against plain greedy over all links, whatever group they are in; no cycle is closed."""
    r = random.Random(4)
    links = {}
    for _ in range(400):
        a, b = r.sample(range(60), 2)
        links[a, r.randrange(2), b, r.randrange(2)] = float(r.randrange(40))
    links = [(a, x, b, y, c) for (a, x, b, y), c in links.items()]
    used, up, want = set(), {}, set()

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, x, b, y, c in sorted(links, key=lambda k: (k[4], k[0], k[2], k[1], k[3])):
        if not {(a, x), (b, y)} & used and root(a) != root(b):
            used |= {(a, x), (b, y)}
            up[root(a)] = root(b)
            want.add((a, x, b, y))
    df = spark.createDataFrame(links, "a bigint, a_end int, b bigint, b_end int, cost double")
    assert {(k.a, k.a_end, k.b, k.b_end) for k in greedy.chains(df).collect()} == want


def test_linked_ends_and_rows_at_scale(spark):
    """No end is used twice and no cycle closed; a physical row is a chain of linked segments."""
    from terrarow.plans.registry import QUERIES

    links = QUERIES["linked_ends"](spark, "/root/testdata/sf0.01").collect()
    ends = [(k.a, k.a_end) for k in links] + [(k.b, k.b_end) for k in links]
    assert len(ends) == len(set(ends)) > 1000
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for k in links:
        assert root(k.a) != root(k.b)
        up[root(k.a)] = root(k.b)


def test_uploads_beyond_the_budget_lose_no_member(spark):
    rows = [("u", "a", 1, "x/1.tif", 60), ("u", "b", 1, "x/2.XML", 50), ("u", "b", 2, "__MACOSX/3.tif", 900), ("u", "b", 3, "x/../4.tif", 900), ("v", "a", 1, "5.tiff", 100), ("v", "a", 2, "d/", 9), ("v", "a", 3, ".6.tif", 9)]
    got = tables.archive_members(spark.createDataFrame(rows, "upload string, archive string, place int, name string, size int"), 100).collect()
    assert sorted((r.upload, r.archive, r.place, r.used, r.accepted) for r in got) == [("u", "a", 1, 60, False), ("u", "b", 1, 110, False), ("v", "a", 1, 100, True)]


def test_interpolation_without_knots_and_at_knots(spark):
    knots = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 3.0)], "k string, s int, v double")
    at = spark.createDataFrame([("a", 5), ("a", 10), ("a", 15), ("a", 30), ("b", 1)], "k string, s int")
    assert {(r.k, r.s): r.v for r in rows.interpolated(knots, at, ["k"], "s", "v").collect()} == {("a", 5): 1.0, ("a", 10): 1.0, ("a", 15): 2.0, ("a", 30): 3.0, ("b", 1): None}
