"""Joins of dense and repeated data: no side that rows were repeated in goes through the driver, copies are not paired, results equal brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarow.operators import greedy, spatial
from terrarow.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["distance_join", "linked_segments", "corridor_pairs", "boundary_pairs", "strip_pairs"])
def test_repeated_rows_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def part(spark, tmp_path, keys):
    rows = [(k, 5, 1.0) for k in keys]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_copies_of_boxes_are_counted(spark, tmp_path):
    n = 60_000  # pairing them takes minutes
    spark.range(n).select((F.col("id") * 2048).alias("p_partkey"), F.lit(5).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["duplicate_audit"](spark, str(tmp_path)).first()
    assert (got.duplicates, got.overlapping) == (n * (n - 1) // 2, n * (n - 1) // 2)


def test_each_pair_of_copies_is_one_row(spark, tmp_path):
    got = {(r.a, r.b) for r in QUERIES["box_overlaps"](spark, part(spark, tmp_path, [0, 2048, 4096])).collect()}
    assert got == {(0, 2048), (0, 4096), (2048, 4096)}
    plan = QUERIES["box_overlaps"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_list")  # copies are gathered below the join


def test_nearest_of_dense_points(spark):
    random.seed(3)
    a = [(i, *random.choice([(50, 50), (700, 20), (310, 333), (-900, 5)])) for i in range(60)]
    b = [(i, random.randrange(400), random.randrange(400)) for i in range(4000)]
    left, right = spark.createDataFrame(a, "i int, x int, y int"), spark.createDataFrame(b, "j int, u int, v int")
    got = {(r.i, r["rank"]): (r.j, r.d2) for r in spatial.nearest(left, right, "i", "x", "y", "u", "v", "j", 350, 3).collect()}
    want = {}
    for i, x, y in a:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b)[:3]
        want |= {(i, k + 1): (j, d2) for k, (d2, j) in enumerate(near) if d2 <= 350 * 350}
    assert got == want


def groups(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in range(n)}


@pytest.mark.parametrize("spread", [60, 200, 900])
def test_components_of_boxes_and_points(spark, spread):
    random.seed(spread)
    boxes = [(i, i % 2, x, y, x + random.randrange(1, 40), y + random.randrange(1, 40)) for i, x, y in ((i, random.randrange(spread), random.randrange(spread)) for i in range(150))]
    df = spark.createDataFrame(boxes, "id long, k int, xtl int, ytl int, xbr int, ybr int")
    meet = lambda p, q: p[1] == q[1] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]
    got = {r.id: r.label for r in spatial.box_components(df, "id", 64, 16, ["k"]).collect()}
    assert got == groups(150, lambda i, j: meet(boxes[i], boxes[j]))
    near = lambda p, q: (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 30 * 30
    got = {r.id: r.label for r in spatial.point_components(df, "id", "xtl", "ytl", 30).collect()}
    assert got == groups(150, lambda i, j: near(boxes[i], boxes[j]))


def test_a_segment_stays_one_row_with_its_tile(spark):
    plan = QUERIES["direction_assignment"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") and "max(v" not in plan


def test_small_groups_make_no_frames(spark):
    for name in ("merged_spans", "claimed_interrows", "parallel_duplicates", "canopy_heights"):
        assert "FlatMapGroupsInPandas" not in QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString(), name


def test_groups_across_batches(spark):
    from terrarow.operators import rows

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") % 23).alias("g"), (500 - F.col("id")).alias("v"))
        got = rows.by_group(df, "g", ["v"], ["v"], lambda g, vs: [(g, len(vs), vs[0][0])] if vs == sorted(vs) else [], "g bigint, n int, v bigint").collect()
        from terrarow.operators import canopies

        cells = spark.range(300).select((F.col("id") % 3).alias("canopy"), (F.floor(F.col("id") / 3) % 10).cast("int").alias("x"), F.floor(F.col("id") / 30).cast("int").alias("y"))
        high = {(r.canopy, r.x, r.y): r.height2 for r in canopies.heights(cells).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.g: (r.n, r.v) for r in got} == {g: (len(vs), min(vs)) for g in range(23) for vs in [[500 - i for i in range(500) if i % 23 == g]]}
    assert high == {(c, x, y): min(x + 1, 10 - x, y + 1, 10 - y) ** 2 for c in range(3) for x in range(10) for y in range(10)}


def test_long_lines_are_simplified_by_blocks():
    import numpy as np

    from terrarow.operators import greedy

    rng = np.random.default_rng(1)
    n = 600_000  # point by point this takes minutes: splits peel off the left end
    line = np.column_stack([np.sort(rng.integers(0, 12000, n)), rng.integers(1, 8, n) * 250]).astype(float)
    assert len(greedy.simplify(line, 400.0)) > 12_000
    short = line[:20_000]
    whole, greedy._corners = greedy._corners, lambda points: np.arange(len(points))
    try:
        want = greedy.simplify(short, 400.0)
    finally:
        greedy._corners = whole
    assert np.array_equal(greedy.simplify(short, 400.0), want)


def test_boundary_matching_of_many_equal_places(spark, tmp_path):
    """Rows equal a scan of all pairs; equal places are matched without pairing them (20,000 boxes of one place in each of two tiles)."""
    from terrarow.operators import greedy

    keys = random.Random(3).sample(range(9 * 2048 * 3), 1500)
    got = {tuple(r) for r in QUERIES["boundary_matching"](spark, part(spark, tmp_path, keys)).collect()}
    at = {k: (k % 9, k * 37 % 2048, k * 91 % 2048) for k in keys}
    pairs = sorted((d, a, b) for a in keys for b in keys if at[b][0] == at[a][0] + 1 and (d := (at[a][1] - at[b][1]) ** 2 + (at[a][2] - at[b][2]) ** 2) <= 120 * 120)
    used, want = set(), set()
    for d, a, b in pairs:
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.add((at[a][0], a, b, d))
    assert got == want
    n = 20_000
    side = lambda id_, more: spark.range(n + more).select(F.lit(1).alias("t"), F.col("id").alias(id_), F.lit(5).alias("x"), F.lit(7).alias("y"))
    rows = greedy.matched_places(side("a", 3), side("b", 0), ["t"], 120).collect()
    assert len(rows) == n and all(r.a == r.b and r.d2 == 0 for r in rows)


def test_linked_ends_are_a_scan_without_a_task_for_all(spark):
    """Rows equal a scan of all candidates by (turn, a, b); no group of linked segments goes to one task."""
    df = QUERIES["linked_ends"](spark, DIR)
    assert "InPandas" not in df._jdf.queryExecution().toString()
    used, want = set(), set()
    for k in sorted(QUERIES["linked_segments"](spark, DIR).collect(), key=lambda k: (k.turn, k.a, k.b)):
        if not {k.a, k.b} & used:
            used |= {k.a, k.b}
            want.add((k.a, k.a % 2, k.b, k.b % 2, float(k.turn)))
    assert {tuple(r) for r in df.collect()} == want and want


def test_walk_over_many_targets():
    """2,000 targets around two walls: all in reach are visited, no leg enters a wall; a few seconds, where all pairs of nodes took hours."""
    import numpy as np

    from terrarow.operators import routing

    r = random.Random(8)
    walls = [np.array([(x, 4.0), (x + 1.0, 4.0), (x + 1.0, 28.0), (x, 28.0)]) for x in (8.0, 16.0)]
    targets = np.array([(r.uniform(3, 33), r.uniform(3, 33)) for _ in range(2000)])
    line, length, missed = routing.walk(np.zeros(2), targets, walls)
    inside = [i for i, (x, y) in enumerate(targets) if 4 < y < 28 and any(w[0, 0] < x < w[1, 0] for w in walls)]
    assert missed == inside and inside
    assert {tuple(p) for p in targets[[i for i in range(2000) if i not in set(inside)]]} <= {tuple(p) for p in line}
    assert (line[0] == line[-1]).all() and not any(routing.enters(w, a, b) for w in walls for a, b in zip(line, line[1:]))
    assert abs(length - sum(np.hypot(*(b - a)) for a, b in zip(line, line[1:]))) < 1e-6


def test_every_tenth_hangs_on_the_table_alone(spark, tmp_path):
    """Vines of one place, order and line but of several rows: the same ones are chosen in whatever order they come."""
    got = []
    for turn in (1, -1):
        rows = [(7, i % 25, 3, 1, 12.34) for i in range(60)][::turn]
        spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/{turn}/lineitem.parquet")
        got.append(sorted(r.row_no for r in QUERIES["every_tenth"](spark, f"{tmp_path}/{turn}").collect()))
    assert got[0] == got[1] == sorted(i % 25 for i in range(60))[::10]


def test_corridor_nodes_are_not_joined(spark):
    plan = QUERIES["corridor_runs"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Window" not in plan


def test_groups_of_strips_in_small_and_large_blocks(spark):
    """Blocks read one after another and blocks by rounds of labels give the same groups as a plain scan."""
    from terrarow.operators import field
    from terrarow.plans.join_queries import side_pairs

    r = random.Random(6)
    rows = [(i, i % 7 if i < 60 else 9, r.randrange(3000), (s := r.randrange(900)), s + r.randrange(200, 900)) for i in range(160)]
    s = spark.createDataFrame(rows, "strip_id bigint, block_no int, t_cm bigint, s0_cm bigint, s1_cm bigint")
    label = {i[0]: i[0] for i in rows}
    links = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and 125 <= b[2] - a[2] <= 400 and min(a[4], b[4]) - max(a[3], b[3]) >= 300]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = {(i, label[i]) for k in links for i in k}
    got = field.side_components(s, "block_no", "strip_id", "t_cm", "s0_cm", "s1_cm", 125, 400, 300, lambda large: side_pairs(large).select("a", "b"), 20).collect()
    assert {(k.id, k.label) for k in got} == want and len(got) == len(want) > 40


def test_hops_of_dense_points_make_no_links(spark, monkeypatch):
    random.seed(9)
    points = [(i, random.randrange(120), random.randrange(40)) for i in range(300)] + [(300, 5, 5), (301, 400, 400), (302, 402, 400)]
    df = spark.createDataFrame(points, "id long, x int, y int")
    monkeypatch.setattr(spatial, "pairs_once", None)
    got = {r.id: r.hops for r in spatial.point_hops(df, "id", "x", "y", 16, df.where("id = 300").select("id")).collect()}
    want, last = {300: 0}, [(5, 5)]
    while last:
        new = [(i, x, y) for i, x, y in points if i not in want and any((x - u) ** 2 + (y - v) ** 2 <= 256 for u, v in last)]
        want |= {i: max(want.values()) + 1 for i, _, _ in new} if new else {}
        last = [(x, y) for _, x, y in new]
    assert got == want and max(got.values()) > 5
    assert QUERIES["hop_distances"](spark, DIR).count() > 0  # it makes no pairs either


def test_nearest_in_one_dense_spot_pairs_few(spark, monkeypatch):
    """Most places lie where b is dense, most cells hold one row of b each: the first search goes by what places see, not by the mean of cells."""
    random.seed(5)
    made, pairs = [], spatial.distance_pairs

    def counted(*args):
        df = pairs(*args)
        made.append(df.count())
        return df

    monkeypatch.setattr(spatial, "distance_pairs", counted)
    a = [(i, random.randrange(100), random.randrange(100)) for i in range(300)] + [(300, 250, 50), (301, -5000, 0)]
    b = [(i, random.randrange(100), random.randrange(100)) for i in range(3000)] + [(3000 + i, 1000 + 200 * i, 1000) for i in range(3000)]
    left, right = spark.createDataFrame(a, "i int, x int, y int"), spark.createDataFrame(b, "j int, u int, v int")
    got = {r.i: (r.j, r.d2) for r in spatial.nearest(left, right, "i", "x", "y", "u", "v", "j", 200, how="left").collect()}
    want = {}
    for i, x, y in a:
        d2, j = min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b)
        want[i] = (j, d2) if d2 <= 200 * 200 else (None, None)
    assert got == want and want[300][0] is not None and want[301] == (None, None)
    assert sum(made) < 30_000  # 300 * 3,000 at full reach


def test_nearest_of_places_held_by_many(spark):
    """Of many rows at one place the first k count, beyond them the next places; many cells are joined by merge, few by broadcast."""
    a = [(i, 10 * i, 0) for i in range(20)]
    b = [(j, 10 * (j % 20), 3) for j in range(1000, 0, -1)]
    left, right = spark.createDataFrame(a, "i int, x int, y int"), spark.createDataFrame(b, "j int, u int, v int")
    want = {(i, n + 1): (j, d2) for i, x, y in a for n, (d2, j) in enumerate(sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b)[:3])}
    for few in (spatial.FEW_CELLS, 0):
        spatial.FEW_CELLS, was = few, spatial.FEW_CELLS
        try:
            got = {(r.i, r["rank"]): (r.j, r.d2) for r in spatial.nearest(left, right, "i", "x", "y", "u", "v", "j", 50, 3).collect()}
        finally:
            spatial.FEW_CELLS = was
        assert got == want


def test_cascade_keeps_repeated_and_lone_boxes(spark, tmp_path):
    """A box that stands twice in the table is two rows, as in the SQL, not four; boxes without a segment stay."""
    import duckdb

    from terrarow.plans.registry import ORACLES

    part(spark, tmp_path, [0, 0, 2048, 900, 900, 900, 1203])
    rows = [(34 * k + 9, 35 * k + 9, (k * 97 % 5000) / 100 + 10.0) for k in range(400)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = ORACLES["nearest_cascade"]
    key = lambda r: tuple(str(v) for v in r)
    got = sorted((tuple(r) for r in QUERIES["nearest_cascade"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(con.execute(f"SELECT box_id, nearest, how FROM ({sql})").fetchall(), key=key)
    assert len(got) == 7 and {r[1] is None for r in got} == {True, False}


def test_equal_boxes_are_matched_without_pairs(spark):
    """Matching at falling shares equals the scan of all pairs; boxes that stand many times on both sides make none."""
    r = np.random.default_rng(7)
    kinds = [(int(x), int(y), int(x) + int(w), int(y) + int(h)) for x, y, w, h in zip(r.integers(0, 40, 25), r.integers(0, 40, 25), r.integers(0, 30, 25), r.integers(5, 30, 25))]
    boxes = [(i, i % 2, *kinds[int(k)]) for i, k in enumerate(r.integers(0, 25, 300))]
    df = spark.createDataFrame(boxes, "box_id long, tile int, xtl int, ytl int, xbr int, ybr int")
    left, right = df.where("box_id % 3 != 0"), df.where("box_id % 3 = 0")
    got = {(x.tile, x.a, x.b, round(x.iou, 9)) for x in greedy.matched_boxes(left, right, ["tile"], "box_id", 0.1).collect()}

    def iou(p, q):
        w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
        return w * h / ((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - w * h) if w > 0 and h > 0 else 0

    pairs = sorted((-iou(p, q), p[0], q[0], p[1]) for p in boxes if p[0] % 3 for q in boxes if not q[0] % 3 and p[1] == q[1] and iou(p, q) >= 0.1)
    used, want = set(), set()
    for cost, a, b, tile in pairs:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((tile, a, b, round(-cost, 9)))
    assert got == want and sum(x[3] == 1 for x in want) > 20 and sum(x[3] < 0.5 for x in want) > 0
    same = spark.range(200_000).selectExpr("id as box_id", "0 as tile", "0 as xtl", "0 as ytl", "9 as xbr", "9 as ybr")
    assert greedy.matched_boxes(same.where("box_id % 2 = 0"), same.where("box_id % 2 = 1"), ["tile"], "box_id", 0.1).where("b = a + 1").count() == 100_000


def test_linked_segments_by_stretches(spark):
    """Equal to all pairs, over the end of the circle of angles too, and a segment is sent to five tiles only."""
    r = np.random.default_rng(8)
    rows = [(i, int(a), int(b), int(t), int(n)) for i, (a, b, t, n) in enumerate(zip(r.integers(0, 3, 400), r.integers(0, 3, 400), r.integers(0, 180, 400), r.integers(-40, 400, 400)))]
    got = spatial.turned_pairs(spark.createDataFrame(rows, "id long, r int, c int, angle int, size long"), 8, 60)
    bend = lambda p, q: min(abs(p[3] - q[3]), 180 - abs(p[3] - q[3]))
    want = sorted((p[0], q[0], bend(p, q)) for p in rows for q in rows if p[0] < q[0] and abs(p[1] - q[1]) <= 1 and abs(p[2] - q[2]) <= 1 and bend(p, q) <= 8 and abs(p[4] - q[4]) <= 60)
    assert sorted(map(tuple, got.collect())) == want and any(abs(rows[a][3] - rows[b][3]) > 90 for a, b, _ in want)
    plan = QUERIES["linked_segments"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 1


def orders(spark, tmp_path, rows):
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_boundary_pairs_are_looked_for_at_the_edges(spark, tmp_path):
    """Segments in the middle of two tiles side by side: pairing them all would take minutes."""
    n = 60_000
    far = [(34 * 5120 * i + k, 0, 20.0) for i in range(n // 2) for k in (0, 1)]
    near = [(34 * 5120 * n, 0, 51.0), (34 * 5120 * n + 1, 0, 1.0)]
    got = QUERIES["boundary_pairs"](spark, orders(spark, tmp_path, far + near)).collect()
    assert [tuple(x) for x in got] == [(34 * 5120 * n, 34 * 5120 * n + 1)]


def test_long_lines_wait_in_a_file(spark):
    """Lines come in pieces out of sorted partitions; no group is a frame, and the points kept are those of the plain way."""
    r = np.random.default_rng(3)
    rows = [(k, int(s), i, float(t)) for k, n in ((1, 1), (2, 5000), (None, 40), (3, 30_000)) for i, (s, t) in enumerate(zip(np.sort(r.integers(0, 12000, n)), r.integers(0, 1500, n)))]
    df = spark.createDataFrame(rows, "k int, s long, i int, t double")
    lines = greedy.simplified_lines(df, "k", ["s", "i"], "s", "t", 400.0)
    assert "FlatMapGroups" not in lines._jdf.queryExecution().toString()
    got = sorted(map(tuple, lines.collect()), key=str)

    def plain(p):
        keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a > 1:
                d, rest = p[b] - p[a], p[a + 1 : b] - p[a]
                size = np.hypot(*d)
                far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size else np.hypot(*rest.T)
                if far.max() > 400:
                    k = a + 1 + int(far.argmax())
                    keep.add(k)
                    todo += [(a, k), (k, b)]
        return p[sorted(keep)]

    want = [(k, i, *map(float, q)) for k in (1, 2, None, 3) for i, q in enumerate(plain(np.array([(s, t) for key, s, _, t in rows if key == k], float)))]
    assert got == sorted(want, key=str)
