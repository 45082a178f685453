"""Field compositions on the survey views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrarow.operators import field, graph, greedy, rows, spatial

from .base import query, view
from .join_queries import placed, side_pairs, strip_pairs


@query("""WITH p AS (SELECT tile_no, box_id, xtl AS x, ytl AS y FROM boxes), d AS (SELECT a.tile_no, a.box_id, b.box_id AS o, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, degrees(atan2(b.y - a.y, b.x - a.x)) AS g FROM p a JOIN p b ON a.tile_no = b.tile_no AND a.box_id <> b.box_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 7225),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_no, box_id ORDER BY d2, o) AS i FROM d) WHERE i <= 5 AND d2 >= 625), b AS (SELECT tile_no, CAST(floor(round(CASE WHEN g < 0 THEN g + 180 WHEN g >= 180 THEN g - 180 ELSE g END, 6)) AS INTEGER) % 180 AS bin, count(*) AS w FROM f GROUP BY ALL), k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest([1, 2, 4, 2, 1]) AS k), s AS (SELECT tile_no, (bin + o + 180) % 180 AS bin, sum(w * k) AS v FROM b, k GROUP BY ALL), t AS (SELECT tile_no, bin, row_number() OVER (PARTITION BY tile_no ORDER BY v DESC, bin) AS i FROM s)
 , g AS (SELECT tile_no, count(*) AS n, degrees(0.5 * atan2(2 * covar_pop(xtl, ytl), var_pop(xtl) - var_pop(ytl))) AS d FROM boxes GROUP BY 1)
 SELECT g.tile_no, round(CASE WHEN n < 5 THEN 0.0::DOUBLE ELSE coalesce(bin + 0.5::DOUBLE, CASE WHEN d < 0 THEN d + 180 ELSE d END) END, 6) AS angle_deg FROM g LEFT JOIN t ON g.tile_no = t.tile_no AND i = 1""")
def row_angles(spark, sf_dir):
    b = view(spark, sf_dir, "boxes")
    return field.row_angles(b, "tile_no", "box_id", "xtl", "ytl").withColumn("angle_deg", F.round("angle_deg", 6))


@query("WITH n AS (SELECT block_no, strip_id AS row_a, t_cm, s0_cm, s1_cm, lead(strip_id) OVER w AS row_b, lead(t_cm) OVER w AS t2, lead(s0_cm) OVER w AS a2, lead(s1_cm) OVER w AS b2 FROM strips WINDOW w AS (PARTITION BY block_no ORDER BY t_cm, strip_id)), q AS (SELECT block_no, row_a, row_b, t_cm + least(12.0, 0.25 * (t2 - t_cm)) AS t0, t2 - least(12.0, 0.25 * (t2 - t_cm)) AS t1, greatest(s0_cm, a2) AS lo, least(s1_cm, b2) AS hi FROM n WHERE t2 - t_cm >= 25) SELECT block_no, row_a, row_b, CAST(t0 AS DOUBLE) AS t0, CAST(t1 AS DOUBLE) AS t1, lo, hi, CAST((t1 - t0) * (hi - lo) AS DOUBLE) AS area FROM q WHERE hi - lo >= 25 AND (t1 - t0) * (hi - lo) >= 100")
def interrow_quads(spark, sf_dir):
    return field.interrow_quads(view(spark, sf_dir, "strips"), "block_no", "strip_id", "t_cm", "s0_cm", "s1_cm")


@query("WITH p AS (SELECT strip_id, k AS tile, greatest(s0_cm, k * 1024) AS p0, least(s1_cm, (k + 1) * 1024) AS p1 FROM strips, (SELECT unnest(range(0, 12)) AS k)) SELECT strip_id, CAST(tile AS INTEGER) AS tile, CAST(p0 AS DOUBLE) AS p0, CAST(p1 AS DOUBLE) AS p1 FROM p WHERE p1 - p0 >= 100")
def tile_pieces(spark, sf_dir):
    return field.tile_pieces(view(spark, sf_dir, "strips"), "strip_id", "s0_cm", "s1_cm", 1024.0, 100.0)


@query("""WITH b AS (SELECT block_id, angle_deg // 10 AS bin, sum(len_cm) AS w FROM segments GROUP BY ALL), t AS (SELECT block_id, sum(w) AS total FROM b GROUP BY 1), f AS (SELECT block_id, bin * 10 + 5.0 AS p FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY w DESC, bin) AS i FROM b) WHERE i = 1),
 s AS (SELECT block_id, bin * 10 + 5.0 AS p FROM (SELECT b.*, row_number() OVER (PARTITION BY b.block_id ORDER BY w DESC, bin) AS i FROM b JOIN f USING (block_id) JOIN t USING (block_id) WHERE least(abs(bin * 10 + 5.0 - p), 180 - abs(bin * 10 + 5.0 - p)) >= 25 AND w >= 0.05 * total) WHERE i = 1)
 SELECT g.block_id, seg_id, CASE WHEN least(abs(angle_deg - s.p), 180 - abs(angle_deg - s.p)) < least(abs(angle_deg - f.p), 180 - abs(angle_deg - f.p)) THEN 1 ELSE 0 END AS mode FROM segments g JOIN f USING (block_id) LEFT JOIN s USING (block_id)""")
def orientation_groups(spark, sf_dir):
    return field.orientation_groups(view(spark, sf_dir, "segments"), "block_id", "seg_id", "angle_deg", "len_cm", share=0.05)


@query("WITH p AS (SELECT a.strip_id, b.strip_id AS o, b.t_cm - a.t_cm AS d FROM strips a JOIN strips b ON a.block_no = b.block_no AND a.strip_id <> b.strip_id AND (a.s0_cm + a.s1_cm) // 2 BETWEEN b.s0_cm AND b.s1_cm AND abs(b.t_cm - a.t_cm) BETWEEN 1 AND 500) SELECT s.strip_id, arg_min(o, -d * 1000000 + o) FILTER (d < 0) AS left, arg_min(o, d * 1000000 + o) FILTER (d > 0) AS right FROM strips s LEFT JOIN p USING (strip_id) GROUP BY 1")
def side_neighbours(spark, sf_dir):
    return field.side_neighbours(view(spark, sf_dir, "strips"), "block_no", "strip_id", "t_cm", "s0_cm", "s1_cm", 500)


@query("WITH n AS (SELECT a.strip_id, count(*) FILTER (b.t_cm > a.t_cm) AS r, count(*) FILTER (b.t_cm < a.t_cm) AS l FROM strips a JOIN strips b ON a.block_no = b.block_no AND a.strip_id <> b.strip_id AND (a.s0_cm + a.s1_cm) // 2 BETWEEN b.s0_cm AND b.s1_cm AND abs(b.t_cm - a.t_cm) BETWEEN 1 AND 500 GROUP BY 1) SELECT strip_id FROM strips LEFT JOIN n USING (strip_id) WHERE coalesce(r, 0) = 0 AND coalesce(l, 0) = 0")
def clearings(spark, sf_dir):
    """Strips that are open on both sides at their middle."""
    return side_neighbours(spark, sf_dir).where("left IS NULL AND right IS NULL").select("strip_id")


@query("WITH b AS (SELECT block_no, row_no, CAST(ceil(min(s_cm) / 2000.0) AS INTEGER) AS a, CAST(greatest(ceil(min(s_cm) / 2000.0), floor(max(s_cm) / 2000.0)) AS INTEGER) AS z FROM vines GROUP BY ALL), k AS (SELECT block_no, row_no, unnest(range(a, z + 1)) AS k FROM b), n AS (SELECT k.block_no, k.row_no, k, regr_slope(t_cm, s_cm) AS m, regr_intercept(t_cm, s_cm) AS b, count(*) AS n FROM k JOIN vines v ON k.block_no = v.block_no AND k.row_no = v.row_no AND abs(s_cm - k * 2000) <= 2000 GROUP BY ALL) SELECT block_no, row_no, CAST(k * 2000 AS DOUBLE) AS knot, round(m * k * 2000 + b, 3) AS value, n FROM n")
def row_knots(spark, sf_dir):
    got = field.local_knots(view(spark, sf_dir, "vines"), ["block_no", "row_no"], "s_cm", "t_cm", 2000.0, 2000.0)
    return got.withColumn("value", F.round("value", 3))


@query()
def physical_rows(spark, sf_dir):
    """Greedy end links within tile columns, then chains with their block by length vote."""
    from .table_queries import linked_ends

    links = linked_ends(spark, sf_dir).select("a", "b")
    return field.physical_rows(view(spark, sf_dir, "segments"), links, "seg_id", "block_id", "len_cm")


@query()
def claimed_interrows(spark, sf_dir):
    pairs = strip_pairs(spark, sf_dir)
    s = view(spark, sf_dir, "strips")
    ends = lambda x: s.select(F.col("strip_id").alias(x), F.col("block_no").alias(f"k{x}"), F.col("s0_cm").alias(f"s0{x}"), F.col("s1_cm").alias(f"s1{x}"))
    full = pairs.join(ends("a"), "a").join(ends("b"), "b").select(F.col("ka").alias("block_no"), F.col("a").alias("row_a"), F.col("b").alias("row_b"), "dt", F.greatest("s0a", "s0b").alias("s0"), F.least("s1a", "s1b").alias("s1"))
    return field.claimed_interrows(full, "block_no")


@query("WITH RECURSIVE e AS (SELECT a.strip_id AS a, b.strip_id AS b FROM strips a JOIN strips b ON a.block_no = b.block_no AND a.strip_id <> b.strip_id AND abs(b.t_cm - a.t_cm) BETWEEN 125 AND 400 AND least(a.s1_cm, b.s1_cm) - greatest(a.s0_cm, b.s0_cm) >= 300), w AS (SELECT strip_id AS id, strip_id AS l FROM strips UNION SELECT e.b, w.l FROM w JOIN e ON e.a = w.id), k AS (SELECT id, min(l) AS label FROM w GROUP BY 1) SELECT label AS grp, any_value(block_no) AS block_no, count(*) AS n, CAST(sum(s1_cm - s0_cm) AS BIGINT) AS length_cm FROM k JOIN strips ON strip_id = id GROUP BY 1 HAVING count(*) >= 3")
def regrouped_blocks(spark, sf_dir):
    """Groups of three strips or more that are linked side by side."""
    s = view(spark, sf_dir, "strips")
    labels = field.side_components(s, "block_no", "strip_id", "t_cm", "s0_cm", "s1_cm", 125, 400, 300, lambda large: side_pairs(large).select("a", "b")).withColumnRenamed("id", "strip_id")
    got = s.join(labels.hint("merge"), "strip_id").groupBy(F.col("label").alias("grp")).agg(F.min("block_no").alias("block_no"), F.count("*").alias("n"), F.sum(F.col("s1_cm") - F.col("s0_cm")).alias("length_cm"))
    return got.where("n >= 3")


@query("WITH RECURSIVE d AS (SELECT col AS x, row_ AS y FROM cells GROUP BY ALL HAVING sum(v) >= 520), e AS (SELECT a.y * 64 + a.x AS a, b.y * 64 + b.x AS b FROM d a JOIN d b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), w AS (SELECT y * 64 + x AS id, y * 64 + x AS l FROM d UNION SELECT e.b, w.l FROM w JOIN e ON e.a = w.id), k AS (SELECT id, min(l) AS l FROM w GROUP BY 1) SELECT CAST(l AS BIGINT) AS region, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 3")
def without_specks(spark, sf_dir):
    from terrarow.operators import raster

    dense = view(spark, sf_dir, "cells").groupBy(F.col("col").alias("x"), F.col("row_").alias("y")).agg(F.sum("v").alias("v")).where("v >= 520").select("x", "y")
    return raster.regions(dense, "x", "y", 64).groupBy("region").agg(F.count("*").alias("n")).where("n >= 3")


@query("WITH g AS (SELECT col, row_, min(v) AS v FROM cells GROUP BY ALL), n AS (SELECT a.col, a.row_, a.v, avg(CASE WHEN b.v <= 2 THEN 1.0 ELSE 0.0 END) AS dark FROM g a JOIN g b ON abs(a.col - b.col) <= 2 AND abs(a.row_ - b.row_) <= 2 GROUP BY ALL) SELECT col, row_, v <= 2 AND dark >= 0.5 AS nodata FROM n")
def nodata_cells(spark, sf_dir):
    """Dark cells whose five by five surroundings are dark for the most part."""
    g = view(spark, sf_dir, "cells").groupBy("col", "row_").agg(F.min("v").alias("v"))
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    near = spatial.neighbour_tiles(g.withColumn("dark", (F.col("v") <= 2).cast("double")).select("col", "row_", "dark"), "row_", "col", steps)
    share = near.groupBy(F.col("nc").alias("col"), F.col("nr").alias("row_")).agg(F.avg("dark").alias("dark"))
    return g.join(share, ["col", "row_"]).select("col", "row_", ((F.col("v") <= 2) & (F.col("dark") >= 0.5)).alias("nodata"))


@query("WITH m AS (SELECT avg(red) AS r, avg(green) AS g, avg(blue) AS b FROM cells) SELECT col, row_, round(avg(least(255.0, red * ((r + g + b) / 3) / r)), 4) AS red, round(avg(least(255.0, blue * ((r + g + b) / 3) / b)), 4) AS blue FROM cells, m GROUP BY ALL")
def gray_world(spark, sf_dir):
    """Channels scaled to a common mean; the three means are one row, joined by broadcast."""
    c = view(spark, sf_dir, "cells")
    means = c.agg(F.avg("red").alias("r"), F.avg("green").alias("g"), F.avg("blue").alias("b")).withColumn("one", F.lit(1))
    scaled = lambda x, m: F.round(F.avg(F.least(F.lit(255.0), F.col(x) * ((F.col("r") + F.col("g") + F.col("b")) / 3) / F.col(m))), 4).alias(x)
    return c.withColumn("one", F.lit(1)).join(F.broadcast(means), "one").groupBy("col", "row_").agg(scaled("red", "r"), scaled("blue", "b"))


@query("WITH s AS (SELECT seg_id, c * 5120 + len_cm AS x, r * 5120 + (seg_id * 13) % 5120 AS y, block_id, r, c FROM segments), p AS (SELECT a.block_id = b.block_id AS same FROM s a JOIN s b ON (b.r = a.r AND b.c = a.c + 1 OR b.r = a.r + 1 AND b.c = a.c) WHERE abs(a.x - b.x) <= 800 AND abs(a.y - b.y) <= 800) SELECT count(*) AS crossings, count(*) FILTER (same) AS continued, round(100.0 * count(*) FILTER (same) / greatest(1, count(*)), 1) AS percent FROM p")
def boundary_audit(spark, sf_dir):
    """How many crossings of tile edges keep their block."""
    s = placed(view(spark, sf_dir, "segments"))
    other = s.select(F.col("block_id").alias("bb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("r").alias("nr"), F.col("c").alias("nc"))
    near = (F.abs(F.col("x") - F.col("xb")) <= 800) & (F.abs(F.col("y") - F.col("yb")) <= 800)
    same = F.col("block_id") == F.col("bb")
    got = spatial.neighbour_tiles(s, "r", "c", spatial.BESIDE).join(other, ["nr", "nc"]).where(near).agg(F.count("*").alias("crossings"), F.count_if(same).alias("continued"))
    return got.withColumn("percent", F.round(100 * F.col("continued") / F.greatest(F.lit(1), F.col("crossings")), 1))


@query("WITH d AS (SELECT DISTINCT block_id, r, c FROM segments), w AS (SELECT *, avg(r) OVER (PARTITION BY block_id) AS br, avg(c) OVER (PARTITION BY block_id) AS bc FROM d), s AS (SELECT g.seg_id, w.block_id, round((g.len_cm - 2560) * (bc - w.c) + (g.angle_deg - 90) * (br - w.r), 3) AS v FROM segments g JOIN w ON g.r = w.r AND g.c = w.c), k AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY v DESC, block_id) AS i FROM s) SELECT seg_id, block_id FROM k WHERE i = 1")
def direction_assignment(spark, sf_dir):
    """Of the blocks of a segment's tile, the one that lies in its direction from the tile's centre."""
    g = view(spark, sf_dir, "segments")
    w = Window.partitionBy("block_id")
    d = g.select("block_id", "r", "c").distinct().withColumns({"br": F.avg("r").over(w), "bc": F.avg("c").over(w)})
    # a tile's few blocks are one row, so that a segment is one row from the join on
    tiles = d.groupBy("r", "c").agg(F.collect_list(F.struct("block_id", "br", "bc")).alias("blocks"))
    v = lambda b: F.round((F.col("len_cm") - 2560) * (b["bc"] - F.col("c")) + (F.col("angle_deg") - 90) * (b["br"] - F.col("r")), 3)
    best = F.array_min(F.transform("blocks", lambda b: F.struct((0.0 - v(b)).alias("v"), b["block_id"].alias("block_id"))))
    got = g.select("seg_id", "r", "c", "len_cm", "angle_deg").join(tiles, ["r", "c"]).select("seg_id", best.alias("best"))
    return got.groupBy("seg_id").agg(F.min("best")["block_id"].alias("block_id"))


@query("WITH RECURSIVE e AS (SELECT a.pid AS a, b.pid AS b FROM points a JOIN points b ON a.pid <> b.pid AND (a.x_cm - b.x_cm) * (a.x_cm - b.x_cm) + (a.y_cm - b.y_cm) * (a.y_cm - b.y_cm) <= 62500), w AS (SELECT CAST(0 AS BIGINT) AS id UNION SELECT e.b FROM w JOIN e ON e.a = w.id), d AS (SELECT b.box_id, p.pid, (b.xtl - p.x_cm) * (b.xtl - p.x_cm) + (b.ytl - p.y_cm) * (b.ytl - p.y_cm) AS d2 FROM boxes b JOIN points p ON true JOIN w ON w.id = p.pid), k AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY d2, pid) AS i FROM d WHERE d2 <= 250000) SELECT pid AS node, min(box_id) AS target, count(*) AS targets FROM k WHERE i = 1 GROUP BY 1")
def snapped_targets(spark, sf_dir):
    """Targets at their nearest node within 5 m that is connected to the start; the first target of a node stands for it."""
    labels = spatial.point_components(view(spark, sf_dir, "points"), "pid", "x_cm", "y_cm", 250)
    start = labels.where("id = 0").select("label")
    reached = labels.join(start, "label", "left_semi").select("id").union(spark.range(1)).distinct()
    p = view(spark, sf_dir, "points").select("pid", "x_cm", "y_cm").join(reached, F.col("pid") == F.col("id"), "left_semi")
    t = view(spark, sf_dir, "boxes").select("box_id", "xtl", "ytl")
    near = spatial.nearest(t, p, "box_id", "xtl", "ytl", "x_cm", "y_cm", "pid", 500)
    return near.groupBy(F.col("pid").alias("node")).agg(F.min("box_id").alias("target"), F.count("*").alias("targets"))


@query("SELECT box_id, CAST(CASE WHEN box_id % 4 = 0 THEN 628992.0 + tile_no * 51.2 ELSE xtl * 1.0 END AS DOUBLE) AS x, CASE WHEN box_id % 4 = 0 THEN 'name' ELSE 'file' END AS how FROM boxes")
def tiles_by_name(spark, sf_dir):
    """Places of tiles from their files, or by name where a file has none."""
    from terrarow.functions import grid

    b = view(spark, sf_dir, "boxes").withColumn("geo", F.when(F.col("box_id") % 4 != 0, F.col("xtl") * 1.0))
    return b.select("box_id", F.coalesce("geo", grid.tile_x(F.col("tile_no"))).alias("x"), F.when(F.col("geo").isNull(), "name").otherwise("file").alias("how"))


@query("WITH l AS (SELECT event_id, user_id % 20 AS entry, event_id AS place, 10 + user_id % 20 AS size FROM walk), p AS (SELECT *, lag(place) OVER (PARTITION BY entry ORDER BY place) AS b FROM l), d AS (SELECT p.place, (SELECT sum(z) FROM (SELECT DISTINCT x.entry, x.size AS z FROM l x WHERE x.place >= p.b AND x.place < p.place)) AS bytes FROM p WHERE b IS NOT NULL) SELECT p.place, p.entry, coalesce(bytes <= 200, false) AS hit FROM p LEFT JOIN d ON p.place = d.place")
def bounded_cache(spark, sf_dir):
    log = view(spark, sf_dir, "walk").select("event_id", "ts", (F.col("user_id") % 20).alias("entry"), (F.col("user_id") % 20 + 10).alias("size"))
    return field.bounded_cache(log, "entry", "event_id", "size", 200).select(F.col("at").cast("bigint").alias("place"), "entry", "hit")


@query()
def parallel_duplicates(spark, sf_dir):
    """Of strips closer than 1.3 m the one with fewer plants a metre goes."""
    s = view(spark, sf_dir, "strips")
    near = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("t_cm") / 130).cast("int"), F.floor((F.col("t_cm") + 130) / 130).cast("int"))))
    other = s.select("block_no", F.col("strip_id").alias("b"), F.col("t_cm").alias("tb"), (F.col("strip_id") % 17).cast("double").alias("density_b"), F.floor(F.col("t_cm") / 130).cast("int").alias("cell"))
    pairs = near.join(other.hint("merge"), ["block_no", "cell"]).where((F.col("tb") - F.col("t_cm")).between(0, 130) & (F.col("strip_id") != F.col("b")))
    return greedy.drop_parallel(pairs.select("block_no", F.col("strip_id").alias("a"), "b", (F.col("strip_id") % 17).cast("double").alias("density_a"), "density_b"), "block_no")

