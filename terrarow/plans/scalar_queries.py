"""Grid, geometry, text and predicate functions on the survey views."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrarow.functions import geom, grid, text

from .base import query, table, view

_TILE = "'field_r' || lpad(CAST(r AS VARCHAR), 3, '0') || '_c' || lpad(CAST(c AS VARCHAR), 3, '0') || '.tif'"


def _named(spark, sf_dir):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 3, "0")
    return view(spark, sf_dir, "segments").withColumn("name", F.concat(F.lit("field_r"), pad("r"), F.lit("_c"), pad("c"), F.lit(".tif")))


@query(f"SELECT seg_id, {_TILE} AS name, CAST(regexp_extract({_TILE}, 'r(\\d+)_c(\\d+)', 1) AS INTEGER) AS tr, CAST(regexp_extract({_TILE}, 'r(\\d+)_c(\\d+)', 2) AS INTEGER) AS tc, true AS strict FROM segments")
def tile_names(spark, sf_dir):
    name = F.col("name")
    return _named(spark, sf_dir).select("seg_id", "name", grid.tile_row(name).alias("tr"), grid.tile_col(name).alias("tc"), grid.strict_tile_name(name, "field").alias("strict"))


@query(f"SELECT seg_id, unnest(CASE WHEN seg_id % 2 = 0 THEN ['x_' || {_TILE}, {_TILE}] ELSE [{_TILE}] END) AS image_key FROM segments")
def image_keys(spark, sf_dir):
    path = F.concat(F.lit("/data/"), F.when(F.col("seg_id") % 2 == 0, F.lit("X_")).otherwise(F.lit("")), F.col("name"))
    return _named(spark, sf_dir).select("seg_id", F.explode(grid.image_keys(path, "field")).alias("image_key"))


@query("SELECT seg_id, CAST(round(628992.0 + c * 51.2, 4) AS DOUBLE) AS ulx, CAST(round(5221222.4 - r * 51.2, 4) AS DOUBLE) AS uly, CAST(round(628992.0 + c * 51.2 + (len_cm % 2048) * 0.025, 4) AS DOUBLE) AS mx, CAST(round(5221222.4 - r * 51.2 - angle_deg * 0.025, 4) AS DOUBLE) AS my FROM segments")
def pixel_to_map(spark, sf_dir):
    px, py = F.col("len_cm") % 2048, F.col("angle_deg")
    return view(spark, sf_dir, "segments").select("seg_id", grid.tile_x(F.col("c")).alias("ulx"), grid.tile_y(F.col("r")).alias("uly"), grid.map_x(F.col("c"), px).alias("mx"), grid.map_y(F.col("r"), py).alias("my"))


@query("SELECT seg_id, round((628992.0 + len_cm * 0.37 - (628992.0 + c * 51.2)) / 0.025, 2) AS px, round((5221222.4 - r * 51.2 - (5221222.4 - len_cm * 0.31)) / 0.025, 2) AS py, CAST(floor(len_cm * 0.37 / 51.2) AS INTEGER) AS tc, CAST(floor(len_cm * 0.31 / 51.2) AS INTEGER) AS tr FROM (SELECT *, len_cm + 0.1234 AS k FROM segments)")
def map_to_pixel(spark, sf_dir):
    x, y = F.lit(grid.X0) + F.col("len_cm") * 0.37, F.lit(grid.Y0) - F.col("len_cm") * 0.31
    tile = lambda v: F.floor(F.col("len_cm") * v / grid.TILE_M).cast("int")
    return view(spark, sf_dir, "segments").select("seg_id", grid.pixel_x(F.col("c"), x).alias("px"), grid.pixel_y(F.col("r"), y).alias("py"), tile(0.37).alias("tc"), tile(0.31).alias("tr"))


@query("SELECT box_id, CAST(round(0.025 * xtl + 0.001 * ytl + 628992.0, 3) AS DOUBLE) AS x, CAST(round(0.002 * xtl - 0.025 * ytl + 5221222.4, 3) AS DOUBLE) AS y, CAST(round(least(greatest(xbr - 10.0, 0.0), 2048.0), 1) AS DOUBLE) AS cx FROM boxes")
def affine_boxes(spark, sf_dir):
    x, y = grid.affine(F.col("xtl"), F.col("ytl"), tuple(F.lit(v) for v in (0.025, 0.001, 628992.0, 0.002, -0.025, 5221222.4)))
    return view(spark, sf_dir, "boxes").select("box_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), grid.clamp_pixel(F.col("xbr") - 10.0).alias("cx"))


@query("SELECT s.seg_id, abs(s.angle_deg - 90) AS a, least(abs(s.angle_deg - 170) % 180, 180 - abs(s.angle_deg - 170) % 180) AS gap_deg FROM segments s")
def angle_gaps(spark, sf_dir):
    return view(spark, sf_dir, "segments").select("seg_id", F.abs(F.col("angle_deg") - 90).alias("a"), grid.angle_gap(F.col("angle_deg"), F.lit(170)).alias("gap_deg"))


@query()
def lonlat_round_trip(spark, sf_dir):
    """Map points to longitude and latitude and back; the error stays below a millimetre."""
    at = view(spark, sf_dir, "points").select("pid", (F.lit(grid.X0) + F.col("x_cm") / 100).alias("e"), (F.lit(grid.Y0) - F.col("y_cm") / 100).alias("n"))
    lon, lat = grid.lonlat_from_utm(F.col("e"), F.col("n"))
    back = at.withColumns({"lon": lon, "lat": lat})
    e, n = grid.utm_from_lonlat(F.col("lon"), F.col("lat"))
    return back.select("pid", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), (F.hypot(e - F.col("e"), n - F.col("n")) < 1e-3).alias("closed"))


_W = "40075016.68557849"


@query(f"SELECT pid, kind % 20 AS z, round({_W} / 256 / pow(2, kind % 20), 6) AS res, round((x_cm % 7) * {_W} / pow(2, kind % 20) - {_W} / 2, 3) AS xmin, round({_W} / 2 - (y_cm % 5) * {_W} / pow(2, kind % 20), 3) AS ymax, (x_cm % 7) < pow(2, kind % 20) AND (y_cm % 5) < pow(2, kind % 20) AS valid, CAST(least(greatest(ceil(log2({_W} / 256 / (pid + 0.5))), 0), 24) AS INTEGER) AS zoom FROM points")
def web_tiles(spark, sf_dir):
    z, x, y = F.col("kind") % 20, F.col("x_cm") % 7, F.col("y_cm") % 5
    bounds = grid.mercator_bounds(z, x, y)
    return view(spark, sf_dir, "points").select("pid", z.alias("z"), F.round(grid.mercator_resolution(z), 6).alias("res"), F.round(bounds[0], 3).alias("xmin"), F.round(bounds[3], 3).alias("ymax"), grid.valid_tile(z, x, y).alias("valid"), grid.zoom_for(F.col("pid") + 0.5).alias("zoom"))


def _ring(spark, sf_dir):
    b = view(spark, sf_dir, "boxes")
    return b.withColumn("ring", geom.box_ring(*(F.col(c) for c in ("xtl", "ytl", "xbr", "ybr"))))


@query("SELECT box_id, CAST(2.0 * (xbr - xtl) + (ybr - ytl) AS DOUBLE) AS open_len, CAST((xbr - xtl) * (ybr - ytl) AS DOUBLE) AS area, CAST((xbr - xtl) * (ybr - ytl) - 4 AS DOUBLE) AS holed, CAST(xtl AS DOUBLE) AS xmin, CAST(ybr AS DOUBLE) AS ymax, (xtl + xbr) / 2.0 AS mx, (ytl + ybr) / 2.0 AS my, 5 AS closed_n FROM boxes")
def ring_measures(spark, sf_dir):
    ring = F.col("ring")
    hole = geom.box_ring(F.col("xtl") + 1, F.col("ytl") + 1, F.col("xtl") + 3, F.col("ytl") + 3)
    mean, box = geom.mean_point(ring), geom.bbox(ring)
    return _ring(spark, sf_dir).select("box_id", F.round(geom.length(ring), 2).alias("open_len"), geom.area(F.array(ring)).alias("area"), geom.area(F.array(ring, hole)).alias("holed"), box["xmin"].alias("xmin"), box["ymax"].alias("ymax"), mean["x"].alias("mx"), mean["y"].alias("my"), F.size(geom.closed(geom.opened(geom.closed(ring)))).alias("closed_n"))


@query("SELECT box_id, round(sqrt(power(xbr - xtl, 2) + power(ybr - ytl, 2)) * 2, 4) AS both_len, CAST(2 * (xbr - xtl) * (ybr - ytl) AS DOUBLE) AS both_area, round((xtl + xbr) / 2.0, 4) AS mid_x, round((ytl + ybr) / 2.0, 4) AS mid_y FROM boxes")
def multi_measures(spark, sf_dir):
    line = F.array(geom.point(F.col("xtl"), F.col("ytl")), geom.point(F.col("xbr"), F.col("ybr")))
    mid = geom.representative(F.lit("line"), line)
    return _ring(spark, sf_dir).select("box_id", F.round(geom.multi_length(F.array(line, line)), 4).alias("both_len"), geom.multi_area(F.array(F.array("ring"), F.array("ring"))).alias("both_area"), F.round(mid["x"], 4).alias("mid_x"), F.round(mid["y"], 4).alias("mid_y"))


@query("SELECT box_id, printf('POLYGON ((%d.00 %d.00, %d.00 %d.00, %d.00 %d.00, %d.00 %d.00, %d.00 %d.00))', xtl, ytl, xbr, ytl, xbr, ybr, xtl, ybr, xtl, ytl) AS wkt, printf('%d.0,%d.0;%d.0,%d.0;%d.0,%d.0;%d.0,%d.0', xtl, ytl, xbr, ytl, xbr, ybr, xtl, ybr) AS points, 4 AS parsed FROM boxes")
def ring_texts(spark, sf_dir):
    points = text.format_points(F.col("ring"))
    return _ring(spark, sf_dir).select("box_id", geom.wkt(F.array("ring")).alias("wkt"), points.alias("points"), F.size(text.parse_points(F.concat(points, F.lit(";; ")))).alias("parsed"))


@query("SELECT strip_id, s0_cm, s1_cm, CAST(list_sum(list_transform(range(0, 9000, 1000), lambda a: greatest(0, least(s1_cm, a + 1000) - greatest(s0_cm, a + 300)))) AS DOUBLE) AS left_cm FROM strips")
def interval_subtraction(spark, sf_dir):
    """Strips less the first 3 m of every 10 m."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(9000), F.lit(1000)), lambda a: F.struct(a.cast("double").alias("a"), (a + 300).cast("double").alias("b")))
    strips = view(spark, sf_dir, "strips")
    rest = geom.subtract_intervals(F.col("s0_cm"), F.col("s1_cm"), cuts)
    total = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x["b"] - x["a"])
    return strips.select("strip_id", "s0_cm", "s1_cm", total.alias("left_cm"))


@query("SELECT pid, (x_cm > 500 AND x_cm < 2000 AND y_cm > 600 AND y_cm < 1800) AS inside, x_cm BETWEEN 0 AND 1500 AND y_cm BETWEEN 0 AND 1500 AS start_ok FROM points WHERE x_cm NOT IN (500, 2000) AND y_cm NOT IN (600, 1800)")
def point_in_ring(spark, sf_dir):
    ring = geom.box_ring(F.lit(500), F.lit(600), F.lit(2000), F.lit(1800))
    got = view(spark, sf_dir, "points").where("x_cm NOT IN (500, 2000) AND y_cm NOT IN (600, 1800)")
    return got.select("pid", geom.contains(ring, F.col("x_cm"), F.col("y_cm")).alias("inside"), (F.col("x_cm").between(0, 1500) & F.col("y_cm").between(0, 1500)).alias("start_ok"))


@query("SELECT pid, CAST(-x_cm AS DOUBLE) AS t0, CAST(2048 - x_cm AS DOUBLE) AS t1 FROM points WHERE y_cm <= 2048")
def line_clip(spark, sf_dir):
    """The range of an eastward line through each point inside the tile."""
    t0, t1 = geom.clip_range(F.col("x_cm"), F.col("y_cm"), F.lit(1.0), F.lit(0.0), 2048.0)
    return view(spark, sf_dir, "points").select("pid", t0.alias("t0"), t1.alias("t1")).where("t0 <= t1")


@query("SELECT pid, 'V' || lpad(CAST(kind AS VARCHAR), 2, '0') AS block, printf('%.1f m', x_cm * 1.0) AS m, printf('%.2f m²', x_cm * 1.0) AS m2, printf('%.4f ha', x_cm / 10000.0) AS ha FROM points")
def display_texts(spark, sf_dir):
    x = F.col("x_cm")
    return view(spark, sf_dir, "points").select("pid", text.block_name(F.col("kind")).alias("block"), text.metres(x * 1.0).alias("m"), text.square_metres(x * 1.0).alias("m2"), text.hectares(x / 10000).alias("ha"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[^@\\s]+$') THEN lower(trim(' ' || c_name || '@Example.COM ')) END AS email, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END), '') AS name, TRY_CAST(CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS DOUBLE) AS num, regexp_extract('/a/b/' || c_name, '[^/]*$') AS base FROM customer")
def text_coercion(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.normal_email(F.concat(F.lit(" "), name, F.lit("@Example.COM "))).alias("email"), text.blank_to_null(F.when(k % 3 == 0, "  ").otherwise(name)).alias("name"), text.number(F.when(k % 4 == 0, "n/a").otherwise(k.cast("string"))).alias("num"), text.basename(F.concat(F.lit("/a/b/"), name)).alias("base"))


@query("SELECT block_id, row_number() OVER (ORDER BY CAST(substr(block_id, 2) AS BIGINT), block_id) AS place FROM (SELECT DISTINCT block_id FROM segments)")
def natural_order(spark, sf_dir):
    from pyspark.sql import Window

    head, number = text.natural_key(F.col("block_id"))
    return view(spark, sf_dir, "segments").select("block_id").distinct().select("block_id", F.row_number().over(Window.orderBy(head, number, "block_id")).cast("bigint").alias("place"))


@query("WITH g AS (SELECT col, row_, avg(CASE WHEN 2 * green - red - blue > 20 THEN 1.0 ELSE 0.0 END) AS s FROM cells GROUP BY ALL) SELECT col, row_, round(s, 6) AS share, CASE WHEN s < 0.25 THEN 'bare_soil' WHEN s > 0.75 THEN 'vegetation' ELSE 'mixed' END AS cover FROM g")
def cover_classes(spark, sf_dir):
    green = (text.excess_green(F.col("red"), F.col("green"), F.col("blue")) > 20).cast("double")
    share = view(spark, sf_dir, "cells").groupBy("col", "row_").agg(F.avg(green).alias("s"))
    return share.select("col", "row_", F.round("s", 6).alias("share"), text.cover_class(F.col("s")).alias("cover"))


@query("SELECT box_id, round(((xtl + xbr) / 2.0) / 2048, 6) AS cx, round(((ytl + least(ybr, 2048)) / 2.0) / 2048, 6) AS cy, round((xbr - xtl) / 2048.0, 6) AS w, round((least(ybr, 2048) - ytl) / 2048.0, 6) AS h FROM (SELECT box_id, xtl, ytl, least(xbr, 2048) AS xbr, ybr FROM boxes) WHERE xbr > xtl AND least(ybr, 2048) > ytl")
def normal_boxes(spark, sf_dir):
    """Boxes clipped to the image and given by normalised centre and size; empty ones go."""
    x0, y0 = F.col("xtl"), F.col("ytl")
    x1, y1 = F.least(F.col("xbr"), F.lit(2048)), F.least(F.col("ybr"), F.lit(2048))
    out = lambda v: F.round(v / 2048, 6)
    return view(spark, sf_dir, "boxes").where((x1 > x0) & (y1 > y0)).select("box_id", out((x0 + x1) / 2).alias("cx"), out((y0 + y1) / 2).alias("cy"), out((x1 - x0) / 1.0).alias("w"), out((y1 - y0) / 1.0).alias("h"))


@query("SELECT box_id, (xbr - xtl) * (ybr - ytl) BETWEEN 300 AND 15000 AS area_ok, xbr > xtl AND ybr > ytl AS ordered, score >= 0 AS measured, tile_no IN (1, 4, 7) AS chosen FROM boxes")
def shape_checks(spark, sf_dir):
    w, h = F.col("xbr") - F.col("xtl"), F.col("ybr") - F.col("ytl")
    return view(spark, sf_dir, "boxes").select("box_id", (w * h).between(300, 15000).alias("area_ok"), ((w > 0) & (h > 0)).alias("ordered"), (F.col("score") >= 0).alias("measured"), F.col("tile_no").isin(1, 4, 7).alias("chosen"))


@query("SELECT box_id, x0, xtl - x0 AS rx FROM (SELECT box_id, xtl, unnest([0, 512, 1024, 1408]) AS x0, xbr FROM boxes) WHERE xtl < x0 + 640 AND xbr > x0")
def sliding_windows(spark, sf_dir):
    """Boxes relative to the windows of 640 pixels every 512 that they meet; the last window ends at the edge."""
    from terrarow.operators.raster import window_starts

    got = view(spark, sf_dir, "boxes").withColumn("x0", F.explode(window_starts(2048, 640, 512)))
    return got.where((F.col("xtl") < F.col("x0") + 640) & (F.col("xbr") > F.col("x0"))).select("box_id", "x0", (F.col("xtl") - F.col("x0")).alias("rx"))
