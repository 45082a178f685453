"""Reports, predicates, lookups and polygon kernels on the survey views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terrarow.functions import geom
from terrarow.operators import greedy, rows, spatial

from .base import query, table, view
from .row_queries import row_stats


@query("WITH k AS (SELECT block_no, row_no, CASE WHEN l_linenumber = 7 THEN 'disrupted' WHEN l_linenumber > 4 THEN 'unassessable' ELSE 'regular' END AS st, s_cm, l_orderkey, l_linenumber FROM vines) SELECT block_no, row_no, CASE WHEN bool_or(st = 'disrupted') THEN 'disrupted' ELSE arg_min(st, s_cm * 1000000000 + l_orderkey * 10 + l_linenumber) END AS structure FROM k GROUP BY ALL")
def row_structure(spark, sf_dir):
    """Disrupted if any piece is, else the structure seen first."""
    st = F.when(F.col("l_linenumber") == 7, "disrupted").when(F.col("l_linenumber") > 4, "unassessable").otherwise("regular")
    first = F.min_by(st, F.struct("s_cm", "l_orderkey", "l_linenumber"))
    return view(spark, sf_dir, "vines").groupBy("block_no", "row_no").agg(F.when(F.bool_or(st == "disrupted"), "disrupted").otherwise(first).alias("structure"))


@query("WITH v AS (SELECT block_no, l_linenumber AS cover, sum(t_cm * s_cm) AS w FROM vines GROUP BY ALL) SELECT block_no, arg_max(cover, w) AS cover FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY block_no ORDER BY w DESC, cover) = 1) GROUP BY 1")
def area_weighted_cover(spark, sf_dir):
    v = view(spark, sf_dir, "vines").select("block_no", F.col("l_linenumber").alias("cover"), (F.col("t_cm") * F.col("s_cm")).alias("w"))
    return rows.majority(v, ["block_no"], "cover", F.col("w"), "cover_won").select("block_no", F.col("cover_won").alias("cover"))


_STATS = "o AS (SELECT block_no, row_no, s_cm, s_cm - lag(s_cm) OVER (PARTITION BY block_no, row_no ORDER BY s_cm, l_orderkey, l_linenumber) AS d FROM vines), r AS (SELECT block_no, row_no, count(*) AS n, max(s_cm) - min(s_cm) AS len, count(*) FILTER (d >= 500) AS gaps FROM o GROUP BY ALL)"


@query(f"WITH {_STATS} SELECT 'V' || lpad(CAST(block_no AS VARCHAR), 2, '0') AS block, CAST(row_no AS VARCHAR) AS row_name, round(len / 100.0, 2) AS length_m, n AS plants FROM r UNION ALL SELECT 'ALL', 'TOTAL', round(sum(round(len / 100.0, 2)), 2), CAST(sum(n) AS BIGINT) FROM r")
def measurement_table(spark, sf_dir):
    """One line per row and a total line of the rounded values."""
    from terrarow.functions.text import block_name

    own = row_stats(view(spark, sf_dir, "vines")).select(block_name(F.col("block_no")).alias("block"), F.col("row_no").cast("string").alias("row_name"), F.round(F.col("len") / 100, 2).alias("length_m"), F.col("n").alias("plants"))
    total = own.agg(F.lit("ALL").alias("block"), F.lit("TOTAL").alias("row_name"), F.round(F.sum("length_m"), 2).alias("length_m"), F.sum("plants").alias("plants"))
    return own.unionByName(total)


@query(f"WITH {_STATS} SELECT block_no, count(*) AS row_count, count(*) FILTER (gaps > 0) AS disrupted, count(*) FILTER (gaps = 0) AS regular, round(sum(len) / 100.0, 2) AS length_m FROM r GROUP BY 1")
def block_panel(spark, sf_dir):
    s = row_stats(view(spark, sf_dir, "vines"))
    return s.groupBy("block_no").agg(F.count("*").alias("row_count"), F.count_if(F.col("gaps") > 0).alias("disrupted"), F.count_if(F.col("gaps") == 0).alias("regular"), F.round(F.sum("len") / 100, 2).alias("length_m"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, count(DISTINCT p_partkey) AS images, count(l_orderkey) AS boxes, count(DISTINCT p_partkey) FILTER (l_orderkey IS NULL) AS empty FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def split_stats(spark, sf_dir):
    """Images, boxes and empty images by split; boxes are counted per image before the join."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    k = F.col("p_partkey") % 3
    split = F.when(k == 0, "train").when(k == 1, "valid").otherwise("test").alias("split")
    return table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy(split).agg(F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"), F.count_if(F.col("n").isNull()).alias("empty"))


@query("SELECT o_orderkey, coalesce(c_custkey = o_custkey AND c_nationkey = 7, false) AS owned FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def ownership(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(F.col("c_nationkey") == 7, F.lit(False)).alias("owned"))


@query("WITH r AS (SELECT kind AS raster, min(x_cm) AS x0, min(y_cm) AS y0, max(x_cm) AS x1, max(y_cm) AS y1 FROM points GROUP BY 1) SELECT box_id, raster FROM boxes JOIN r ON xtl >= x0 AND xbr <= x1 AND ytl >= y0 AND ybr <= y1")
def shapes_in_rasters(spark, sf_dir):
    """Shapes whose points all lie in a raster's extent."""
    r = view(spark, sf_dir, "points").groupBy(F.col("kind").alias("raster")).agg(F.min("x_cm").alias("xtl_b"), F.min("y_cm").alias("ytl_b"), F.max("x_cm").alias("xbr_b"), F.max("y_cm").alias("ybr_b"))
    b = view(spark, sf_dir, "boxes").withColumn("ring", geom.box_ring(*(F.col(c) for c in ("xtl", "ytl", "xbr", "ybr"))))
    inside = F.forall("ring", lambda p: p["x"].between(F.col("xtl_b"), F.col("xbr_b")) & p["y"].between(F.col("ytl_b"), F.col("ybr_b")))
    return spatial.box_pairs(b, r, 256).where(inside).select("box_id", "raster")


@query("SELECT DISTINCT tile_no, s_suppkey AS shape FROM boxes JOIN supplier ON tile_no = s_suppkey % 9")
def shapes_by_tile_key(spark, sf_dir):
    keys = view(spark, sf_dir, "boxes").select("tile_no").distinct()
    return keys.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shape"), (F.col("s_suppkey") % 9).cast("int").alias("tile_no")), "tile_no").select("tile_no", "shape")


@query("WITH e AS (SELECT strip_id, block_no, s1_cm AS at, t_cm FROM strips), p AS (SELECT a.strip_id AS a, b.strip_id AS b, (a.at - b.at) * (a.at - b.at) + (a.t_cm - b.t_cm) * (a.t_cm - b.t_cm) AS d2 FROM e a JOIN e b ON a.block_no = b.block_no AND a.strip_id < b.strip_id) SELECT a, b, CAST(d2 AS BIGINT) AS d2 FROM p WHERE d2 <= 90000")
def connected_ends(spark, sf_dir):
    """Row ends of a block within 3 m."""
    e = view(spark, sf_dir, "strips").select("strip_id", "block_no", F.col("s1_cm").alias("at"), "t_cm")
    f = e.select(F.col("strip_id").alias("o"), "block_no", F.col("at").alias("at2"), F.col("t_cm").alias("t2"))
    return spatial.distance_pairs(e, f, "at", "t_cm", "at2", "t2", 300, ["block_no"]).where("strip_id < o").select(F.col("strip_id").alias("a"), F.col("o").alias("b"), F.col("d2").cast("bigint").alias("d2"))


@query("SELECT col, row_, arg_max(v, l) AS v, max(l) AS layer FROM (SELECT col, row_, v, red * 1000000 + green * 1000 + blue AS l, max(v) OVER (PARTITION BY col, row_, red, green, blue) AS top FROM cells) WHERE v = top GROUP BY ALL")
def mosaic(spark, sf_dir):
    """Cells of overlapping layers: the last layer wins, within it the largest value."""
    layer = F.col("red") * 1000000 + F.col("green") * 1000 + F.col("blue")
    return view(spark, sf_dir, "cells").groupBy("col", "row_").agg(F.max(F.struct(layer.alias("l"), "v")).alias("m")).select("col", "row_", "m.v", F.col("m.l").alias("layer"))


@query("WITH s AS (SELECT kind, pid, x_cm, y_cm, lag(x_cm) OVER w AS px, lag(y_cm) OVER w AS py FROM points WINDOW w AS (PARTITION BY kind ORDER BY pid)) SELECT kind, pid, round(sum(coalesce(sqrt((x_cm - px) * (x_cm - px) + (y_cm - py) * (y_cm - py)), 0)) OVER (PARTITION BY kind ORDER BY pid), 3) AS along FROM s")
def length_along(spark, sf_dir):
    """Length of a path up to each of its points."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy("pid")
    step = F.coalesce(F.hypot(F.col("x_cm") - F.lag("x_cm").over(w), F.col("y_cm") - F.lag("y_cm").over(w)), F.lit(0.0))
    return view(spark, sf_dir, "points").withColumn("step", step).select("kind", "pid", F.round(F.sum("step").over(w), 3).alias("along"))


@query("SELECT box_id, CAST(greatest(0, least(xbr, 1024) - greatest(xtl, 512)) * greatest(0, least(ybr, 1024) - greatest(ytl, 512)) AS DOUBLE) AS area FROM boxes WHERE xtl < 1024 AND xbr > 512 AND ytl < 1024 AND ybr > 512")
def clipped_polygons(spark, sf_dir):
    """Rings cut to a tile, by the side-by-side clip."""
    b = view(spark, sf_dir, "boxes").where("xtl < 1024 AND xbr > 512 AND ytl < 1024 AND ybr > 512").select("box_id", geom.box_ring(*(F.col(c) for c in ("xtl", "ytl", "xbr", "ybr"))).alias("ring"))
    kind = dict(b.dtypes)["box_id"]

    def run(batches):
        for pdf in batches:
            out = []
            for ring in pdf.ring:
                p = greedy.clip_polygon(np.array([(q["x"], q["y"]) for q in ring], float), 512, 512, 1024, 1024)
                x, y = (p[:, 0], p[:, 1]) if len(p) else (np.zeros(0), np.zeros(0))
                out.append(abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2)
            yield pd.DataFrame({"box_id": pdf.box_id, "area": out})

    return b.mapInPandas(run, f"box_id {kind}, area double")


@query("SELECT tile_no, CAST(count(*) AS BIGINT) AS n, CAST(greatest(max(xbr) - min(xtl), max(ybr) - min(ytl)) AS DOUBLE) >= 0 AS made FROM boxes GROUP BY 1")
def centre_lines(spark, sf_dir):
    """The centre line of the smallest rectangle about each tile's boxes exists and is as long as the rectangle's long side."""
    b = view(spark, sf_dir, "boxes")
    kind = dict(b.dtypes)["tile_no"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.concatenate([pdf[["xtl", "ytl"]].to_numpy(float), pdf[["xbr", "ybr"]].to_numpy(float)])
        a, z = greedy.least_rectangle(p)
        hull = greedy.convex_hull(p)
        reach = max(np.hypot(*(q - hull).T).max() for q in hull)
        return pd.DataFrame({"tile_no": [pdf.tile_no.iloc[0]], "n": [len(pdf)], "made": [bool(0 < np.hypot(*(z - a)) <= reach + 1e-6)]})

    return b.select("tile_no", "xtl", "ytl", "xbr", "ybr").groupBy("tile_no").applyInPandas(run, f"tile_no {kind}, n bigint, made boolean")


@query("SELECT strip_id, round(1.2 * (s1_cm - s0_cm) / 100, 4) AS area FROM (SELECT strip_id, s0_cm, s1_cm FROM strips)")
def row_strips(spark, sf_dir):
    """Obstacle strips 0.6 m to both sides of a row: area of the ring about a straight line."""
    s = view(spark, sf_dir, "strips")
    line = F.array(geom.point(F.col("s0_cm") / 100, F.lit(0)), geom.point((F.col("s0_cm") + F.col("s1_cm")) / 200, F.lit(0)), geom.point(F.col("s1_cm") / 100, F.lit(0)))
    return s.select("strip_id", F.round(geom.area(F.array(geom.strip(line, 0.6))), 4).alias("area"))
