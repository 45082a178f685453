"""Graphs of passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrarow.operators import passages

from .base import query, table

#: A slanted road around a yard for each customer, in centimetres: place, size, width of the road and slant in tenths.
_YARD = ("(c_custkey % 1000) * 20000 + (c_custkey * 37) % 9000", "(c_custkey // 1000) * 20000 + (c_custkey * 53) % 9000", "6000 + (c_custkey % 90) * 100", "4000 + (c_custkey * 7 % 50) * 100", "500 + (c_custkey % 5) * 100", "c_custkey % 7 - 3")


@query(f"""WITH yard AS (SELECT c_custkey AS passage, {", ".join(f"{e} AS {n}" for e, n in zip(_YARD, ("x", "y", "w", "h", "t", "s"), strict=True))} FROM customer),
corner AS (SELECT passage, hole, unnest([{{'k': 0, 'u': 0, 'v': 0}}, {{'k': 1, 'u': w, 'v': 0}}, {{'k': 2, 'u': w, 'v': h}}, {{'k': 3, 'u': 0, 'v': h}}]) AS c, x, y, s FROM
 (SELECT passage, false AS hole, x, y, s, w, h FROM yard UNION ALL SELECT passage, true, x + t + t * s / 10, y + t, s, w - 2 * t, h - 2 * t FROM yard)),
placed AS (SELECT passage, hole, CASE WHEN hole THEN -c.k ELSE c.k END AS k, (x + c.u + c.v * s / 10) / 100 AS x, (y + c.v) / 100 AS y FROM corner),
side AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM placed WINDOW o AS (PARTITION BY passage, hole ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cut AS (SELECT *, greatest(1, ceil(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 5))::INT AS steps FROM side),
point AS (SELECT passage, hole, k, i, floor((x + (i / steps) * (nx - x)) * 1000 + 0.5)::BIGINT AS x, floor((y + (i / steps) * (ny - y)) * 1000 + 0.5)::BIGINT AS y FROM (SELECT *, unnest(range(0, steps)) AS i FROM cut)),
next AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM point WINDOW o AS (PARTITION BY passage, hole ORDER BY k, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT passage, count(*) AS triangles, count(*) AS ways, CAST(sum(CAST(x AS HUGEINT) * ny - CAST(nx AS HUGEINT) * y) AS BIGINT) AS area2_mm2 FROM next GROUP BY passage""")
def passage_graph(spark, sf_dir):
    """Triangles that fill each road around a yard, the ways between those that share a side, and their area."""
    x, y, w, h, t, s = (F.expr(e.replace("//", "div")) for e in _YARD)
    yards = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("passage"), *(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"), (t, "t"), (s, "s"))))
    at = lambda u, v: F.struct(((F.col("x") + u + v * F.col("s") / 10) / 100).alias("x"), ((F.col("y") + v) / 100).alias("y"))
    o = F.lit(0.0)
    ring = F.array(at(o, o), at(F.col("w"), o), at(F.col("w"), F.col("h")), at(o, F.col("h")))
    holes = yards.select("passage", "s", (F.col("x") + F.col("t") + F.col("t") * F.col("s") / 10).alias("x"), (F.col("y") + F.col("t")).alias("y"), (F.col("w") - 2 * F.col("t")).alias("w"), (F.col("h") - 2 * F.col("t")).alias("h"))
    rings = yards.select("passage", F.lit(False).alias("hole"), ring.alias("ring")).union(holes.select("passage", F.lit(True), ring))
    made = passages.graphs(rings, 5.0)
    area2 = F.aggregate("triangles", F.lit(0).cast("long"), lambda s, t: s + t["area2"])
    return made.groupBy("passage").agg(F.sum(F.size("triangles")).alias("triangles"), F.sum(F.size("ways")).alias("ways"), F.sum(area2).alias("area2_mm2"))
