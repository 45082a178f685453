"""Regions of rasters: territories of a vine mask, canopies parted where they touch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrarow.operators import canopies, grating, mosaic, territory

from .base import query, table, view

# the densest 7 % of each line are vine, its emptiest twentieth a barrier
_GROUND = "h AS (SELECT col AS x, row_ AS y, sum(v) AS v FROM cells GROUP BY ALL), q AS (SELECT x, y, percent_rank() OVER (PARTITION BY y ORDER BY v, x) AS p FROM h), g AS (SELECT x, y, y * 4294967296 + x AS id, p >= 0.93 AS vine FROM q WHERE p > 0.05)"
_PARTS = "n AS (SELECT DISTINCT b.x, b.y, b.id FROM g a JOIN g b ON a.vine AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), w AS (SELECT id, x, y, id AS l FROM n UNION SELECT b.id, b.x, b.y, w.l FROM w JOIN n b ON abs(w.x - b.x) <= 1 AND abs(w.y - b.y) <= 1), c AS (SELECT id, x, y, min(l) AS part FROM w GROUP BY ALL)"
# for each part the ground that ways by sides reach from outside its bounding box
_HOLES = "bb AS (SELECT part, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM c GROUP BY 1), o AS (SELECT part, x0 AS x, y0 AS y FROM bb UNION SELECT o.part, o.x + s.dx, o.y + s.dy FROM o JOIN bb ON bb.part = o.part JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) ON o.x + s.dx BETWEEN bb.x0 AND bb.x1 AND o.y + s.dy BETWEEN bb.y0 AND bb.y1 ANTI JOIN c ON c.part = o.part AND c.x = o.x + s.dx AND c.y = o.y + s.dy), f AS (SELECT bb.part, g.x, g.y FROM bb JOIN g ON g.x BETWEEN bb.x0 AND bb.x1 AND g.y BETWEEN bb.y0 AND bb.y1 ANTI JOIN o ON o.part = bb.part AND o.x = g.x AND o.y = g.y), k AS (SELECT part FROM f GROUP BY 1 HAVING count(*) >= 30 INTERSECT SELECT part FROM c JOIN g USING (id) GROUP BY 1 HAVING count(*) FILTER (g.vine) >= 4), t AS (SELECT f.x, f.y, max(f.part) AS territory FROM f JOIN k USING (part) GROUP BY ALL)"


def _territories(spark, sf_dir):
    line = Window.partitionBy("y").orderBy("v", "x")
    h = view(spark, sf_dir, "cells").groupBy(F.col("col").alias("x"), F.col("row_").alias("y")).agg(F.sum("v").alias("v"))
    p = F.percent_rank().over(line)
    return territory.territories(h.select("x", "y", (p >= 0.93).alias("vine"), (p > 0.05).alias("free")), 1, 4, 30)


@query(f"WITH RECURSIVE {_GROUND}, {_PARTS}, {_HOLES} SELECT x, y, CAST(territory AS BIGINT) AS territory FROM t")
def vine_territories(spark, sf_dir):
    """Territories of the densest cells: grown by one, parted by barriers, holes filled."""
    return _territories(spark, sf_dir)


@query(f"WITH RECURSIVE {_GROUND}, {_PARTS}, {_HOLES} SELECT CAST(territory AS BIGINT) AS territory, count(*) AS cells, row_number() OVER (ORDER BY sum(y) / count(*), sum(x) / count(*), territory) AS place FROM t GROUP BY territory")
def territory_order(spark, sf_dir):
    """The same territories numbered from north to south, then west to east."""
    return territory.north_west_order(_territories(spark, sf_dir))


# three parts make one canopy: their boxes at places in a frame of 40 by 30, in pixels of two
_CANOPY = "b AS (SELECT p_partkey // 3 AS canopy, (p_partkey * 37) % 40 AS xtl, (p_partkey * 91) % 30 AS ytl, 10 + p_size AS w, 10 + (p_size * 7) % 30 AS h FROM part), c AS (SELECT DISTINCT canopy, u.x, v.y FROM b, LATERAL (SELECT unnest(range(CAST(xtl // 2 AS INTEGER), CAST((xtl + w) // 2 AS INTEGER))) AS x) u, LATERAL (SELECT unnest(range(CAST(ytl // 2 AS INTEGER), CAST((ytl + h) // 2 AS INTEGER))) AS y) v)"
_OPENED = "core AS (SELECT c.* FROM c SEMI JOIN c l ON l.canopy = c.canopy AND l.y = c.y AND l.x = c.x - 1 SEMI JOIN c r ON r.canopy = c.canopy AND r.y = c.y AND r.x = c.x + 1 SEMI JOIN c u ON u.canopy = c.canopy AND u.x = c.x AND u.y = c.y - 1 SEMI JOIN c d ON d.canopy = c.canopy AND d.x = c.x AND d.y = c.y + 1), m AS (SELECT DISTINCT canopy, x + dx AS x, y + dy AS y FROM core, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy))"


def _heights(of):
    """Squared distances to the nearest place beside a cell that is none, by trying all of them in the canopy's frame."""
    return f"rim AS (SELECT DISTINCT canopy, x + dx AS x, y + dy AS y FROM {of}, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) EXCEPT SELECT canopy, x, y FROM {of}), z AS (SELECT {of}.canopy, {of}.x, {of}.y, min(({of}.x - rim.x) * ({of}.x - rim.x) + ({of}.y - rim.y) * ({of}.y - rim.y)) AS height2 FROM {of} JOIN rim USING (canopy) GROUP BY ALL)"


_MARKS = "k AS (SELECT * FROM z WHERE height2 > 9 AND height2 = (SELECT max(o.height2) FROM z o WHERE o.canopy = z.canopy AND abs(o.x - z.x) <= 5 AND abs(o.y - z.y) <= 5)), pl AS (SELECT canopy, x, y, y * 1000 + x AS l FROM k UNION SELECT k.canopy, k.x, k.y, pl.l FROM pl JOIN k ON k.canopy = pl.canopy AND abs(k.x - pl.x) <= 1 AND abs(k.y - pl.y) <= 1), mk AS (SELECT canopy, x, y, min(l) AS marker FROM pl GROUP BY ALL), sv AS (SELECT canopy FROM mk GROUP BY 1 HAVING count(DISTINCT marker) > 1)"
_FLOOD = "sd AS (SELECT m.canopy, m.x, m.y, max(marker) AS marker FROM mk JOIN sv USING (canopy) JOIN m ON m.canopy = mk.canopy AND (m.x - mk.x) * (m.x - mk.x) + (m.y - mk.y) * (m.y - mk.y) <= 5 GROUP BY ALL), fl AS (SELECT canopy, x, y, marker, 0 AS hop FROM sd UNION SELECT m.canopy, m.x, m.y, fl.marker, fl.hop + 1 FROM fl JOIN m ON m.canopy = fl.canopy AND abs(m.x - fl.x) + abs(m.y - fl.y) = 1 ANTI JOIN sd ON sd.canopy = m.canopy AND sd.x = m.x AND sd.y = m.y WHERE fl.hop < 60), e AS (SELECT canopy, x, y, arg_min(marker, hop * 1000000 + marker) AS part FROM fl GROUP BY ALL UNION ALL SELECT canopy, x, y, min(y * 1000 + x) OVER (PARTITION BY canopy) FROM m WHERE canopy NOT IN (SELECT canopy FROM sv))"


def _canopy_boxes(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey div 3 as canopy", "cast((p_partkey * 37) % 40 as int) as xtl", "cast((p_partkey * 91) % 30 as int) as ytl", "10 + p_size as w", "10 + (p_size * 7) % 30 as h")


def _canopy_cells(spark, sf_dir):
    boxes = _canopy_boxes(spark, sf_dir)
    span = lambda at, side: F.explode(F.expr(f"sequence(cast({at} div 2 as int), cast(({at} + {side}) div 2 as int) - 1)"))
    return boxes.withColumn("x", span("xtl", "w")).withColumn("y", span("ytl", "h")).select("canopy", "x", "y").distinct()


@query(f"WITH {_CANOPY}, {_heights('c')} SELECT * FROM z")
def canopy_heights(spark, sf_dir):
    """Exact squared distance of each canopy cell to what is outside its canopy."""
    return canopies.heights(_canopy_cells(spark, sf_dir)).withColumn("height2", F.col("height2").cast("bigint"))


@query(f"WITH RECURSIVE {_CANOPY}, {_OPENED}, {_heights('m')}, {_MARKS}, {_FLOOD} SELECT canopy, CAST(part % 1000 AS INTEGER) AS part_x, CAST(part // 1000 AS INTEGER) AS part_y, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM e GROUP BY ALL")
def canopy_parts(spark, sf_dir):
    """Canopies parted where three boxes touch: cells and their place sums by part."""
    whole = lambda e: F.expr(f"cast({e} as int)")
    boxes = _canopy_boxes(spark, sf_dir).select("canopy", whole("xtl div 2").alias("x"), whole("ytl div 2").alias("y"), whole("(xtl + w) div 2 - 1").alias("x1"), whole("(ytl + h) div 2 - 1").alias("y1"))
    cells = canopies.parted(boxes, 5, 3.0)
    return cells.groupBy("part").agg(F.count("*").alias("cells"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")).select("part.canopy", F.col("part.x").alias("part_x"), F.col("part.y").alias("part_y"), "cells", "sum_x", "sum_y")


# a raster of 16 by 16 pixels for each supplier: on the common grid (so the first), of larger pixels, or slanted
_RASTERS = ["s_suppkey as raster", "s_suppkey as place", "35 as zone", "16 as width", "16 as height"]


def _numbers():
    """The six numbers of each raster, in fractions of two: exact in both engines."""
    c = "CAST({} AS DOUBLE)"
    kind = lambda one, two, three: c.format(f"CASE s_suppkey % 3 WHEN 0 THEN {one} WHEN 1 THEN {two} ELSE {three} END")
    whole = "floor(s_suppkey / 10)"
    return [f"{kind('0.5', '0.75', '0.5')} AS a", f"{kind('0', '0', '0.25')} AS b", f"{c.format('628992 + s_suppkey % 10 * 6')} + {kind('0', '0.3125', '0.125')} AS c", f"{kind('0', '0', '0.25')} AS d", f"{kind('-0.5', '-0.75', '-0.5')} AS e", f"{c.format(f'5221222 - {whole} * 6')} + {kind('0', '0.1875', '0.375')} AS f"]


_PIXELS = ["l_suppkey as raster", "l_partkey % 16 as px", "l_orderkey % 16 as py", "cast(l_quantity as int) as v"]
_WARP = f"r AS (SELECT s_suppkey AS raster, 16 AS n, {', '.join(_numbers())} FROM supplier), k AS (SELECT raster, unnest([c, c + 16 * a, c + 16 * b, c + 16 * a + 16 * b]) AS x, unnest([f, f + 16 * d, f + 16 * e, f + 16 * d + 16 * e]) AS y FROM r), z AS (SELECT 628992 + floor((min(x) - 628992) * 2) / 2 AS x0, 5221222 + ceil((max(y) - 5221222) * 2) / 2 AS y0 FROM k), w AS (SELECT raster, CAST(floor(min(x - x0) * 2) AS BIGINT) AS c0, CAST(ceil(max(x - x0) * 2) AS BIGINT) AS c1, CAST(floor(min(y0 - y) * 2) AS BIGINT) AS r0, CAST(ceil(max(y0 - y) * 2) AS BIGINT) AS r1 FROM k, z GROUP BY 1), g AS (SELECT raster, col, unnest(range(r0, r1)) AS row FROM (SELECT *, unnest(range(c0, c1)) AS col FROM w)), m AS (SELECT raster, col, row, x0 + (col + 0.5) / 2 - c AS dx, y0 - (row + 0.5) / 2 - f AS dy, a, b, d, e FROM g JOIN r USING (raster), z), p AS (SELECT raster, col, row, CAST(floor((e * dx - b * dy) / (a * e - b * d)) AS BIGINT) AS px, CAST(floor((a * dy - d * dx) / (a * e - b * d)) AS BIGINT) AS py FROM m), v AS (SELECT l_suppkey AS raster, l_partkey % 16 AS px, l_orderkey % 16 AS py, max(CAST(l_quantity AS INTEGER)) AS v FROM lineitem GROUP BY ALL)"


@query(f"WITH {_WARP} SELECT col, row, arg_max(coalesce(v, 0), raster) AS v FROM p LEFT JOIN v USING (raster, px, py) WHERE px BETWEEN 0 AND 15 AND py BETWEEN 0 AND 15 GROUP BY ALL")
def warped_mosaic(spark, sf_dir):
    """Rasters of unlike grids on one grid, the last on top; only cells whose middle a raster holds."""
    return _warped(spark, sf_dir, False)


@query(f"WITH {_WARP} SELECT col, row, arg_max(coalesce(v, 0), raster) AS v FROM p LEFT JOIN v USING (raster, px, py) GROUP BY ALL")
def warped_windows(spark, sf_dir):
    """The same with every raster's whole window set."""
    return _warped(spark, sf_dir, True)


def _warped(spark, sf_dir, over):
    rasters = table(spark, sf_dir, "supplier").selectExpr(*_RASTERS, *_numbers())
    pixels = table(spark, sf_dir, "lineitem").selectExpr(*_PIXELS).groupBy("raster", "px", "py").agg(F.max("v").alias("v"))
    return mosaic.mosaic(rasters, pixels, ["v"], mosaic.grid_of(rasters), over)


@query()
def row_grating(spark, sf_dir):
    """Strongest direction of rows around each cell and its energy, and the next direction's, for cells of a metre; no SQL, which was too slow."""
    cells = view(spark, sf_dir, "cells").select(F.col("col").alias("x"), F.col("row_").alias("y"), "red", "green", "blue")
    return grating.energy(cells, 1.0).select("x", "y", "degrees", F.round("peak", 6).alias("peak"), F.round("second", 6).alias("second"))
