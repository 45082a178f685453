"""Corridors as tables of edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrarow.operators import corridors

from .base import query, table, view

#: A zone in each block, in centimetres.
_ZONES = ("(c_custkey * 37) % 6000", "c_custkey * 3000 + (c_custkey * 91) % 2500", "500 + c_custkey % 700", "300 + c_custkey % 500")


@query(f"""WITH zone AS (SELECT c_custkey AS block_no, ({_ZONES[0]}) / 100 AS x0, ({_ZONES[1]}) / 100 AS y0, ({_ZONES[0]} + {_ZONES[2]}) / 100 AS x1, ({_ZONES[1]} + {_ZONES[3]}) / 100 AS y1 FROM customer),
line AS (SELECT strip_id, (block_no * 3000 + t_cm) / 100 AS y, s0_cm / 100 AS x0, s1_cm / 100 AS x1, greatest(2, ceil((s1_cm / 100 - s0_cm / 100) / 5))::INT AS steps FROM strips WHERE s1_cm - s0_cm >= 500),
node AS (SELECT strip_id, y, k, x0 + (k / steps) * (x1 - x0) AS x FROM (SELECT *, unnest(range(0, steps + 1)) AS k FROM line)),
kept AS (SELECT * FROM node n WHERE NOT EXISTS (SELECT 1 FROM zone z WHERE n.x > z.x0 AND n.x < z.x1 AND n.y > z.y0 AND n.y < z.y1)),
island AS (SELECT *, k - row_number() OVER (PARTITION BY strip_id ORDER BY k) AS i, lead(k) OVER (PARTITION BY strip_id ORDER BY k) AS k1, lead(x) OVER (PARTITION BY strip_id ORDER BY k) AS x1 FROM kept),
run AS (SELECT *, min(k) OVER (PARTITION BY strip_id, i) AS run FROM island),
edge AS (SELECT * FROM run r WHERE k1 = k + 1 AND NOT EXISTS (SELECT 1 FROM zone z WHERE least(r.x1, z.x1) > greatest(r.x, z.x0) AND r.y >= z.y0 AND r.y <= z.y1))
SELECT strip_id, run, count(*) AS edges, CAST(sum(CAST(round((x1 - x) * 1000000) AS BIGINT)) AS BIGINT) AS length_um, round(min(x), 3) AS first_m, round(max(x1), 3) AS last_m FROM edge GROUP BY strip_id, run""")
def corridor_runs(spark, sf_dir):
    """What zones leave of the middle lines of strips: edges, length and ends of each run."""
    strips = view(spark, sf_dir, "strips")
    y = (F.col("block_no").cast("bigint") * 3000 + F.col("t_cm")) / 100
    lines = strips.select(F.col("strip_id").alias("line"), (F.col("s0_cm") / 100).alias("x0"), y.alias("y0"), (F.col("s1_cm") / 100).alias("x1"), y.alias("y1"))
    x0, y0, w, h = map(F.expr, _ZONES)
    at = lambda x, y: F.struct((x / 100).alias("x"), (y / 100).alias("y"))
    zones = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("passage"), F.array(at(x0, y0), at(x0 + w, y0), at(x0 + w, y0 + h), at(x0, y0 + h)).alias("ring"))
    edges = corridors.centre_edges(lines, zones)
    m = lambda c: F.round(c, 3)
    return edges.groupBy(F.col("line").alias("strip_id"), "run").agg(F.count("*").alias("edges"), F.sum(F.round(F.col("w") * 1000000).cast("bigint")).alias("length_um"), m(F.min("x0")).alias("first_m"), m(F.max("x1")).alias("last_m"))
