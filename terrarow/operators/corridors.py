"""Walkable middle lines as tables of edges: of known strips, and of the free space between outlines that face each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .passages import _let
from .unify import _with_boxes, crossings, within_convex

#: Cells of the joins between lines and zones, in metres.
CELL = 64.0


def _inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies within a convex ring (counter-clockwise), not on it."""
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.forall(F.arrays_zip(ring.alias("p"), following.alias("q")), lambda e: (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (x - e["p"]["x"]) > 0)


def centre_edges(lines: DataFrame, forbidden: DataFrame, step: float = 5.0, least: float = 5.0) -> DataFrame:
    """line, run, k, x0, y0, x1, y1, w: edges along lines (line, x0, y0, x1, y1) of least length or more, cut by zones.

    Nodes stand every step or less, ends included; those inside a zone (passage, ring: convex, counter-clockwise) go,
    and what is left of a line falls into runs; an edge that a zone crosses goes too. run is the k of a run's first node.
    """
    size = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    steps = F.greatest(F.lit(2), F.ceil(size / step)).cast("int")
    long = lines.withColumn("steps", steps).where(size >= least)
    # zones are brought to lines once; nodes and edges are judged within a line's arrays, without a row for each in any join
    boxed = long.withColumns({"xtl": F.least("x0", "x1") - 0.01, "ytl": F.least("y0", "y1") - 0.01, "xbr": F.greatest("x0", "x1") + 0.01, "ybr": F.greatest("y0", "y1") + 0.01})
    near = spatial.box_pairs(boxed, _with_boxes(forbidden), CELL).groupBy("line").agg(F.collect_list("ring").alias("rings"))
    met = long.join(near.hint("merge"), "line", "left")
    at = lambda k: k / F.col("steps")
    node = lambda k: F.struct(k.alias("k"), (F.col("x0") + at(k) * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + at(k) * (F.col("y1") - F.col("y0"))).alias("y"))
    nodes = F.transform(F.sequence(F.lit(0), F.col("steps")), node)
    kept = F.when(F.col("rings").isNull(), F.col("nodes")).otherwise(F.filter("nodes", lambda n: ~F.exists("rings", lambda r: _inside(n["x"], n["y"], r))))
    # run: the first node of the stretch without lost ones that a node lies in
    started = F.transform("kept", lambda n, i: F.when((i == 0) | (F.get("kept", i - 1)["k"] != n["k"] - 1), n["k"]))
    first = F.slice("kept", 1, F.greatest(F.size("kept") - 1, F.lit(0)))
    ways = _let(started, lambda st: F.transform(first, lambda n, i: F.struct(n.alias("p"), F.get("kept", i + 1).alias("q"), F.array_max(F.slice(st, 1, i + 1)).alias("run"))))
    pairs = F.filter(ways, lambda e: e["q"]["k"] == e["p"]["k"] + 1)

    def barred(e: Column, ring: Column) -> Column:
        part = within_convex(e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"], ring)
        return F.exists(F.array(part), lambda t: t["end"] > t["start"])

    edges = met.withColumn("nodes", nodes).withColumn("kept", kept).withColumn("edges", pairs)
    free = F.when(F.col("rings").isNull(), F.col("edges")).otherwise(F.filter("edges", lambda e: ~F.exists("rings", lambda r: barred(e, r))))
    out = edges.select("line", F.explode(free).alias("e")).select("line", "e.run", "e.p.k", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))
    return out.withColumn("w", F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))))


def gap_corridors(strips: DataFrame, reach: float, parallel: float = 0.94, stations: int = 5) -> DataFrame:
    """a, b, half, k, x0, y0, x1, y1: middle lines of the free space between strips that run side by side.

    strips: strip, ring (convex, counter-clockwise) and its axis x0, y0, x1, y1. Axes within reach of each other whose
    directions' cosine is parallel or more, and which run together for a metre, are sampled at stations; at each the
    middle lies between where the way across leaves the one outline and enters the other. Ways without free space give no sample,
    corridors of fewer than two samples, of under a metre, or that run into any outline are none. half: half the least width.
    """
    size = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    axes = strips.withColumn("_l", size).where("_l >= 1").withColumns({"dx": (F.col("x1") - F.col("x0")) / F.col("_l"), "dy": (F.col("y1") - F.col("y0")) / F.col("_l")})
    grown = lambda s, d: {"xtl" + s: F.least("x0" + s, "x1" + s) - d, "ytl" + s: F.least("y0" + s, "y1" + s) - d, "xbr" + s: F.greatest("x0" + s, "x1" + s) + d, "ybr" + s: F.greatest("y0" + s, "y1" + s) + d}
    second = axes.select(*(F.col(c).alias(f"{c}_b") for c in axes.columns))
    pairs = spatial.box_pairs(axes.withColumns(grown("", reach)), second.withColumns(grown("_b", 1e-6)), CELL).where(F.col("strip") < F.col("strip_b"))
    turn = F.col("dx") * F.col("dx_b") + F.col("dy") * F.col("dy_b")
    along = lambda x, y: (F.col(x) - F.col("x0")) * F.col("dx") + (F.col(y) - F.col("y0")) * F.col("dy")
    lo, hi = F.greatest(F.lit(0.0), F.least(along("x0_b", "y0_b"), along("x1_b", "y1_b"))), F.least(F.col("_l"), F.greatest(along("x0_b", "y0_b"), along("x1_b", "y1_b")))
    side = pairs.where(F.abs(turn) >= parallel).withColumns({"_lo": lo, "_hi": hi}).where(F.col("_hi") - F.col("_lo") >= 1)
    at = side.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(stations - 1)))).withColumn("_s", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("k") / (stations - 1))
    ax, ay = F.col("x0") + F.col("_s") * F.col("dx"), F.col("y0") + F.col("_s") * F.col("dy")
    # the point of b's axis at the same station along a's
    reach_b = (F.col("_s") - along("x0_b", "y0_b")) / turn
    way = at.withColumns({"ax": ax, "ay": ay, "bx": F.col("x0_b") + reach_b * F.col("dx_b"), "by": F.col("y0_b") + reach_b * F.col("dy_b")})
    way = way.withColumn("_w", F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))).where((F.col("_w") > 0) & (F.col("_w") <= reach))
    cross = lambda ring: within_convex(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col(ring))
    free = way.withColumns({"_out": cross("ring")["end"], "_in": cross("ring_b")["start"]}).where(F.col("_in") > F.col("_out"))
    middle = (F.col("_out") + F.col("_in")) / 2
    w = Window.partitionBy("a", "b")
    samples = free.select(F.col("strip").alias("a"), F.col("strip_b").alias("b"), "k", (F.col("ax") + middle * (F.col("bx") - F.col("ax"))).alias("x0"), (F.col("ay") + middle * (F.col("by") - F.col("ay"))).alias("y0"), ((F.col("_in") - F.col("_out")) * F.col("_w") / 2).alias("_half"))
    edges = samples.withColumns({"half": F.min("_half").over(w), "x1": F.lead("x0").over(w.orderBy("k")), "y1": F.lead("y0").over(w.orderBy("k"))}).where("x1 IS NOT NULL").drop("_half")
    whole = edges.groupBy("a", "b").agg(F.sum(F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))).alias("_all")).where("_all >= 1")
    blocked = crossings(edges, strips.select(F.col("strip").alias("passage"), "ring"), ["a", "b"], CELL).where(F.col("end") - F.col("start") > 1e-6).select("a", "b").distinct()
    return edges.join(whole, ["a", "b"], "left_semi").join(blocked, ["a", "b"], "left_anti").select("a", "b", "half", "k", "x0", "y0", "x1", "y1")
