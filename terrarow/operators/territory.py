"""Territories out of a vine mask: growth that stops at barriers, connected parts, filled holes.

Cells are one line per valid pixel. Regions are found on runs of cells, not on the cells: a run is a stretch of one
line, and links between runs of neighbouring lines are what the graph rounds move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrarow.storage import stored

from .graph import components

LINE = 1 << 32  #: cell number = y * LINE + x, in scan order while x is within 31 bits
BUCKET = 1024  #: columns of a bucket in the join of runs


def number(x: Column, y: Column) -> Column:
    return y.cast("bigint") * LINE + x


def _grow(mask: np.ndarray) -> np.ndarray:
    """The mask and the eight cells around each of its cells."""
    wide = mask.copy()
    wide[:, 1:] |= mask[:, :-1]
    wide[:, :-1] |= mask[:, 1:]
    out = wide.copy()
    out[1:] |= wide[:-1]
    out[:-1] |= wide[1:]
    return out


def grown(cells: DataFrame, steps: int, tile: int = 256) -> DataFrame:
    """x, y, vine, grown of the free cells: vine spread by steps cells in eight directions, through free cells only.

    cells: x, y, vine, free. A cell that is listed twice is vine if one line says so and free if all do; null flags are
    false. Tiles go with a border of steps cells, beyond which nothing can reach them, so each is grown by itself; a
    task holds one tile.
    """
    size = max(tile, 2 * steps)
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - steps) / size), F.floor((F.col(c) + steps) / size)))
    once = cells.groupBy("x", "y").agg(F.max(F.coalesce("vine", F.lit(False))).alias("vine"), F.min(F.coalesce("free", F.lit(False))).alias("free")).where("free and x is not null and y is not null")
    spread = once.withColumn("tx", reach("x")).withColumn("ty", reach("y"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(part.tx.iloc[0]) * size - steps, int(part.ty.iloc[0]) * size - steps
        x, y = part.x.to_numpy() - x0, part.y.to_numpy() - y0
        free = np.zeros((size + 2 * steps, size + 2 * steps), bool)
        mask = free.copy()
        free[y, x] = True
        mask[y, x] = part.vine.to_numpy()
        for _ in range(steps):
            mask = _grow(mask) & free
        own = (x >= steps) & (x < size + steps) & (y >= steps) & (y < size + steps)
        return pd.DataFrame({"x": part.x[own], "y": part.y[own], "vine": part.vine[own], "grown": mask[y, x][own]})

    kinds = dict(once.dtypes)
    return spread.groupBy("tx", "ty").applyInPandas(one, f"x {kinds['x']}, y {kinds['y']}, vine boolean, grown boolean")


def touching(runs: DataFrame, reach: int) -> DataFrame:
    """a, b: runs (id, y, x0, x1) of lines one below the other that share a column, or come within reach columns."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BUCKET), F.floor(F.col(hi) / BUCKET)))
    up = runs.select(F.col("id").alias("a"), (F.col("y") + 1).alias("y"), (F.col("x0") - reach).alias("a0"), (F.col("x1") + reach).alias("a1")).withColumn("k", spread("a0", "a1"))
    low = runs.select(F.col("id").alias("b"), "y", "x0", "x1").withColumn("k", spread("x0", "x1"))
    first = F.col("k") == F.floor(F.greatest("a0", "x0") / BUCKET)  # a pair counts in the bucket where it begins
    return up.join(low, ["y", "k"]).where(first & (F.col("a0") <= F.col("x1")) & (F.col("x0") <= F.col("a1"))).select("a", "b")


def labelled(runs: DataFrame, reach: int) -> DataFrame:
    """The runs with label: the smallest id of the runs that they are connected with."""
    return runs.join(components(touching(runs, reach)).withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn("label", F.coalesce("label", "id")).drop("_id")


def ancestors(parents: DataFrame) -> DataFrame:
    """node, over: everything above each node of a forest (node, over), by doubled steps; depth is bounded by the raster, not by a limit."""
    known = stored(parents, "above")
    n = known.count()
    while True:
        further = known.alias("k").join(known.select(F.col("node").alias("_n"), F.col("over").alias("_o")), F.col("k.over") == F.col("_n")).select("k.node", F.col("_o").alias("over"))
        known = stored(known.union(further).distinct(), "above")
        was, n = n, known.count()
        if was == n:
            return known


def territories(cells: DataFrame, steps: int, least_vine: int, least_area: int, tile: int = 256) -> DataFrame:
    """x, y, territory of the free cells in a territory, named by the number of the first cell of its grown mask.

    Vine grows by steps cells and makes parts of cells that touch by sides or corners. A part with least_vine vine cells
    whose filled shape has least_area free cells is a territory; it takes the free cells of its holes too, but for
    territories inside, which stay their own. Holes are what no way by sides leads out of. No cells, no rows.

    A part lies in one hole and a hole in one part: the run before a part's or hole's first cell belongs to what is
    around it. So nesting is a forest, and holes need no pass over the ground outside.
    """
    line = Window.partitionBy("y").orderBy("x")
    before = F.last(F.when(F.col("grown"), F.col("x")), True)
    marked = grown(cells, steps, tile).withColumn("_was", before.over(line.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("grown") & (F.col("_was").isNull() | (F.col("_was") < F.col("x") - 1))
    marked = marked.withColumn("_from", F.last(F.when(begins, F.col("x")), True).over(line))
    ground = stored(marked.select("x", "y", "vine", "grown", F.when(F.col("grown"), number(F.col("_from"), F.col("y"))).otherwise(number(F.col("_was") + 1, F.col("y"))).alias("run")), "ground")

    runs = ground.where("grown").groupBy(F.col("run").alias("id"), "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum(F.col("vine").cast("bigint")).alias("vine"))
    runs = stored(labelled(stored(runs, "runs"), 1), "runs")
    gaps = stored(_gaps(runs), "gaps")
    gaps = stored(labelled(gaps, 0), "gaps")
    loose = ground.where("not grown and run is not null").groupBy(F.col("run").alias("id")).agg(F.count("*").alias("free"))
    part_of = runs.select(F.col("id").alias("left"), F.col("label").alias("around"))
    holes = gaps.join(loose, "id", "left").groupBy(F.col("label").alias("hole")).agg(F.max("open").alias("open"), F.min_by("left", "id").alias("left"), F.sum(F.coalesce("free", F.lit(0))).alias("free"))
    holes = stored(holes.where("not open").join(part_of, "left").select("hole", "around", "free"), "holes")

    parts = runs.groupBy(F.col("label").alias("node")).agg(F.sum("vine").alias("vine"), F.sum(F.col("x1") - F.col("x0") + 1).alias("own"))
    inside = holes.groupBy(F.col("around").alias("node")).agg(F.sum("free").alias("inside"))
    parts = stored(parts.join(inside, "node", "left").select("node", "vine", (F.col("own") + F.coalesce("inside", F.lit(0))).alias("area")), "parts")
    above = gaps.select(F.col("right").alias("node"), F.col("label").alias("hole")).join(holes, "hole").join(parts.select("node"), "node", "left_semi").select("node", F.col("around").alias("over"))
    nested = ancestors(above)
    deeper = nested.join(parts.select("node", "area"), "node").groupBy(F.col("over").alias("node")).agg(F.sum("area").alias("deeper"))
    kept = parts.join(deeper, "node", "left").where((F.col("vine") >= least_vine) & (F.col("area") + F.coalesce("deeper", F.lit(0)) >= least_area)).select(F.col("node").alias("over"))
    chosen = stored(nested.union(parts.select("node", F.col("node").alias("over"))).join(kept, "over").groupBy("node").agg(F.max("over").alias("territory")), "chosen")

    of_run = runs.select(F.col("id").alias("run"), F.lit(True).alias("grown"), F.col("label").alias("node"))
    of_gap = gaps.join(holes, gaps.label == holes.hole).select(F.col("id").alias("run"), F.lit(False).alias("grown"), F.col("around").alias("node"))
    return ground.join(of_run.union(of_gap).join(chosen, "node"), ["run", "grown"]).select("x", "y", "territory")


def _gaps(runs: DataFrame) -> DataFrame:
    """id, y, x0, x1, left, right, open: what lies between two runs of a line; open where the line above or below lets out by a side."""
    line = Window.partitionBy("y").orderBy("x0")
    gaps = runs.select("y", F.col("id").alias("left"), (F.col("x1") + 1).alias("x0"), (F.lead("x0").over(line) - 1).alias("x1"), F.lead("id").over(line).alias("right")).where("right is not null")
    ends = runs.groupBy("y").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    for d in (-1, 1):
        near = ends.select((F.col("y") - d).alias("y"), F.col("lo").alias(f"_lo{d + 1}"), F.col("hi").alias(f"_hi{d + 1}"))
        gaps = gaps.join(near, "y", "left")
    lets_out = lambda k: F.col(f"_lo{k}").isNull() | (F.col("x0") < F.col(f"_lo{k}")) | (F.col("x1") > F.col(f"_hi{k}"))
    return gaps.select(number(F.col("x0"), F.col("y")).alias("id"), "y", "x0", "x1", "left", "right", (lets_out(0) | lets_out(2)).alias("open"))


def north_west_order(territories: DataFrame) -> DataFrame:
    """territory, cells, place: numbered by the mean line, then the mean column of the cells (lines count southward).

    One line per territory is sorted; cells are summed before. Sums are integers, so places don't hang on their order.
    """
    sums = territories.groupBy("territory").agg(F.count("*").alias("cells"), F.sum(F.col("y").cast("bigint")).alias("_y"), F.sum(F.col("x").cast("bigint")).alias("_x"))
    by = Window.orderBy(F.col("_y") / F.col("cells"), F.col("_x") / F.col("cells"), "territory")
    return sums.select("territory", "cells", F.row_number().over(by).cast("bigint").alias("place"))
