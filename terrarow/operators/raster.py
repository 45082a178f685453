"""Raster operators on cell tables (one line per pixel): windows, pyramids, regions, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def window_starts(size: int, window: int, step: int) -> Column:
    """Starts of windows every step; a last one is flush with the edge."""
    starts = list(range(0, max(1, size - window + 1), step))
    if starts[-1] + window < size:
        starts.append(size - window)
    return F.array(*(F.lit(s) for s in starts))


def pyramid(cells: DataFrame, x: str, y: str, values: list[str], levels: int) -> DataFrame:
    """z, x, y and the mean values of 2**z by 2**z cells, for z from 0 to levels, all from the finest cells."""
    z = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("z")
    scale = F.pow(F.lit(2.0), F.col("z"))
    at = lambda c: F.floor(F.col(c) / scale).cast("int")
    return cells.select("*", z).groupBy("z", at(x).alias("px"), at(y).alias("py")).agg(*(F.avg(v).alias(v) for v in values))


def any_hit(cells: DataFrame, x: str, y: str, factor: int, hit: Column, share: float) -> DataFrame:
    """Coarse cells of factor by factor, true where the share of hits is reached."""
    return cells.groupBy(F.floor(F.col(x) / factor).cast("int").alias("bx"), F.floor(F.col(y) / factor).cast("int").alias("by")).agg((F.avg(hit.cast("double")) >= share).alias("hit"))


def regions(cells: DataFrame, x: str, y: str, width: int, eight: bool = True) -> DataFrame:
    """Labels of connected cells: cells with the smallest y * width + x of their region."""
    own = cells.select(x, y).distinct().withColumn("id", F.col(y).cast("bigint") * width + F.col(x))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if eight else [])
    far = own.select(F.col("id").alias("b"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    near = own.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps))))
    edges = near.select(F.col("id").alias("a"), (F.col(x) + F.col("_s.dx")).alias("_x"), (F.col(y) + F.col("_s.dy")).alias("_y")).join(far, ["_x", "_y"]).select("a", "b")
    return own.join(components(edges), "id", "left").select(x, y, F.coalesce("label", "id").alias("region"))


def nearest_filled(cells: DataFrame, line: str, at: str, value: str) -> DataFrame:
    """Missing values taken from the nearer filled cell of the line, the left one if both are as near."""
    ahead = Window.partitionBy(line).orderBy(at)
    back = Window.partitionBy(line).orderBy(F.desc(at))
    place = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("p"), F.col(value).alias("v")))
    both = cells.withColumns({"_l": F.last(place, True).over(ahead), "_r": F.last(place, True).over(back)})
    left, right = F.col(at) - F.col("_l.p"), F.col("_r.p") - F.col(at)
    filled = F.when(F.col("_r").isNull() | (left <= right), F.col("_l.v")).otherwise(F.col("_r.v"))
    return both.withColumn("filled", F.coalesce(value, filled)).drop("_l", "_r")


def rasterised(boxes: DataFrame, size: int) -> DataFrame:
    """Each box (xtl, ytl, xbr, ybr) once for every cell cx, cy of size pixels whose centre it holds."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) + size // 2 - 1) / size).cast("int"), F.floor((F.col(hi) + size // 2 - 1) / size).cast("int") - 1)
    holds = lambda lo, hi: F.floor((F.col(hi) + size // 2 - 1) / size) > F.floor((F.col(lo) + size // 2 - 1) / size)
    return boxes.where(holds("xtl", "xbr") & holds("ytl", "ybr")).withColumn("cx", F.explode(span("xtl", "xbr"))).withColumn("cy", F.explode(span("ytl", "ybr")))


def with_bleed(cells: DataFrame, x: str, y: str, flag: str, mask: str = "mask") -> DataFrame:
    """x, y, mask: frame where flag holds, bleed where it holds for one of the eight cells around, else clear."""
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    near = cells.where(F.col(flag)).withColumn("_s", step).select((F.col(x) + F.col("_s.dx")).alias(x), (F.col(y) + F.col("_s.dy")).alias(y)).distinct().withColumn("_near", F.lit(True))
    return cells.join(near, [x, y], "left").select(x, y, F.when(F.col(flag), "frame").when(F.col("_near"), "bleed").otherwise("clear").alias(mask))


def chip_boxes(boxes: DataFrame, size: int, least: float) -> DataFrame:
    """Boxes clipped to the chips cx, cy of size pixels that they meet: centre x, y and w, h in chip units, where least of the area or more is left."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor((F.col(hi) - 1) / size).cast("int")))
    cut = boxes.withColumn("cx", span("xtl", "xbr")).withColumn("cy", span("ytl", "ybr"))
    lo = lambda c, k: F.greatest(F.col(c), F.col(k) * size)
    hi = lambda c, k: F.least(F.col(c), F.col(k) * size + size)
    cut = cut.withColumns({"_a": lo("xtl", "cx"), "_b": lo("ytl", "cy"), "_c": hi("xbr", "cx"), "_d": hi("ybr", "cy")})
    kept = cut.where((F.col("_c") - F.col("_a")) * (F.col("_d") - F.col("_b")) >= least * (F.col("xbr") - F.col("xtl")) * (F.col("ybr") - F.col("ytl")))
    return kept.withColumns({"x": (F.col("_a") + F.col("_c")) / 2 / size - F.col("cx"), "y": (F.col("_b") + F.col("_d")) / 2 / size - F.col("cy"), "w": (F.col("_c") - F.col("_a")) / size, "h": (F.col("_d") - F.col("_b")) / size}).drop("_a", "_b", "_c", "_d")
