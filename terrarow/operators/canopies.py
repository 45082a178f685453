"""Touching canopies taken apart: opening, exact distance transform, peaks, flood from the peaks.

Cells are canopy, x, y: one line per pixel of a canopy; canopies may be of any number and size. Null places don't count,
repeated lines count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrarow.storage import new_path, stored

from .graph import components

CELL = ["canopy", "x", "y"]
SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def _moved(cells: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """The cells once for each step (dx, dy), there."""
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps)))
    return cells.withColumn("_s", step).withColumns({"x": F.col("x") + F.col("_s.dx"), "y": F.col("y") + F.col("_s.dy")}).drop("_s")


def opened(cells: DataFrame) -> DataFrame:
    """Cells of the crosses of five that fit into the canopy: necks of one cell go."""
    once = cells.select(*CELL).dropna().distinct()
    beside = lambda at, by: (F.lag(at).over(by) == F.col(at) - 1) & (F.lead(at).over(by) == F.col(at) + 1)
    along, down = Window.partitionBy("canopy", "y").orderBy("x"), Window.partitionBy("canopy", "x").orderBy("y")
    core = once.withColumn("_a", beside("x", along)).withColumn("_b", beside("y", down)).where("_a and _b").select(*CELL)
    return _moved(core, [(0, 0), *SIDES]).distinct()


def heights(cells: DataFrame, columns: int = 64) -> DataFrame:
    """The cells with height2: the exact squared distance to the nearest cell outside their canopy.

    Two passes. Along lines windows give the distance to the ends of a cell's run. Down columns the least of that
    squared plus the squared way is taken within the column's run: outside it, its ends are nearer. The second pass
    streams whole columns of many canopies at a time; a canopy is dealt to tasks by so many columns.
    """
    line = Window.partitionBy("canopy", "y")
    runs = cells.select(*CELL).withColumn("_r", F.col("x") - F.row_number().over(line.orderBy("x")))
    run = Window.partitionBy("canopy", "y", "_r")
    wide = runs.withColumn("side", F.least(F.col("x") - F.min("x").over(run), F.max("x").over(run) - F.col("x")) + 1).drop("_r")
    wide = wide.withColumn("_k", F.floor(F.col("x") / columns))

    def down(part: pd.DataFrame) -> pd.DataFrame:
        canopy = part["canopy"].to_numpy()
        x, y, side = (part[c].to_numpy(np.int64) for c in ("x", "y", "side"))
        starts = np.concatenate([[True], (canopy[1:] != canopy[:-1]) | (np.diff(x) != 0) | (np.diff(y) != 1)])
        first = np.maximum.accumulate(np.where(starts, np.arange(len(y)), 0))
        ends = np.append(np.flatnonzero(starts)[1:], len(y))
        last = ends[np.cumsum(starts) - 1] - 1
        at = np.arange(len(y))
        best = np.minimum(np.minimum(at - first, last - at) + 1, side) ** 2
        for d in range(1, int(side.max())):
            if d * d >= best.max():
                break
            same = first[d:] == first[:-d]
            up = np.where(same, side[:-d] ** 2 + d * d, best[d:])
            low = np.where(same, side[d:] ** 2 + d * d, best[:-d])
            best[d:] = np.minimum(best[d:], up)
            best[:-d] = np.minimum(best[:-d], low)
        return part.assign(height2=best)[[*CELL, "height2"]]

    def run(batches):
        held = None
        for part in batches:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            last = part.iloc[-1:]
            # the last column may go on in the next batch
            own = ((part["canopy"] == last["canopy"].iloc[0]) & (part["x"] == last["x"].iloc[0])).to_numpy()
            if not own.all():
                yield down(part[~own].reset_index(drop=True))
            held = part[own].reset_index(drop=True)
        if held is not None:
            yield down(held)

    kinds = dict(cells.dtypes)
    dealt = wide.repartition("canopy", "_k").sortWithinPartitions("canopy", "x", "y").select(*CELL, "side")
    return dealt.mapInPandas(run, f"canopy {kinds['canopy']}, x {kinds['x']}, y {kinds['y']}, height2 long")


def peaks(high: DataFrame, reach: int, least: float) -> DataFrame:
    """canopy, x, y, marker: cells higher than least that none within reach columns and lines surpasses.

    Peaks that touch by sides or corners are one marker: canopy and place of the first in scan order.
    """
    near = lambda a, b: Window.partitionBy("canopy", a).orderBy(b).rangeBetween(-reach, reach)
    top = high.withColumn("_m", F.max("height2").over(near("y", "x"))).withColumn("_m", F.max("_m").over(near("x", "y")))
    own = F.struct("canopy", "y", "x")
    likely = stored(top.where((F.col("height2") == F.col("_m")) & (F.col("height2") > least * least)).select(*CELL, own.alias("id"), F.col("height2").alias("_h")), "likely-peaks")
    # a line is seen from a column where the column has a cell on it: the few that are left look at the whole square
    square = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    higher = _moved(likely, square).join(high.hint("merge"), CELL).where("height2 > _h").select("id").distinct()
    found = stored(likely.join(higher.hint("merge"), "id", "left_anti").select(*CELL, "id"), "peaks")
    ahead = _moved(found.withColumnRenamed("id", "a"), [(1, 0), (-1, 1), (0, 1), (1, 1)])
    linked = components(ahead.join(found.withColumnRenamed("id", "b").hint("merge"), CELL).select("a", "b"))
    return found.join(linked, "id", "left").select(*CELL, F.coalesce("label", "id").alias("marker"))


def flooded(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """canopy, x, y, marker: each cell with the marker that reaches it in the fewest steps by sides, the first in order if several do.

    Seeds have one marker per cell. Each round goes one step on from the newest cells; as those of a round touch only
    cells of the round before, of their own and of the next, a round looks at two earlier ones, not at all. There are
    as many rounds as the longest of these ways has steps. Cells that no marker reaches are left out. Merge joins by hint, as
    stored cells are small files of many rows.
    """
    spark = cells.sparkSession
    path = new_path(spark, "flood")

    def level(k: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/level={k}")
        return spark.read.schema(df.schema).parquet(f"{path}/level={k}")

    ground = stored(cells.select(*CELL), "ground")
    newest = level(0, seeds.select(*CELL, "marker"))
    older, k = newest.limit(0), 0
    while not newest.isEmpty():
        k += 1
        step = _moved(newest, SIDES).groupBy(*CELL).agg(F.min("marker").alias("marker"))
        fresh = step.join(newest.select(*CELL).union(older.select(*CELL)).hint("merge"), CELL, "left_anti").join(ground.hint("merge"), CELL, "left_semi")
        newest, older = level(k, fresh), newest
    return spark.read.schema(newest.schema).parquet(*(f"{path}/level={i}" for i in range(k + 1)))


#: A canopy of up to so many cells each way is taken apart as a whole: squares of its places then fit 16 bits.
WIDE = 150
_NONE = np.int16(32767)
#: Cells of the frames that are worked on at once; they stay in a core's cache.
_AT_ONCE = 1 << 18


def _shifts(a: np.ndarray):
    """The four neighbours by sides of the cells within the frames' margin of one."""
    return a[:, 1:-1, :-2], a[:, 1:-1, 2:], a[:, :-2, 1:-1], a[:, 2:, 1:-1]


def _slid(a: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The largest within reach along an axis; what lies outside is 0."""
    margin = [(0, 0)] * 3
    margin[axis] = (reach, reach)
    a, width = np.pad(a, margin), 1
    part = lambda lo, hi: (slice(None),) * axis + (slice(lo, hi),)
    while width < 2 * reach + 1:
        step = min(width, 2 * reach + 1 - width)
        a = np.maximum(a[part(0, a.shape[axis] - step)], a[part(step, None)])
        width += step
    return a


def _stack_heights(core: np.ndarray) -> np.ndarray:
    """heights of stacked frames with a margin of one."""
    n, h, w = core.shape
    side = np.zeros((n, h, w), dtype=np.int16)
    for i in range(1, w):
        side[:, :, i] = (side[:, :, i - 1] + 1) * core[:, :, i]
    back = np.zeros((n, h), dtype=np.int16)
    for i in range(w - 2, -1, -1):
        back = (back + 1) * core[:, :, i]
        np.minimum(side[:, :, i], back, out=side[:, :, i])
    side *= side
    best = side.copy()
    for d in range(1, h):
        if d * d >= best.max():
            break
        np.minimum(best[:, d:], side[:, :-d] + np.int16(d * d), out=best[:, d:])
        np.minimum(best[:, :-d], side[:, d:] + np.int16(d * d), out=best[:, :-d])
    return best


def _stack_markers(peak: np.ndarray) -> np.ndarray:
    """The place in its frame of the first cell of each group of touching peaks, in the order of np.flatnonzero(peak)."""
    n, h, w = peak.shape
    at = np.flatnonzero(peak)
    number = np.full(peak.size, -1, dtype=np.int32)
    number[at] = np.arange(len(at))
    ends = [(a[b >= 0], b[b >= 0]) for a, b in ((np.arange(len(at)), number[at + step]) for step in (1, w - 1, w, w + 1))]
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    label = np.arange(len(at))
    while True:
        was = label.copy()
        np.minimum.at(label, a, was[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == was).all():
            return (at[label] % (h * w)).astype(np.int16)


def _stack_parts(mask: np.ndarray, whole: np.ndarray, reach: int, least: float) -> np.ndarray:
    """Stacked canopies (frames with a margin of one) taken apart: the place in its frame of the cell that names a cell's part.

    whole: canopies that stay as they are. Cells that are in no part are _NONE.
    """
    n, h, w = mask.shape
    core = np.zeros_like(mask)
    inner = core[:, 1:-1, 1:-1]
    np.copyto(inner, mask[:, 1:-1, 1:-1])
    for side in _shifts(mask):
        inner &= side
    opened_ = core.copy()
    for side in _shifts(opened_):
        side |= inner
    high = _stack_heights(opened_)
    peak = (high == _slid(_slid(high, reach, 2), reach, 1)) & (high.astype(np.int32) > least * least)
    peak[whole] = False
    marker = _stack_markers(peak)
    of = np.flatnonzero(peak) // (h * w)
    lo, hi = np.full(n, _NONE), np.full(n, np.int16(-1))
    np.minimum.at(lo, of, marker)
    np.maximum.at(hi, of, marker)
    several = (hi >= 0) & (lo != hi)
    out = np.full((n, h, w), _NONE)
    kept = np.where(whole[:, None, None], mask, opened_)
    first = kept.reshape(n, -1).argmax(axis=1).astype(np.int16)
    np.copyto(out, first[:, None, None], where=kept & ~several[:, None, None])
    if several.any():
        rows = np.flatnonzero(several)
        free = opened_[rows]
        # discs of radius 2, for which a margin of one is too small
        wide = np.full((len(rows), h + 4, w + 4), np.int16(-1))
        own = np.searchsorted(rows, of)
        take = several[of]
        place = np.flatnonzero(peak)[take] % (h * w)
        i, y, x, m = own[take], place // w, place % w, marker[take]
        order = np.argsort(m, kind="stable")  # of equal cells the later marker is written last
        i, y, x, m = i[order], y[order], x[order], m[order]
        disc = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 5]
        for a, b in disc:
            np.maximum.at(wide, (i, y + 2 + b, x + 2 + a), m)
        seed = wide[:, 2:-2, 2:-2]
        label = np.where(free & (seed >= 0), seed, _NONE)
        free = free[:, 1:-1, 1:-1]
        while True:
            a, b, c, d = _shifts(label)
            near = np.minimum(np.minimum(a, b), np.minimum(c, d))
            own_ = label[:, 1:-1, 1:-1]
            new = free & (own_ == _NONE) & (near != _NONE)
            if not new.any():
                break
            np.copyto(own_, near, where=new)
        out[rows] = label
    return out


def _whole_canopies(batches: Iterator[pa.RecordBatch], schema: pa.Schema, reach: int, least: float, least_cells: int, most_cells: int | None, compact: float, slim: float) -> Iterator[pa.RecordBatch]:
    """Parts of canopies whose boxes (canopy, x, y, x1, y1) come one canopy after the other, as schema."""
    place = ("x", "y", "x1", "y1")

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        run = table["canopy"].combine_chunks()
        starts = np.flatnonzero(np.append(True, pa.compute.not_equal(run[1:], run[:-1]).to_numpy(zero_copy_only=False)))
        x, y, x1, y1 = (table[c].to_numpy().astype(np.int64) for c in place)
        x0, y0 = np.minimum.reduceat(x, starts), np.minimum.reduceat(y, starts)
        w, h = np.maximum.reduceat(x1, starts) - x0, np.maximum.reduceat(y1, starts) - y0
        whole = (w * w + h * h < compact * compact) & (np.maximum(w, h) < slim * np.minimum(w, h))
        ends = np.append(starts[1:], len(x))
        # frames of nearly one size are stacked
        size = np.lexsort(((w + 8) // 8, (h + 8) // 8))
        kind = np.stack([(h + 8) // 8, (w + 8) // 8])[:, size]
        for group in np.split(size, np.flatnonzero((np.diff(kind, axis=1) != 0).any(axis=0)) + 1):
            fh, fw = int(h[group].max()) + 3, int(w[group].max()) + 3
            count = max(1, _AT_ONCE // (fh * fw))
            for own in (group[i : i + count] for i in range(0, len(group), count)):
                mask = np.zeros((len(own), fh, fw), dtype=bool)
                for i, k in enumerate(own.tolist()):
                    s = slice(starts[k], ends[k])
                    left, top = x0[k] - 1, y0[k] - 1
                    if (x1[s] == x[s]).all() and (y1[s] == y[s]).all():
                        mask[i, y[s] - top, x[s] - left] = True
                        continue
                    for a, b, c, d in zip((x[s] - left).tolist(), (y[s] - top).tolist(), (x1[s] - left + 1).tolist(), (y1[s] - top + 1).tolist(), strict=True):
                        mask[i, b:d, a:c] = True
                parts = _stack_parts(mask, whole[own], reach, least)
                at = np.flatnonzero(parts != _NONE)
                i, part = at // (fh * fw), parts.ravel()[at]
                if least_cells > 1 or most_cells is not None:
                    _, inverse, counts = np.unique(i * 32768 + part, return_inverse=True, return_counts=True)
                    keep = counts[inverse] >= least_cells
                    if most_cells is not None:
                        keep &= counts[inverse] <= most_cells
                    at, i, part = at[keep], i[keep], part[keep]
                name = run.take(pa.array(starts[own[i]]))
                top, left = y0[own[i]] - 1, x0[own[i]] - 1
                cell = lambda v, c: pa.array(v).cast(schema.field(c).type)
                named = pa.StructArray.from_arrays([name, cell(top + part // fw, "y"), cell(left + part % fw, "x")], names=["canopy", "y", "x"])
                yield pa.RecordBatch.from_arrays([name, cell(left + at % fw, "x"), cell(top + at % (fh * fw) // fw, "y"), named], schema=pa.schema([("canopy", name.type), schema.field("x"), schema.field("y"), ("part", named.type)]))

    held = None
    for batch in batches:
        batch = pa.Table.from_batches([batch])
        held = batch if held is None else pa.concat_tables([held, batch])
        if not held.num_rows:
            continue
        names = held["canopy"]
        last = pa.compute.index(names, names[-1]).as_py()
        if last:
            yield from made(held.slice(0, last).combine_chunks())
            held = held.slice(last)
        if held.num_rows > 100_000:
            held = held.combine_chunks().group_by(["canopy", *place]).aggregate([]).select(["canopy", *place])  # repeated lines count once
    if held is not None and held.num_rows:
        yield from made(held.combine_chunks())


def parted(cells: DataFrame, reach: int, least: float, least_cells: int = 0, most_cells: int | None = None, compact: float = 0, slim: float = 1.8, wide: int = WIDE) -> DataFrame:
    """canopy, x, y, part (struct of canopy, y, x): canopies parted at their necks.

    Canopies whose box has a diagonal under compact and sides within slim of each other stay as they are. Others are
    opened and flooded from their peaks (discs of radius 2 around them; where two meet, the later marker holds); those with
    one marker or none stay whole. A whole canopy is named by its first cell. Parts with fewer than least_cells or more
    than most_cells go. A part may be of several pieces.

    With columns x1, y1 a line of cells stands for all cells from x, y to there. Canopies of up to wide cells each way are read
    one after another out of sorted partitions and taken apart as a whole; larger ones go by joins and rounds of their cells.
    """
    kinds = dict(cells.dtypes)
    boxed = cells.select(*CELL, *(c if c in kinds else F.col(c[0]).alias(c) for c in ("x1", "y1"))).dropna().where("x1 >= x AND y1 >= y")
    extent = lambda c: F.max(f"{c}1") - F.min(c)
    large = stored(boxed.groupBy("canopy").agg(F.greatest(extent("x"), extent("y")).alias("_e")).where(F.col("_e") >= wide).select("canopy"), "large-canopies")
    tiled = not large.isEmpty()
    near = boxed.join(large.hint("merge"), "canopy", "left_anti") if tiled else boxed
    schema = f"canopy {kinds['canopy']}, x {kinds['x']}, y {kinds['y']}, part struct<canopy: {kinds['canopy']}, y: {kinds['y']}, x: {kinds['x']}>"
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8()}
    places = pa.schema([(c, arrow[kinds[c]]) for c in ("x", "y")])
    run = lambda batches: _whole_canopies(batches, places, reach, least, least_cells, most_cells, compact, slim)
    found = near.repartition("canopy").sortWithinPartitions("canopy").mapInArrow(run, schema)
    if not tiled:
        return found
    span = lambda c: F.explode(F.sequence(c, f"{c}1"))
    far = boxed.join(large.hint("merge"), "canopy", "left_semi").withColumn("x", span("x")).withColumn("y", span("y"))
    return found.union(_parted_by_cells(far.select(*CELL), reach, least, least_cells, most_cells, compact, slim))


def _parted_by_cells(cells: DataFrame, reach: int, least: float, least_cells: int, most_cells: int | None, compact: float, slim: float) -> DataFrame:
    """parted by joins and rounds of cells."""
    once = stored(cells.select(*CELL).dropna().distinct(), "canopies")
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    small = once.groupBy("canopy").agg(((w * w + h * h < compact * compact) & (F.greatest(w, h) < slim * F.least(w, h))).alias("small"))
    small = small.where("small").select("canopy")
    core = stored(opened(once.join(small, "canopy", "left_anti")), "opened")
    marks = stored(peaks(stored(heights(core), "heights"), reach, least), "marks")
    several = stored(marks.groupBy("canopy").agg(F.min("marker").alias("_a"), F.max("marker").alias("_b")).where("_a != _b").select("canopy"), "several")
    disc = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 5]
    open_ = core.join(several, "canopy", "left_semi")
    seeds = _moved(marks.join(several, "canopy", "left_semi"), disc).groupBy(*CELL).agg(F.max("marker").alias("marker")).join(open_.hint("merge"), CELL, "left_semi")
    whole = once.join(small, "canopy", "left_semi").union(core.join(several, "canopy", "left_anti"))
    first = Window.partitionBy("canopy")
    named = whole.withColumn("part", F.min(F.struct("canopy", "y", "x")).over(first))
    parts = stored(flooded(open_, seeds).select(*CELL, F.col("marker").alias("part")).union(named.select(*CELL, "part")), "parts")
    size = F.col("count") >= least_cells
    if most_cells is not None:
        size &= F.col("count") <= most_cells
    return parts.join(parts.groupBy("part").count().where(size).select("part"), "part").select(*CELL, "part")
