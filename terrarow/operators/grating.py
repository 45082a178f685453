"""Planted rows as gratings: how strongly a pixel's surroundings repeat at the rows' spacing, and in which direction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrarow.storage import stored

# Directions in degrees, row spacings and the width of the local contrast in metres.
ANGLES = tuple(range(0, 180, 10))
SPACINGS = (2.3, 2.7, 3.1)
CONTRAST_M = 12.0
SMOOTH = 5  #: pixels over which squared responses are averaged


def wave(spacing: float, degrees: float) -> np.ndarray:
    """A cosine across the direction under a round window, of mean 0 and length 1; spacing in pixels."""
    r = max(int(np.ceil(spacing * 2)), 3)
    y, x = np.mgrid[-r : r + 1, -r : r + 1].astype(float)
    t = np.deg2rad(degrees)
    k = np.cos(2 * np.pi * (x * np.cos(t) + y * np.sin(t)) / spacing) * np.exp(-(x * x + y * y) / (2 * (1.15 * spacing) ** 2))
    k -= k.mean()
    return k / (np.sqrt((k * k).sum()) + 1e-6)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Means over size by size pixels around each, with 0 beyond the edges."""
    h = size // 2
    s = np.pad(np.pad(a, h).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def _contrast(a: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Distance from the local mean in local deviations; 0 where invalid."""
    mean = box_mean(a, size)
    return np.where(valid, (a - mean) / np.sqrt(np.maximum(box_mean(a * a, size) - mean * mean, 1e-4)), 0)


def _energies(a: np.ndarray, valid: np.ndarray, gsd: float) -> np.ndarray:
    """For each direction the largest energy of the spacings."""
    waves = {(d, s): wave(s / gsd, d) for d in ANGLES for s in SPACINGS}
    reach = max(k.shape[0] for k in waves.values())
    shape = tuple(n + reach for n in a.shape)
    spectrum = np.fft.rfft2(a, shape)
    out = np.zeros((len(ANGLES), *a.shape))
    for (d, _), k in waves.items():
        h = k.shape[0] // 2
        response = np.fft.irfft2(spectrum * np.fft.rfft2(k, shape), shape)[h : h + a.shape[0], h : h + a.shape[1]]
        i = ANGLES.index(d)
        out[i] = np.maximum(out[i], box_mean(np.where(valid, response, 0) ** 2, SMOOTH))
    return out


def energy(cells: DataFrame, gsd: float, tile: int = 256) -> DataFrame:
    """x, y, peak, second (double), degrees (int) of each pixel: its strongest direction's energy, the next one's, the direction.

    cells: x, y, red, green, blue, one line per valid pixel of gsd metres; the brighter-green channel and luminance are
    tried, the stronger counts. Lines with nulls don't count, of repeated pixels the mean does. Pixels that aren't listed are 0 in
    all sums. Tiles go with a border as wide as all filters together, so results don't depend on tile; a task holds one tile.
    """
    size = max(9, int(round(CONTRAST_M / gsd)) | 1)
    edge = size // 2 + max(int(np.ceil(2 * max(SPACINGS) / gsd)), 3) + SMOOTH // 2
    tile = max(tile, 2 * edge)
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - edge) / tile), F.floor((F.col(c) + edge) / tile)))
    once = cells.select("x", "y", "red", "green", "blue").dropna().groupBy("x", "y").agg(*(F.avg(c).alias(c) for c in ("red", "green", "blue")))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part.x.to_numpy() - (int(part.tx.iloc[0]) * tile - edge), part.y.to_numpy() - (int(part.ty.iloc[0]) * tile - edge)
        valid = np.zeros((tile + 2 * edge,) * 2, bool)
        valid[y, x] = True
        red, green, blue = (part[c].to_numpy(float) for c in ("red", "green", "blue"))
        best = None
        for values in ((red + green + blue) / 3, 2 * green - red - blue):
            a = np.zeros(valid.shape)
            a[y, x] = values
            e = _energies(_contrast(a, valid, size), valid, gsd)
            best = e if best is None else np.maximum(best, e)
        own = (x >= edge) & (x < tile + edge) & (y >= edge) & (y < tile + edge)
        of = best[:, y[own], x[own]]
        order = np.sort(of, axis=0)
        return pd.DataFrame({"x": part.x[own], "y": part.y[own], "peak": order[-1], "second": order[-2], "degrees": np.array(ANGLES, np.int32)[of.argmax(0)]})

    kinds = dict(once.dtypes)
    return once.withColumn("tx", reach("x")).withColumn("ty", reach("y")).groupBy("tx", "ty").applyInPandas(one, f"x {kinds['x']}, y {kinds['y']}, peak double, second double, degrees int")


def scores(found: DataFrame, share: float = 0.9, steps: int = 4096) -> DataFrame:
    """x, y, degrees, score (0 to 3), peakiness: peaks by the value that share of them stay below, and over the next direction's.

    That value is read from counts of equal steps up to the largest peak (the end of the step in which it lies), so
    the driver gets at most steps lines whatever the number of pixels, and the same ones in every run.
    """
    found = stored(found, "energy")
    most = found.agg(F.max("peak").alias("m")).first().m or 0.0
    scale = 1.0
    if most > 0:
        counts = found.groupBy(F.least(F.floor(F.col("peak") / most * steps), F.lit(steps - 1)).alias("k")).count().orderBy("k").collect()
        want, passed = share * sum(r["count"] for r in counts), 0
        for r in counts:
            passed += r["count"]
            if passed >= want:
                scale = (r.k + 1) * most / steps
                break
    return found.select("x", "y", "degrees", F.least(F.col("peak") / (scale + 1e-6), F.lit(3.0)).alias("score"), (F.col("peak") / (F.col("second") + 1e-6)).alias("peakiness"))
