"""Gaps along rows on an unbounded stream of plants, by keyed state, and windowed activity counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(events: DataFrame, at: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind, final once the watermark passes."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def running_gaps(plants: DataFrame, row: str, s: str, least: float) -> DataFrame:
    """row, s, gap for every plant least or more beyond the farthest seen before it in its row; state is one number a row."""
    kind = dict(plants.dtypes)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for v in sorted(float(x) for pdf in batches for x in pdf[s]):
            if last is not None and v - last >= least:
                out.append((key[0], v, v - last))
            last = v if last is None else max(last, v)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["row", "s", "gap"])

    return plants.select(row, s).groupBy(row).applyInPandasWithState(run, f"row {kind[row]}, s double, gap double", "last double", "append", GroupStateTimeout.NoTimeout)
