"""Numbers of rows within groups, in a total order, without gathering a group.

Rows are range-partitioned and sorted by (group, order, place in the source), so a group of any size spreads over
partitions and equal rows do too. Each partition's rows of a group are counted; a window over those counts, one row for
each partition and group, gives every partition the number at which it goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def following(counts: DataFrame, group: list[str], part: str, n: str) -> DataFrame:
    """counts (a row for each part and group) with before: the rows of the group in smaller parts, and of: in all."""
    w = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum(n).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).withColumn("of", F.sum(n).over(w))


def numbered(rows: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """rows with nth, from 0 within its group in the order given, and of, the group's rows; the sorted rows are stored.

    Group columns must not be null. rows is read twice (once to find the ranges), so it should be a stored table.
    """
    keys = [*group, *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    # partition in the upper bits, place in it in the lower ones
    placed = stored(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    heads = following(counts, group, "_part", "_n").select("_part", *group, (F.col("before") - F.col("_first")).alias("_shift"), "of")
    return placed.join(heads, ["_part", *group]).withColumn("nth", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
