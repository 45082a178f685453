"""Graph operators as DataFrame rounds; nothing but a stop test comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrarow.storage import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each node's component. edges: a, b, long or binary; nodes without edges are not listed.

    Each round takes the smallest label among a node's neighbours, then jumps to its label's label; rounds grow with
    the logarithm of the longest path. Only labels move; a node with any number of edges costs one row per task, as
    minima are aggregated before the shuffle. Merge joins by hint, as stored labels are small files of many rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = last = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("m"))
        met = labels.join(near.withColumnRenamed("a", "id").hint("merge"), "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = stored(met.join(far.hint("merge"), "label").select("id", "was", F.least("label", "further").alias("label")), "labels")
        drop(last)
        labels, last = new.select("id", "label"), new
        if not new.where("label != was").limit(1).count():
            drop(both)
            return labels


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """src, id, dist: smallest sums of w from each source, by relaxing the frontier until nothing improves.

    edges: a, b, w (used both ways); sources: id; w is 0 or more. There are as many rounds as the
    longest of these paths has edges, and one.
    """
    both = stored(edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    known = stored(sources.select(F.col("id").alias("src"), "id", F.lit(0).cast("bigint").alias("dist"), F.lit(True).alias("new")), "paths")
    while True:
        step = known.where("new").join(both, known.id == both.a).select("src", F.col("b").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        merged = known.select("src", "id", "dist", F.lit(0).alias("step")).union(step.select("src", "id", "dist", F.lit(1).alias("step")))
        best = merged.groupBy("src", "id").agg(F.min("dist").alias("dist"), F.min(F.when(F.col("step") == 0, F.col("dist"))).alias("was"))
        known = stored(best.select("src", "id", "dist", (F.col("was").isNull() | (F.col("dist") < F.col("was"))).alias("new")), "paths")
        if not known.where("new").limit(1).count():
            return known.select("src", "id", "dist")
