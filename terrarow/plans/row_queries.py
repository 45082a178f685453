"""Ordered operators and measures over field rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrarow.functions import grid, text
from terrarow.operators import rows

from .base import query, view

_LAG = "s_cm - lag(s_cm) OVER (PARTITION BY block_no, row_no ORDER BY s_cm, l_orderkey, l_linenumber)"
_ROWS = f"o AS (SELECT block_no, row_no, s_cm, t_cm, l_orderkey, l_linenumber, {_LAG} AS d FROM vines), r AS (SELECT block_no, row_no, count(*) AS n, max(s_cm) - min(s_cm) AS len, coalesce(max(d), 0) AS top, count(*) FILTER (d >= 500) AS gaps, avg(t_cm) AS t, min(s_cm) AS s FROM o GROUP BY ALL)"


def row_stats(vines):
    """One line per row: n vines, len, top gap, gaps, mean t, first s."""
    gapped = rows.with_gaps(vines, ["block_no", "row_no"], "s_cm", ["l_orderkey", "l_linenumber"], "d")
    return gapped.groupBy("block_no", "row_no").agg(F.count("*").alias("n"), (F.max("s_cm") - F.min("s_cm")).alias("len"), F.coalesce(F.max("d"), F.lit(0)).alias("top"), F.count_if(F.col("d") >= 500).alias("gaps"), F.avg("t_cm").alias("t"), F.min("s_cm").alias("s"))


@query(f"""WITH {_ROWS} SELECT CASE WHEN grouping(block_no) = 1 THEN 'total' WHEN grouping(row_no) = 1 THEN 'block' ELSE 'row' END AS level, block_no, row_no, count(*) AS row_count,
 CAST(sum(len) AS BIGINT) AS length_cm, CAST(sum(gaps) AS BIGINT) AS gap_count, max(top) AS max_gap_cm, count(*) FILTER (gaps > 0) AS disrupted_rows, CAST(sum(n) AS BIGINT) AS vine_count
 FROM r GROUP BY GROUPING SETS ((block_no, row_no), (block_no), ())""")
def gap_report(spark, sf_dir):
    return rows.gap_report(view(spark, sf_dir, "vines"))


@query(f"WITH {_ROWS} SELECT 'T' || lpad(CAST(row_number() OVER (ORDER BY block_no, row_no, s_cm, l_orderkey, l_linenumber) AS VARCHAR), 6, '0') AS target_id, block_no, row_no, d AS gap_cm, (2 * s_cm - d) / 2.0 AS mid_cm FROM o WHERE d >= 500")
def gap_targets(spark, sf_dir):
    return rows.gap_targets(view(spark, sf_dir, "vines"))


@query(f"WITH o AS (SELECT *, {_LAG} AS d FROM vines), k AS (SELECT *, sum(CASE WHEN d >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY block_no, row_no ORDER BY s_cm, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS cluster FROM o) SELECT block_no, row_no, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(s_cm) AS first_cm, max(s_cm) AS last_cm FROM k GROUP BY ALL")
def gap_clusters(spark, sf_dir):
    got = rows.gap_clusters(view(spark, sf_dir, "vines"), ["block_no", "row_no"], "s_cm", 300, ["l_orderkey", "l_linenumber"])
    return got.groupBy("block_no", "row_no", "cluster").agg(F.count("*").alias("n"), F.min("s_cm").alias("first_cm"), F.max("s_cm").alias("last_cm"))


@query(f"WITH {_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY round(t, 1), s, row_no) AS i, count(*) OVER (PARTITION BY block_no) AS nb FROM r) SELECT block_no, row_no, 'V' || lpad(CAST(block_no AS VARCHAR), 2, '0') || '-R' || lpad(CAST(i AS VARCHAR), CASE WHEN nb >= 100 THEN 3 ELSE 2 END, '0') AS row_id FROM k")
def row_numbering(spark, sf_dir):
    got = rows.numbered_rows(row_stats(view(spark, sf_dir, "vines")), "block_no", [F.round("t", 1), F.col("s"), F.col("row_no")])
    return got.select("block_no", "row_no", text.row_name(text.block_name(F.col("block_no")), F.col("n"), F.col("in_block")).alias("row_id"))


@query(f"WITH {_ROWS}, b AS (SELECT block_no, count(*) * 1000 AS canopy FROM vines GROUP BY 1) SELECT r.block_no, row_no, round(canopy * CASE WHEN sum(len) OVER (PARTITION BY r.block_no) > 0 THEN len / sum(len) OVER (PARTITION BY r.block_no) ELSE 1.0 / count(*) OVER (PARTITION BY r.block_no) END, 4) AS canopy_share FROM r JOIN b USING (block_no)")
def proportional_allocation(spark, sf_dir):
    vines = view(spark, sf_dir, "vines")
    blocks = vines.groupBy("block_no").agg((F.count("*") * 1000).alias("canopy"))
    return rows.shared_by_length(row_stats(vines).join(blocks, "block_no"), "block_no", "len", {"canopy": "canopy_share"}).select("block_no", "row_no", "canopy_share")


@query(f"WITH {_ROWS}, x AS (SELECT block_no, row_no, round(len / 100.0, 1) AS m FROM r) SELECT block_no, round(sum(m), 1) AS length_m, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT NULL, round(sum(m), 1), count(*) FROM x")
def rounded_totals(spark, sf_dir):
    per_row = row_stats(view(spark, sf_dir, "vines")).select("block_no", F.round(F.col("len") / 100, 1).alias("m"))
    return per_row.groupingSets([["block_no"], []], "block_no").agg(F.round(F.sum("m"), 1).alias("length_m"), F.count("*").alias("n"))


@query("SELECT block_no, max_by(row_no, s_cm * 1000000000 + l_orderkey * 10 + l_linenumber) AS last_row, min_by(row_no, s_cm * 1000000000 + l_orderkey * 10 + l_linenumber) AS first_row, max(CASE WHEN row_no = 7 THEN 1 ELSE 0 END) = 1 AS any_seven FROM vines GROUP BY 1")
def first_last_seen(spark, sf_dir):
    order = F.struct("s_cm", "l_orderkey", "l_linenumber")
    return view(spark, sf_dir, "vines").groupBy("block_no").agg(F.max_by("row_no", order).alias("last_row"), F.min_by("row_no", order).alias("first_row"), F.bool_or(F.col("row_no") == 7).alias("any_seven"))


@query("WITH v AS (SELECT r, block_id, sum(len_cm) AS w FROM segments GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY w DESC, block_id) AS i FROM v) SELECT r, block_id AS winner, CAST(w AS BIGINT) AS weight FROM k WHERE i = 1")
def weighted_vote(spark, sf_dir):
    return rows.majority(view(spark, sf_dir, "segments"), ["r"], "block_id", F.col("len_cm"))


@query("WITH v AS (SELECT c, block_id, count(*) AS w FROM segments GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w DESC, block_id) AS i FROM v) SELECT c, block_id AS winner, w AS weight FROM k WHERE i = 1")
def majority_vote(spark, sf_dir):
    return rows.majority(view(spark, sf_dir, "segments"), ["c"], "block_id")


@query("SELECT block_no, round(quantile_cont(s_cm, 0.25), 2) AS p25, round(median(s_cm), 2) AS p50, round(quantile_cont(s_cm, 0.75), 2) AS p75, round(quantile_cont(s_cm, 0.9), 2) AS p90 FROM vines GROUP BY 1")
def percentiles(spark, sf_dir):
    return view(spark, sf_dir, "vines").groupBy("block_no").agg(*(F.round(F.percentile("s_cm", F.lit(p / 100)), 2).alias(f"p{p}") for p in (25, 50, 75, 90)))


@query("WITH b AS (SELECT block_id, CAST(floor(angle_deg / 10.0) AS INTEGER) AS bin, sum(len_cm) AS w FROM segments GROUP BY ALL), k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest([1, 2, 4, 2, 1]) AS k) SELECT block_id, bin + o AS bin, round(CAST(sum(w * k) AS DOUBLE), 2) AS smooth FROM b, k GROUP BY block_id, bin + o")
def orientation_histogram(spark, sf_dir):
    got = rows.smoothed_histogram(view(spark, sf_dir, "segments"), ["block_id"], F.col("angle_deg"), F.col("len_cm"), 10, (1, 2, 4, 2, 1))
    return got.withColumn("smooth", F.round("smooth", 2))


@query("WITH a AS (SELECT block_id, degrees(atan2(sum(len_cm * sin(radians(2 * angle_deg))), sum(len_cm * cos(radians(2 * angle_deg))))) / 2 AS d FROM segments GROUP BY 1) SELECT block_id, round(CASE WHEN d < 0 THEN d + 180 ELSE d END, 4) AS axis_deg FROM a")
def mean_axis(spark, sf_dir):
    return view(spark, sf_dir, "segments").groupBy("block_id").agg(F.round(grid.mean_axis(F.col("angle_deg"), F.col("len_cm")), 4).alias("axis_deg"))


@query("""WITH f AS (SELECT block_no, regr_slope(s_cm, t_cm) AS m, regr_intercept(s_cm, t_cm) AS b FROM vines GROUP BY 1), x AS (SELECT v.block_no, s_cm, t_cm, abs(s_cm - (m * t_cm + b)) AS e FROM vines v JOIN f USING (block_no)),
 l AS (SELECT block_no, greatest(0.6, 3 * median(e)) AS lim FROM x GROUP BY 1) SELECT block_no, round(regr_slope(s_cm, t_cm), 6) AS slope, round(regr_intercept(s_cm, t_cm), 4) AS intercept, count(*) AS used FROM x JOIN l USING (block_no) WHERE e <= lim GROUP BY 1""")
def robust_line(spark, sf_dir):
    got = rows.trimmed_line(view(spark, sf_dir, "vines"), ["block_no"], "t_cm", "s_cm")
    return got.select("block_no", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "used")


@query("WITH a AS (SELECT kind, degrees(0.5 * atan2(2 * covar_pop(x_cm, y_cm), var_pop(x_cm) - var_pop(y_cm))) AS d FROM points GROUP BY 1) SELECT kind, round(CASE WHEN d < 0 THEN d + 180 ELSE d END, 4) AS angle_deg FROM a")
def main_direction(spark, sf_dir):
    return rows.main_direction(view(spark, sf_dir, "points"), ["kind"], "x_cm", "y_cm").select("kind", F.round("angle_deg", 4).alias("angle_deg"))


@query("WITH a AS (SELECT block_no, row_no, count(*) * 10 AS area, lead(row_no) OVER (PARTITION BY block_no ORDER BY row_no) AS other FROM vines GROUP BY block_no, row_no), h AS (SELECT block_no, row_no, 0.5 * area AS half FROM a UNION ALL SELECT block_no, other, 0.5 * area FROM a WHERE other IS NOT NULL) SELECT block_no, row_no, CAST(sum(half) AS DOUBLE) AS half_area FROM h GROUP BY ALL")
def half_shares(spark, sf_dir):
    strips = view(spark, sf_dir, "vines").groupBy("block_no", "row_no").agg((F.count("*") * 10).alias("area"))
    strips = strips.withColumn("other", F.lead("row_no").over(Window.partitionBy("block_no").orderBy("row_no")))
    halves = strips.select("block_no", F.explode(F.array_compact(F.array("row_no", "other"))).alias("row_no"), (0.5 * F.col("area")).alias("half"))
    return halves.groupBy("block_no", "row_no").agg(F.sum("half").alias("half_area"))


@query("WITH c AS (SELECT block_no, l_linenumber AS cover, count(*) AS n, min(s_cm * 10000000000 + l_orderkey) AS p FROM vines GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY n DESC, p) AS i FROM c) SELECT block_no, cover, n FROM k WHERE i = 1")
def dominant_cover(spark, sf_dir):
    votes = view(spark, sf_dir, "vines").groupBy("block_no", F.col("l_linenumber").alias("cover")).agg(F.count("*").alias("n"), F.min(F.struct("s_cm", "l_orderkey")).alias("p"))
    best = votes.groupBy("block_no").agg(F.max_by(F.struct("cover", "n"), F.struct("n", (-F.col("p.s_cm")).alias("a"), (-F.col("p.l_orderkey")).alias("b"))).alias("x"))
    return best.select("block_no", "x.cover", "x.n")


@query(f"WITH {_ROWS} SELECT count(DISTINCT block_no) AS blocks, count(*) AS row_count, round(sum(len) / 100000.0, 3) AS length_km, CAST(sum(n) AS BIGINT) AS vines, round(sum(len) / 100.0 * 2.5 / 10000.0, 4) AS area_ha FROM r")
def survey_summary(spark, sf_dir):
    return row_stats(view(spark, sf_dir, "vines")).agg(F.count_distinct("block_no").alias("blocks"), F.count("*").alias("row_count"), F.round(F.sum("len") / 100000, 3).alias("length_km"), F.sum("n").alias("vines"), F.round(F.sum("len") / 100 * 2.5 / 10000, 4).alias("area_ha"))


@query(f"WITH {_ROWS} SELECT block_no, row_no, len FROM (SELECT block_no, row_no, coalesce(len, 0) AS len FROM r ORDER BY 3 DESC, 1, 2 LIMIT 5)")
def longest_rows(spark, sf_dir):
    return row_stats(view(spark, sf_dir, "vines")).select("block_no", "row_no", F.coalesce("len", F.lit(0)).alias("len")).orderBy(F.desc("len"), "block_no", "row_no").limit(5)


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY s_cm, l_orderkey, l_linenumber) AS i FROM vines) SELECT block_no, row_no, s_cm, l_orderkey, l_linenumber FROM k WHERE i % 10 = 1")
def every_tenth(spark, sf_dir):
    # the row parts vines of one place, order and line, so that the choice hangs on the table alone
    w = Window.partitionBy("block_no").orderBy("s_cm", "l_orderkey", "l_linenumber", "row_no")
    return view(spark, sf_dir, "vines").withColumn("i", F.row_number().over(w)).where(F.col("i") % 10 == 1).select("block_no", "row_no", "s_cm", "l_orderkey", "l_linenumber")


@query("WITH b AS (SELECT block_id, avg(c) AS x, -avg(r) AS y FROM segments GROUP BY 1) SELECT block_id, row_number() OVER (ORDER BY round(-y, 6), round(x, 6), block_id) AS place FROM b")
def block_order(spark, sf_dir):
    blocks = view(spark, sf_dir, "segments").groupBy("block_id").agg(F.round(F.avg("r"), 6).alias("south"), F.round(F.avg("c"), 6).alias("east"))
    return blocks.select("block_id", F.row_number().over(Window.orderBy("south", "east", "block_id")).cast("bigint").alias("place"))


@query("WITH d AS (SELECT DISTINCT block_id, r, c FROM segments), w AS (SELECT *, sum(r) OVER p AS sr, sum(c) OVER p AS sc, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY block_id)) SELECT block_id, r, c, round((sr - r) / (n - 1.0), 4) AS others_r, round((sc - c) / (n - 1.0), 4) AS others_c FROM w WHERE n > 1")
def leave_one_out(spark, sf_dir):
    w = Window.partitionBy("block_id")
    tiles = view(spark, sf_dir, "segments").select("block_id", "r", "c").distinct().withColumn("n", F.count("*").over(w))
    mean = lambda x: F.round((F.sum(x).over(w) - F.col(x)) / (F.col("n") - 1), 4)
    return tiles.withColumns({"others_r": mean("r"), "others_c": mean("c")}).where("n > 1").select("block_id", "r", "c", "others_r", "others_c")


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY block_no, row_no ORDER BY s_cm, l_orderkey, l_linenumber) AS i FROM vines), c AS (SELECT *, sum(CASE WHEN s_cm // 1500 <> ps // 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY block_no, row_no ORDER BY s_cm, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT *, lag(s_cm) OVER (PARTITION BY block_no, row_no ORDER BY s_cm, l_orderkey, l_linenumber) AS ps FROM p)) SELECT block_no, row_no, CAST(piece AS BIGINT) AS piece, count(*) AS n, max(s_cm) - min(s_cm) AS length_cm FROM c GROUP BY ALL")
def cut_rows(spark, sf_dir):
    """Rows cut where they pass a multiple of 15 m."""
    w = Window.partitionBy("block_no", "row_no").orderBy("s_cm", "l_orderkey", "l_linenumber")
    part = F.floor(F.col("s_cm") / 1500)
    cut = F.coalesce((part != F.lag(part).over(w)).cast("int"), F.lit(0))
    got = view(spark, sf_dir, "vines").withColumn("cut", cut).withColumn("piece", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return got.groupBy("block_no", "row_no", "piece").agg(F.count("*").alias("n"), (F.max("s_cm") - F.min("s_cm")).alias("length_cm"))


@query("WITH w AS (SELECT user_id, event_id, ts, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS d FROM walk), k AS (SELECT *, sum(CASE WHEN d >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM w) SELECT user_id, CAST(visit AS BIGINT) AS visit, count(*) AS n FROM k GROUP BY ALL")
def walk_visits(spark, sf_dir):
    """Visits of a walker: a pause of half an hour ends one."""
    walk = view(spark, sf_dir, "walk").withColumn("at", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))))
    return rows.gap_clusters(walk, ["user_id"], "at", 1800, ["ts", "event_id"], "visit").groupBy("user_id", "visit").agg(F.count("*").alias("n"))
