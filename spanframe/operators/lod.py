"""Level of detail of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.plans.pieces import beside, cut


def timeline_lod(spans: DataFrame, start: float, end: float, width: int, hide_categories=(), wide: float = 2.0, gap: float = 2.0) -> DataFrame:
    """(pid, tid, depth, kind, x0, x1, n, event_id) of what a view of ``width`` pixels shows.

    Slices of two pixels and more stay; smaller ones merge into runs while the gap is two pixels at most; instants are
    points. event_id is the slice, or the first of the run.
    """
    scale = width / (end - start)
    rows = spans.where(F.col("in_thread") & (F.col("ts") <= end) & (F.col("end_ts") >= start))
    instants = F.col("phase").isin("i", "R")
    if hide_categories:
        rows = rows.where(instants | ~F.col("category").isin(*hide_categories))
    rows = rows.withColumn("x0", (F.col("ts") - start) * scale).withColumn("x1", (F.col("end_ts") - start) * scale)
    rows = rows.withColumn("kind", F.when(instants, "instant").when(F.col("x1") - F.col("x0") >= wide, "slice").otherwise("run"))
    alone = rows.where("kind <> 'run'").select("pid", "tid", "depth", "kind", "x0", "x1", F.lit(1).cast("long").alias("n"), "event_id")
    lane = ["pid", "tid", "depth"]
    small = cut(rows.where("kind = 'run'").withColumn("x1", F.greatest("x1", F.col("x0") + 1)), lane)
    small = beside(small, lane, ["seq"], _reach=("max", "x1")).withColumn("_new", F.coalesce((F.col("x0") > F.col("_reach") + gap).cast("int"), F.lit(1)))
    small = beside(small, lane, ["seq"], _run=("sum", "_new")).withColumn("_run", F.col("_run") + F.col("_new"))
    runs = small.groupBy(*lane, "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"), F.min_by("event_id", "seq").alias("event_id"))
    return alone.unionByName(runs.withColumn("kind", F.lit("run")).drop("_run"))
