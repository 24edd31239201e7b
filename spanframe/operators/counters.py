"""Counter series in buckets, and the call rates of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter_buckets(counters: DataFrame, start: float, end: float, buckets: int) -> DataFrame:
    """Each series in [start, end] on ``buckets`` buckets: least, greatest and last value, and how many points.

    The last point before the view comes along, and the first after it as a row of its own, past_end.
    """
    edges = counters.groupBy("pid", "name").agg(F.max(F.when(F.col("ts") < start, F.struct("ts", "value"))).alias("first"), F.min(F.when(F.col("ts") > end, F.struct("ts", "value"))).alias("past"))
    rows = counters.join(edges, ["pid", "name"])
    inside = (F.col("ts") <= end) & ((F.col("ts") >= start) | (F.struct("ts", "value") == F.col("first")))
    past = F.struct("ts", "value") == F.col("past")
    at = ((F.col("ts") - start) / (end - start) * buckets).cast("long")
    rows = rows.where(inside | past).withColumn("past_end", F.col("ts") > end).withColumn("bucket", at)
    return rows.groupBy("pid", "name", "past_end", "bucket").agg(
        F.min("ts").alias("first_ts"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max_by("value", F.struct("ts", "value")).alias("last_value"), F.count("*").alias("points")
    )


def call_rates(events: DataFrame, min_rate: float = 200.0, metadata: DataFrame | None = None) -> DataFrame:
    """Names called at least ``min_rate`` times a second over the trace; no rate where the trace has no length.

    metadata: the trace's metadata events (Trace.metadata), whose names and times count as well.
    """
    if metadata is not None:
        events = events.select("name", "ts").unionByName(metadata.select("name", "ts"))
    span = events.where("ts <> 0").agg((F.max("ts") - F.min("ts")).alias("_length"))
    counts = events.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    rated = counts.join(F.broadcast(span)).withColumn("rate", F.try_divide(F.col("n") * 1e6, F.col("_length")))  # span is one row
    return rated.where(F.col("rate") >= min_rate).drop("_length")
