"""A trace derived from an event table (event_id, ts, user_id, event_type, value, props), and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.sources.trace_json import Trace


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a complete event; durations come from value, processes and threads from user_id."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("double")
    return raw.select(
        "event_id", F.col("event_type").alias("name"), F.when(F.col("value") < 10, "small").otherwise("large").alias("category"), F.lit("X").alias("phase"),
        since.alias("ts"), (F.round(F.col("value") * 100) * 3600000).cast("double").alias("dur"), F.pmod("user_id", F.lit(4)).alias("pid"), F.col("user_id").alias("tid"),
        F.col("user_id").cast("decimal(20,0)").alias("id"), F.col("props").alias("args"),
    )


def with_flows(events: DataFrame) -> DataFrame:
    """The events with flow phases by event id: of five, one begins a flow, one is a step, one ends it, two stay complete."""
    step = F.pmod("event_id", F.lit(5))
    return events.withColumn("phase", F.when(step == 0, "s").when(step == 1, "t").when(step == 2, "f").otherwise(F.col("phase")))


def begin_end(events: DataFrame) -> DataFrame:
    """Each span as a begin and an end event; ends have ids above a thousand million."""
    begin = events.withColumn("phase", F.lit("B")).withColumn("dur", F.lit(0.0))
    end = events.withColumn("event_id", F.col("event_id") + 1_000_000_000).withColumn("ts", F.col("ts") + F.col("dur")).withColumn("phase", F.lit("E")).withColumn("dur", F.lit(0.0))
    return begin.unionByName(end)


def trace_of(spark: SparkSession, sf_dir: str) -> Trace:
    events = events_of(spark, sf_dir)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    processes = events.select("pid").distinct().select("pid", F.concat(F.lit("Process "), F.col("pid").cast("string")).alias("name"), F.lit(0).alias("sort_index"))
    threads = events.select("pid", "tid").distinct().select("pid", "tid", F.concat(F.lit("Thread "), F.col("tid").cast("string")).alias("name"), F.lit(0).alias("sort_index"))
    points = raw.select(
        F.pmod("user_id", F.lit(4)).alias("pid"), F.col("event_type").alias("name"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("double").alias("ts"), "value"
    )
    return Trace(events, processes, threads, points)
