"""Statistics of whole traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.joins import with_names
from spanframe.sources.trace_json import Trace


def hot_functions(events: DataFrame, limit: int = 50) -> DataFrame:
    by = events.where("dur > 0").groupBy("name").agg(F.count("*").alias("n"), F.sum("dur").alias("total_dur"), F.avg("dur").alias("avg_dur"))
    return by.orderBy(F.desc("total_dur"), "name").limit(limit)


def longest_events(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.orderBy(F.desc("dur"), "event_id").limit(limit)


def events_per_thread(events: DataFrame, processes: DataFrame, threads: DataFrame) -> DataFrame:
    counts = events.groupBy("pid", "tid").agg(F.count("*").alias("n"))
    return with_names(counts, processes, threads).where("process_name IS NOT NULL AND thread_name IS NOT NULL")


def by_category(events: DataFrame) -> DataFrame:
    return events.where("dur > 0").groupBy("category").agg(F.count("*").alias("n"), F.sum("dur").alias("total_dur"))


def counter_summary(counters: DataFrame) -> DataFrame:
    return counters.groupBy("name", "pid").agg(F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"))


def overview(trace: Trace) -> DataFrame:
    """One row: processes, threads, events, names, args, counters, flows and length of a trace."""
    e = trace.events
    end = F.when(F.col("dur") > 0, F.col("ts") + F.col("dur")).otherwise(F.col("ts"))
    facts = e.agg(
        F.count("*").alias("events"), F.count_distinct("name").alias("names"), F.count_distinct("category").alias("categories"), F.count("args").alias("args"),
        F.coalesce(F.sum(F.length("args")), F.lit(0)).alias("args_chars"), F.count_distinct(F.when(F.col("phase").isin("s", "t", "f"), F.col("id"))).alias("flows"), (F.max(end) - F.min("ts")).alias("length"),
    )
    one = lambda df, name: df.agg(F.count("*").alias(name))
    series = trace.counters.agg(F.count_distinct("pid", "name").alias("series"), F.count("*").alias("points"))
    return facts.join(one(trace.processes, "processes")).join(one(trace.threads, "threads")).join(series)  # one row each


def thread_order(processes: DataFrame, threads: DataFrame) -> DataFrame:
    """(pid, process_index, tid, place): threads with their place in their process, by sort_index and then tid."""
    place = F.row_number().over(Window.partitionBy("pid").orderBy("sort_index", "tid"))
    ranked = threads.select("pid", "tid", place.alias("place"))
    return processes.select("pid", F.col("sort_index").alias("process_index")).join(ranked, "pid").select("pid", "process_index", "tid", "place")
