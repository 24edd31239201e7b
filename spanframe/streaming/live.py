"""Hot functions of a trace that is still being written, as a stream of event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.schema import RAW
from spanframe.sources.trace_json import events_of_line


def stream_events(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """Events from a folder to which files are added whose lines hold whole events, as read_raw(mode="lines") takes them.

    A line that can't be told ends the stream with an error; with broken="count" it is left out, and the stream's progress
    tells of each batch, as the observed metrics ``lines``, how many lines were read and how many left out.
    """
    lines = spark.readStream.text(path).select("value", events_of_line(F.col("value")).alias("events"))
    if broken == "count":
        lines = lines.observe("lines", F.count("*").alias("read"), F.count(F.when(F.col("events").isNull(), 1)).alias("broken")).where("events IS NOT NULL")
    elif broken == "fail":
        lines = lines.withColumn("events", F.coalesce("events", F.raise_error(F.concat(F.lit("a line isn't whole events: "), F.left("value", F.lit(200)))).cast("array<string>")))
    else:
        raise ValueError(f"broken lines are failed or counted, not {broken}")
    return lines.select(F.explode("events").alias("text")).select(F.from_json("text", RAW).alias("e")).select("e.*").withColumn("at", F.timestamp_micros(F.col("ts").cast("long")))


def hot_functions_live(events: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    return events.where("dur > 0").withWatermark("at", late).groupBy(F.window("at", window), "name").agg(F.count("*").alias("n"), F.sum("dur").alias("total_dur"))
