"""Generated traces of any size, made on the executors from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, spans: int, processes: int = 4, threads: int = 8, names: int = 50, categories: int = 8, partitions: int | None = None) -> DataFrame:
    """``spans`` complete events in nests of one to four (half of depth one, then 30, 15 and 5 in a hundred); a tenth has args."""
    rows = spark.range(0, spans, 1, partitions) if partitions else spark.range(spans)
    pick = lambda salt, n: F.pmod(F.xxhash64("nest", F.lit(salt)), F.lit(n))
    rows = rows.withColumn("nest", F.floor(F.col("id") / 4)).withColumn("level", F.pmod("id", F.lit(4)))
    chance = pick(1, 100)
    depth = F.when(chance < 50, 1).when(chance < 80, 2).when(chance < 95, 3).otherwise(4)
    own = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    kept = rows.where(F.col("level") < depth)
    return kept.select(
        F.col("id").alias("event_id"), F.concat(F.lit("function_"), own(2, names).cast("string")).alias("name"), F.concat(F.lit("category_"), own(3, categories).cast("string")).alias("category"),
        F.lit("X").alias("phase"), (F.floor(F.col("nest") / (processes * threads)) * 1000.0 + F.col("level") * 10).alias("ts"), (F.lit(900.0) - F.col("level") * 200 - own(4, 100)).alias("dur"),
        F.pmod("nest", F.lit(processes)).alias("pid"), F.pmod(F.floor(F.col("nest") / processes), F.lit(threads)).alias("tid"), F.lit(0).cast("decimal(20,0)").alias("id"),
        F.when(own(5, 10) == 0, F.to_json(F.struct(own(6, 1000).alias("value")))).alias("args"),
    )


def generate_trace(spark: SparkSession, spans: int, processes: int = 4, threads: int = 8, counter_points: int = 1000, flows: int = 500, **shape) -> DataFrame:
    """generate() and, with ids after those of the spans, ``counter_points`` counter events a process and ``flows`` pairs of a flow's begin and end.

    A counter's value wanders between 0 and 100; a flow leaves one thread and reaches another, of any process, later on.
    """
    length = float(max(1, spans // 4 // (processes * threads)) * 1000)
    chance = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    columns = ["event_id", "name", "category", "phase", "ts", "dur", "pid", "tid", "id", "args"]
    none, zero = F.lit(0).cast("decimal(20,0)"), F.lit(0.0)
    wave = F.round(50 + 40 * F.sin(F.col("id") / 20) + chance(6, 1000) / 100, 2)
    points = spark.range(processes * counter_points).select(
        (F.col("id") + spans).alias("event_id"), F.lit("counter").alias("name"), F.lit("counters").alias("category"), F.lit("C").alias("phase"), (F.floor(F.col("id") / processes) * (length / counter_points if counter_points else 0.0)).alias("ts"),
        zero.alias("dur"), F.pmod("id", F.lit(processes)).alias("pid"), F.lit(0).cast("long").alias("tid"), none.alias("id"), F.to_json(F.struct(wave.alias("value"))).alias("args"),
    )
    ends = spark.range(2 * flows).withColumn("flow", F.floor(F.col("id") / 2)).withColumn("last", F.pmod("id", F.lit(2)))
    arrows = ends.select(
        (F.col("id") + spans + processes * counter_points).alias("event_id"), F.lit("flow").alias("name"), F.lit("flows").alias("category"), F.when(F.col("last") == 1, "f").otherwise("s").alias("phase"),
        (F.pmod(F.xxhash64("flow", F.lit(7)), F.lit(int(length))) + F.col("last") * (1 + chance(8, 500))).cast("double").alias("ts"), zero.alias("dur"), chance(9, processes).alias("pid"), chance(10, threads).alias("tid"),
        (F.col("flow") + 1).cast("decimal(20,0)").alias("id"), F.lit(None).cast("string").alias("args"),
    )
    spans_of = generate(spark, spans, processes, threads, **shape).select(*columns)
    return spans_of.unionByName(points).unionByName(arrows)
