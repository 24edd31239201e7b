"""Spans stored in blocks that a view reads a fraction of.

Spans are laid out by the power of two that their duration fits in and then by start, so that no block reaches further past
its own starts than its spans are long, however long others are. A table tells of each block which processes and times it
holds and how far it reaches; a view reads the blocks that may touch it, and of these only what Parquet's own statistics
don't rule out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.operators.joins import level_of

#: Spans of a block, about.
BLOCK_ROWS = 1_000_000
#: A view that touches more blocks than this reads them by a join with the table of blocks.
FEW_BLOCKS = 10_000


@dataclass
class SpanStore:
    spans: DataFrame
    blocks: DataFrame

    def near(self, start: float, end: float, pid: int | None = None) -> DataFrame:
        """The blocks that may hold spans that touch [start, end]."""
        found = self.blocks.where((F.col("first_ts") <= end) & (F.col("reach") >= start))
        return found.where((F.col("first_pid") <= pid) & (F.col("last_pid") >= pid)) if pid is not None else found

    def overlapping(self, start: float, end: float, pid: int | None = None, tid: int | None = None) -> DataFrame:
        """The stored spans that touch [start, end], bounds included; of one process or thread if asked."""
        near = self.near(start, end, pid).select("block")
        found = [r["block"] for r in near.limit(FEW_BLOCKS + 1).collect()]
        rows = self.spans.where(F.col("block").isin(found)) if len(found) <= FEW_BLOCKS else self.spans.join(near, "block", "left_semi")
        rows = rows.where((F.col("ts") <= end) & (F.col("end_ts") >= start))
        for column, value in (("pid", pid), ("tid", tid)):
            rows = rows.where(F.col(column) == value) if value is not None else rows
        return rows.drop("block")


def write_spans(spans: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> SpanStore:
    """Writes the thread spans below ``path``, and the table of their blocks beside them. Runs a job that counts them."""
    rows = spans.where("in_thread").withColumn("_level", F.when(F.col("dur") > 0, level_of(F.col("dur"))).otherwise(-99))
    blocks = max(1, -(-rows.count() // block_rows))
    order = ["_level", "ts", "pid", "tid", "event_id"]
    laid = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()).drop("_level")
    laid.write.partitionBy("block").parquet(f"{path}/spans")
    spark = spans.sparkSession
    spark.createDataFrame([(laid.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
    stored = spark.read.schema(laid.schema).parquet(f"{path}/spans")
    told = stored.groupBy("block").agg(F.count("*").alias("spans"), F.min("ts").alias("first_ts"), F.max(F.greatest("ts", "end_ts")).alias("reach"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"))
    told.coalesce(1).write.parquet(f"{path}/blocks")  # a row for each block
    return read_spans(spark, path)


def read_spans(spark: SparkSession, path: str) -> SpanStore:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return SpanStore(spark.read.schema(schema).parquet(f"{path}/spans"), spark.read.parquet(f"{path}/blocks"))
