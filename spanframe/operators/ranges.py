"""Statistics of what falls into ranges of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.joins import cells, level_of

#: Ranges are sent to all executors up to so many.
FEW_RANGES = 10_000


def _stats(rows: DataFrame, keys: list[str], length: Column) -> DataFrame:
    return rows.groupBy(*keys, "name").agg(
        F.count("*").alias("n"), F.sum("part").alias("total"), F.min("part").alias("min_part"), F.max("part").alias("max_part"),
        F.max_by("event_id", F.struct("dur", -F.col("pid"), -F.col("tid"), -F.col("seq"))).alias("longest"), F.first(length).alias("_length"),
    ).withColumn("avg_part", F.col("total") / F.col("n")).withColumn("pct", F.try_divide(F.col("total") * 100, F.col("_length"))).drop("_length")


def _parts(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    part = F.least("end_ts", end) - F.greatest("ts", start)
    return spans.where(F.col("in_thread") & (F.col("dur") > 0) & (F.col("ts") <= end) & (F.col("end_ts") >= start)).withColumn("part", part).where("part > 0")


def range_stats(spans: DataFrame, start: float, end: float) -> DataFrame:
    """By name: what of the timed events lies in [start, end]. longest: the event of greatest whole duration."""
    return _stats(_parts(spans, F.lit(start), F.lit(end)), [], F.lit(end - start))


def range_stats_many(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_stats of each of ranges (range_id, start, end). Spans and ranges meet by time cell, once for each pair.

    A pair meets in cells of the power of two that the longer of the two fits in, so either touches two of them at most.
    Ranges are sent to all executors up to FEW_RANGES, so that spans stay where they are; beyond, cells are join keys.
    """
    timed = spans.where("in_thread AND dur > 0").withColumn("_own", level_of(F.col("dur")))
    asked = ranges.where("end >= start").select("range_id", F.col("start").alias("_start"), F.col("end").alias("_end"), level_of(F.col("end") - F.col("start")).alias("_other"))
    levels = lambda df, c: F.array(*[F.lit(r[0]) for r in df.select(c).distinct().orderBy(c).collect()]).cast("array<int>")  # noqa: E731  powers of two
    own, other = levels(timed, "_own"), levels(asked, "_other")
    at = lambda df, c, those, low, high: df.withColumn("_level", F.explode(F.array_distinct(F.concat(F.array(c), F.filter(those, lambda k: k > F.col(c)))))).withColumn("_cell", F.explode(cells(F.col(low), F.col(high), F.col("_level"))))
    asked = at(asked, "_other", own, "_start", "_end")
    asked = F.broadcast(asked) if ranges.limit(FEW_RANGES + 1).count() <= FEW_RANGES else asked
    met = at(timed, "_own", other, "ts", "end_ts").join(asked, ["_level", "_cell"]).where("_level = greatest(_own, _other)")
    met = met.where(F.col("_cell") == F.floor(F.greatest("ts", "_start") / F.pow(F.lit(2.0), F.col("_level"))))
    return _stats(_parts(met, F.col("_start"), F.col("_end")), ["range_id"], F.col("_end") - F.col("_start"))
