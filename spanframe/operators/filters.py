"""Visibility, search and time filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(df: DataFrame, hide_pids=(), hide_tids=(), hide_categories=()) -> DataFrame:
    """Rows of no hidden process, thread or category. A hidden thread id hides that thread of every process."""
    for column, hidden in (("pid", hide_pids), ("tid", hide_tids), ("category", hide_categories)):
        if hidden:
            df = df.where(~F.col(column).isin(*hidden))
    return df


def visible_categories(df: DataFrame, show: bool, categories: DataFrame | None = None) -> DataFrame:
    """All categories shown, or none: hiding all hides every category of the list (plans.spans.categories), the empty one too.

    Events without a category, which no list has, are hidden by none.
    """
    return df if show else df.join(categories if categories is not None else df.select("category").distinct(), "category", "left_anti")


def thread_counts(spans: DataFrame, threads: DataFrame) -> DataFrame:
    counts = spans.where("in_thread").groupBy("pid", "tid").agg(F.count("*").alias("events"))
    return threads.join(counts, ["pid", "tid"], "left").select("pid", "tid", F.coalesce("events", F.lit(0)).alias("events"))


def overlapping(spans: DataFrame, start: float, end: float) -> DataFrame:
    """Thread events that touch [start, end], bounds included."""
    return spans.where(F.col("in_thread") & (F.col("ts") <= end) & (F.col("end_ts") >= start))


def matching(events: DataFrame, text: str) -> DataFrame:
    """Events whose name or category holds the text, whatever the case; nothing matches an empty text."""
    low = text.lower()
    found = F.lower("name").contains(low) | F.lower("category").contains(low)
    return events.where(found if low else F.lit(False))


def name_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.count("*").alias("n"), F.sum("dur").alias("total_dur"), F.avg("dur").alias("avg_dur"))


def first_per_name(df: DataFrame) -> DataFrame:
    """The first event of each name; a name's rows are reduced before the shuffle."""
    return df.groupBy("name").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), "event_id").alias("_first")).select("_first.*")


def search(events: DataFrame, text: str, unique: bool = False, sort_by: str = "ts", ascending: bool = True) -> DataFrame:
    """Matches with the statistics of their names, which count all matches; sort_by: ts, dur, name, n or avg_dur."""
    found = matching(events, text)
    out = (first_per_name(found) if unique else found).join(name_stats(found), "name")
    return out.orderBy(F.asc(sort_by) if ascending else F.desc(sort_by), "event_id")
