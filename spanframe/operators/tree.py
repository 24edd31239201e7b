"""Questions to the call tree: children, call stacks, siblings, longest calls, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.plans.pieces import PIECE, beside, cut
from spanframe.plans.places import placed

#: The columns by which children and children by name are sorted.
CHILD_SORTS, NAME_SORTS = ("name", "dur", "pct"), ("name", "n", "total", "avg", "min", "max", "pct")


def call_stack(spans: DataFrame, event_id: int) -> DataFrame:
    """(level, event_id, name) from the root to the event; empty for an id that isn't there."""
    own = spans.where(F.col("event_id") == event_id).where("in_thread").select(F.col("pid").alias("_pid"), F.col("tid").alias("_tid"), F.col("seq").alias("_seq"))
    above = spans.where("in_thread").join(F.broadcast(own), F.expr("pid = _pid AND tid = _tid AND seq <= _seq AND last_seq >= _seq"))  # the event is one row
    return above.select(F.col("depth").alias("level"), "event_id", "name")


def children(spans: DataFrame, event_id: int, descendants: bool = False, text: str = "") -> DataFrame:
    """Timed children, or all descendants, that end by the event's end, with their share of its duration."""
    own = spans.where(F.col("event_id") == event_id).where("in_thread")
    parent = own.select(F.col("pid").alias("_pid"), F.col("tid").alias("_tid"), F.col("seq").alias("_seq"), F.col("last_seq").alias("_last"), F.col("end_ts").alias("_end"), F.col("dur").alias("_dur"))
    under = F.expr("pid = _pid AND tid = _tid AND seq > _seq AND seq <= _last AND end_ts <= _end")
    rows = spans.where("in_thread AND dur > 0").join(F.broadcast(parent), under if descendants else under & (F.col("parent_id") == event_id))  # the parent is one row
    if text:
        rows = rows.where(F.lower("name").contains(text.lower()))
    return rows.withColumn("pct", F.try_divide(F.col("dur") * 100, F.col("_dur"))).drop("_pid", "_tid", "_seq", "_last", "_end", "_dur")


def children_by_name(spans: DataFrame, event_id: int, descendants: bool = False, text: str = "") -> DataFrame:
    return children(spans, event_id, descendants, text).groupBy("name").agg(
        F.count("*").alias("n"), F.sum("dur").alias("total"), F.avg("dur").alias("avg"), F.min("dur").alias("min"), F.max("dur").alias("max"),
        F.sum("pct").alias("pct"), F.max_by("event_id", F.struct("dur", -F.col("seq"))).alias("longest"),
    )


def sorted_children(rows: DataFrame, sort_by: str = "dur", ascending: bool = False) -> DataFrame:
    """Rows of children or of children_by_name in the order of one of their columns; ties by event id or name."""
    by_name = "event_id" not in rows.columns
    if sort_by not in (NAME_SORTS if by_name else CHILD_SORTS):
        raise ValueError(f"children aren't sorted by {sort_by}")
    return rows.orderBy(F.asc(sort_by) if ascending else F.desc(sort_by), "name" if by_name else "event_id")


def consolidate_runs(spans: DataFrame, event_id: int) -> DataFrame:
    """Descendants in thread order, neighbours of one name, depth and parent as one entry."""
    rows = children(spans, event_id, descendants=True)
    thread, same = ["pid", "tid"], F.struct("name", "depth", "parent_id")
    rows = beside(cut(rows.withColumn("_same", same), thread), thread, ["seq"], _up=("lag", "_same"))
    rows = rows.withColumn("_new", F.coalesce((F.col("_same") != F.col("_up")).cast("int"), F.lit(1)))
    runs = beside(rows, thread, ["seq"], run=("sum", "_new")).withColumn("run", F.col("run") + F.col("_new"))
    return runs.groupBy("pid", "tid", "run").agg(
        F.min_by("event_id", "seq").alias("first_event"), F.first("name").alias("name"), F.first("depth").alias("depth"), F.count("*").alias("n"),
        F.sum("dur").alias("total"), F.sum("self_time").alias("total_self"), F.avg("dur").alias("avg"), F.avg("self_time").alias("avg_self"),
    )


def with_navigation(spans: DataFrame) -> DataFrame:
    """Thread events with prev_sibling, next_sibling and longest_child. Roots of a thread are siblings."""
    family = ["pid", "tid", "parent_id"]
    rows = beside(cut(spans.where("in_thread"), family), family, ["seq"], prev_sibling=("lag", "event_id"), next_sibling=("lead", "event_id")).drop(PIECE)
    kids = spans.where("in_thread AND parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("event_id")).agg(F.max_by("event_id", F.struct("dur", -F.col("seq"))).alias("longest_child"))
    return rows.join(kids, "event_id", "left")


def longest_instance(spans: DataFrame) -> DataFrame:
    timed = spans.where("in_thread AND dur > 0")
    return timed.groupBy("pid", "tid", "name").agg(F.max_by("event_id", F.struct("dur", -F.col("seq"))).alias("event_id"), F.max("dur").alias("dur"))


def instances(spans: DataFrame, name: str, sort_by: str = "dur") -> DataFrame:
    """The timed events of a name with their place and neighbours in order of start; sorted by dur, longest first, or ts."""
    rows = spans.where((F.col("name") == name) & (F.col("dur") > 0) & (F.col("phase") != "C") & ~F.col("is_end"))
    rows = placed(rows, "name")
    return rows.orderBy(F.desc("dur") if sort_by == "dur" else F.asc("ts"), "event_id")


def first_instances(events: DataFrame) -> DataFrame:
    """(name, event_id, ts): the earliest timed event of each name, the first in file order of equals."""
    timed = events.where("dur > 0 AND phase <> 'C'")
    return timed.groupBy("name").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("ts"))
