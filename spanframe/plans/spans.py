"""Span construction: thread order, begin/end pairing, dedup, and the tree of spans (plans/nesting.py).

Windows order, pair and deduplicate a thread's events. A thread of very many rows is cut into pieces of time, in which the
windows run; a table of a row for each piece tells what stands in the pieces before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.plans.nesting import THREAD, nested
from spanframe.plans.pieces import PIECE, by_piece, counted_on, cut
from spanframe.plans.places import placed
from spanframe.plans.scratch import saved

#: The order of a thread: by start, longer first as the trace has it (the durations' negative), then event id.
FIRST_DUR = "_first_dur"
ORDER = ["ts", FIRST_DUR, "event_id"]


def ordered(events: DataFrame) -> DataFrame:
    """Thread events with seq, their place by start, longer first, then event id. Counters belong to no thread."""
    rows = cut(events.where("phase NOT IN ('C', 'M')"), THREAD).withColumn(FIRST_DUR, -F.col("dur"))
    order = Window.partitionBy(*by_piece(rows, THREAD)).orderBy(*ORDER)
    return counted_on(rows.withColumn("seq", F.row_number().over(order).cast("long")), THREAD, "seq")


def paired(rows: DataFrame) -> DataFrame:
    """Begins take the duration up to their end, ends that have a begin get is_end. Pairing is last in, first out."""
    keys = by_piece(rows, THREAD)
    thread = Window.partitionBy(*keys).orderBy(*ORDER)
    delta = F.when(F.col("phase") == "B", 1).when(F.col("phase") == "E", -1).otherwise(0)
    r = rows.withColumn("_s", F.sum(delta).over(thread.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_low", F.least(F.lit(0), F.min("_s").over(thread.rowsBetween(Window.unboundedPreceding, 0))))
    r = r.withColumn("_before", F.coalesce(F.least(F.lit(0), F.min("_s").over(thread.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0)))
    lone = (F.col("phase") == "E") & (F.col("_s") < F.col("_before"))
    both = F.col("phase").isin("B", "E") & ~lone
    level = F.when(both, F.col("_s") - F.col("_low") + F.when(F.col("phase") == "E", 1).otherwise(0))
    r = r.withColumn("_level", level)
    same = Window.partitionBy(*keys, "_level").orderBy(*ORDER)
    r = r.withColumn("_next", F.lead("ts").over(same)).withColumn("_kind", F.lead("phase").over(same))
    begun = F.coalesce(F.col("_level").isNotNull() & (F.col("phase") == "B") & (F.col("_kind") == "E"), F.lit(False))
    r = r.withColumn("dur", F.when(begun, F.col("_next") - F.col("ts")).otherwise(F.col("dur")))
    r = r.withColumn("is_end", F.col("_level").isNotNull() & (F.col("phase") == "E"))
    left = (F.col("phase") == "E") & ~F.col("is_end") | (F.col("phase") == "B") & ~begun
    r = r.withColumn("_left", left).drop("_s", "_low", "_before", "_level", "_next", "_kind")
    return _paired_across(r).drop("_left") if PIECE in rows.columns else r.drop("_left")


def _paired_across(rows: DataFrame) -> DataFrame:
    """Pairs of ends and begins that their pieces left over.

    What a piece leaves is ends and then begins. The ends take away from the stack that the pieces before leave, the begins
    add to it; the piece table tells how high it is, so each end and begin has a place in the stack, at which ends follow
    begins in turn. A piece has one of each kind at a place, at most.
    """
    rows = saved(rows, "thread-pairs")
    left = rows.where("_left").select(*THREAD, PIECE, "event_id", "ts", "phase", F.row_number().over(Window.partitionBy(*THREAD, PIECE, "phase").orderBy("seq")).alias("i"))
    count = lambda p: F.count(F.when(F.col("phase") == p, 1))
    pieces = left.groupBy(*THREAD, PIECE).agg(count("E").alias("ends"), count("B").alias("begins"))
    order = Window.partitionBy(*THREAD).orderBy(PIECE)
    net = F.coalesce(F.sum(F.col("begins") - F.col("ends")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("net", net).withColumn("down", F.col("net") - F.col("ends"))
    low = F.least(F.lit(0), F.coalesce(F.min("down").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = pieces.select(*THREAD, PIECE, "ends", (F.col("net") - low).alias("high"))
    met = left.join(pieces, [*THREAD, PIECE]).where("phase = 'B' OR i <= high")
    place = F.when(F.col("phase") == "B", F.greatest(F.col("high") - F.col("ends"), F.lit(0)) + F.col("i")).otherwise(F.col("high") - F.col("i") + 1)
    turn = Window.partitionBy(*THREAD, "place").orderBy(PIECE, F.col("phase") == "B")
    met = met.withColumn("place", place).withColumn("until", F.when((F.col("phase") == "B") & (F.lead("phase").over(turn) == "E"), F.lead("ts").over(turn)))
    known = met.where("phase = 'E' OR until IS NOT NULL").select("event_id", F.col("until"), F.lit(True).alias("_known"))
    r = rows.join(known, "event_id", "left")
    r = r.withColumn("dur", F.coalesce(F.col("until") - F.col("ts"), "dur")).withColumn("is_end", F.col("is_end") | (F.col("phase") == "E") & F.col("_known").isNotNull())
    return r.select(*rows.columns)


def deduplicated(rows: DataFrame, by_duration: bool = False) -> DataFrame:
    """Of neighbours in thread order with one name and start the longest stays, the first of equals.

    by_duration: durations are as when the rows were ordered, so the first of neighbours is the longest. Pieces never part
    rows of one start.
    """
    keys = by_piece(rows, THREAD)
    thread = Window.partitionBy(*keys).orderBy(*ORDER)
    new = F.coalesce((F.col("name") != F.lag("name").over(thread)) | (F.col("ts") != F.lag("ts").over(thread)), F.lit(True))
    if by_duration:
        return rows.withColumn("in_thread", new)
    r = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(thread))
    rank = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(F.desc("dur"), "seq"))
    return r.withColumn("in_thread", rank == 1).drop("_new", "_run")


def _thread_rows(events: DataFrame) -> DataFrame:
    """The events of threads, paired and deduplicated; a trace without begins and ends, which one look tells, has nothing to pair."""
    rows = ordered(events)
    if events.where("phase IN ('B', 'E')").take(1):
        return deduplicated_all(paired(rows))
    return deduplicated(rows.withColumn("is_end", F.lit(False)), by_duration=True)


def _loose(events: DataFrame) -> DataFrame:
    return events.where("phase = 'C'").withColumn("is_end", F.lit(False)).withColumn("in_thread", F.lit(False)).withColumn("end_ts", F.col("ts") + F.col("dur"))


def thread_spans(events: DataFrame) -> DataFrame:
    """Spans without the tree: durations of pairs, is_end, in_thread, seq and end_ts of all events but metadata.

    Enough for what asks for times, threads and names only; one shuffle by thread.
    """
    rows = _thread_rows(events).drop(FIRST_DUR, PIECE).withColumn("end_ts", F.col("ts") + F.col("dur"))
    return rows.unionByName(_loose(events), allowMissingColumns=True)


def build_spans(events: DataFrame) -> DataFrame:
    """SPAN columns of all events but metadata. Only in_thread rows have depth, parent_id, last_seq, path_id and self_time.

    Ends that close a begin, and events dropped as doubles, stay as rows with is_end or without in_thread, for operators
    that look at all events.
    """
    rows = _thread_rows(events)
    spans = nested(rows.where("in_thread"), ORDER)
    own = F.when(F.col("dur") > 0, F.col("dur") - F.col("inner_dur")).otherwise(0.0)
    spans = spans.withColumn("self_time", own).drop("inner_dur", FIRST_DUR, PIECE)
    rest = rows.where("NOT in_thread").drop(FIRST_DUR, PIECE).withColumn("end_ts", F.col("ts") + F.col("dur"))
    spans = spans.unionByName(rest, allowMissingColumns=True).unionByName(_loose(events), allowMissingColumns=True)
    return spans.withColumn("child_time", F.col("dur") - F.col("self_time")).withColumn("self_pct", F.try_divide(F.col("self_time") * 100, F.col("dur")))


def deduplicated_all(rows: DataFrame) -> DataFrame:
    """Dedup over the rows that aren't matched ends; matched ends stay outside the thread."""
    ends = rows.where("is_end").withColumn("in_thread", F.lit(False))
    return deduplicated(rows.where("NOT is_end")).unionByName(ends)


def max_depth(spans: DataFrame) -> DataFrame:
    return spans.where("in_thread").groupBy(*THREAD).agg(F.max("depth").alias("max_depth"))


def bounds(spans: DataFrame) -> DataFrame:
    return spans.where("NOT is_end").agg(F.min("ts").alias("min_ts"), F.max(F.when(F.col("dur") > 0, F.col("end_ts")).otherwise(F.col("ts"))).alias("max_ts"))


def categories(events: DataFrame) -> DataFrame:
    return events.select("category").distinct().orderBy("category")


def name_index(spans: DataFrame) -> DataFrame:
    """(name, n, event_id) of the timed events in order of start within their name."""
    timed = spans.where("dur > 0 AND phase <> 'C' AND NOT is_end").select("name", "ts", "event_id")
    return placed(timed, "name").select("name", "n", "event_id")


def counter_bounds(counters: DataFrame) -> DataFrame:
    return counters.groupBy("pid", "name").agg(F.count("*").alias("points"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
