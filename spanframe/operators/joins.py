"""Names of processes and threads, counters as of a time, flows, spans at a point, many ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.plans.pieces import beside, cut
from spanframe.plans.scratch import saved

#: Processes and threads are sent to all executors up to so many rows; beyond, they are joined by a shuffle.
FEW_ROWS = 100_000
#: Flow events that meet in one window: a flow's events are cut by so many event ids.
FLOW_CHUNK = 1 << 20
#: Span lengths are told apart by every so many-th power of two where probes look for them: a probe looks into a cell of each.
LEVEL_STEP = 4
#: The row of a timeline that a span is drawn in.
PLACE = ["pid", "tid", "depth"]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def with_names(df: DataFrame, processes: DataFrame, threads: DataFrame) -> DataFrame:
    out = df.join(_small(processes.select("pid", F.col("name").alias("process_name"))), "pid", "left")
    return out.join(_small(threads.select("pid", "tid", F.col("name").alias("thread_name"))), ["pid", "tid"], "left")


def counter_asof(counters: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (pid, name, t, ...) with point_ts and value of the last point at or before t; null before the first.

    Points and probes are brought together in order of time, so no probe meets more than its own place; a long series is
    cut into pieces, each of which takes along the last point before it.
    """
    points = counters.select("pid", "name", F.col("ts").alias("_at"), F.lit(0).alias("_kind"), F.struct("ts", "value").alias("_point"))
    asked = probes.select("pid", "name", F.col("t").alias("_at"), F.lit(1).alias("_kind"), F.struct(*probes.columns).alias("_probe"))
    both = cut(points.unionByName(asked, allowMissingColumns=True).withColumn("_value", F.col("_point.value")), ["pid", "name"], "_at")
    found = beside(both, ["pid", "name"], ["_at", "_kind", "_value"], _found=("last", "_point")).where("_kind = 1")
    return found.select("_probe.*", F.col("_found.ts").alias("point_ts"), F.col("_found.value").alias("value"))


def flow_edges(spans: DataFrame, start: float | None = None, end: float | None = None, hide_pids=(), hide_tids=()) -> DataFrame:
    """An edge between consecutive flow events (phases s, t and f) of an id in file order, without those outside a view or at a hidden end.

    Flow events without an id share the id 0, which may hold very many: windows are cut by event id, and the first event
    of the next piece follows the last of a piece.
    """
    end_ts = F.col("end_ts") if "end_ts" in spans.columns else F.col("ts") + F.col("dur")
    flows = spans.where("phase IN ('s', 't', 'f')").select("id", F.floor(F.col("event_id") / FLOW_CHUNK).alias("_piece"), F.struct("event_id", "pid", "tid", "ts", end_ts.alias("end_ts")).alias("e"))
    firsts = flows.groupBy("id", "_piece").agg(F.min("e").alias("first"))
    follows = firsts.select("id", "_piece", F.lead("first").over(Window.partitionBy("id").orderBy("_piece")).alias("follows"))  # a row for each piece
    ahead = flows.withColumn("dst", F.lead("e").over(Window.partitionBy("id", "_piece").orderBy("e"))).join(follows, ["id", "_piece"])
    side = lambda c, fields: [F.col(f"{c}.{f}").alias(f"{c}_{a}") for f, a in fields]
    edges = ahead.select(F.col("id").alias("flow_id"), F.col("e").alias("src"), F.coalesce("dst", "follows").alias("dst")).where("dst IS NOT NULL").select(
        "flow_id", *side("src", (("event_id", "event"), ("pid", "pid"), ("tid", "tid"), ("ts", "ts"), ("end_ts", "end"))), *side("dst", ((x, x) for x in ("event_id", "pid", "tid", "ts", "end_ts")))
    )
    if start is not None and end is not None:
        edges = edges.where(~((F.col("src_ts") > end) & (F.col("dst_ts") > end)) & ~((F.col("src_end") < start) & (F.col("dst_end_ts") < start)))
    for side in ("src", "dst"):
        if hide_pids:
            edges = edges.where(~F.col(f"{side}_pid").isin(*hide_pids))
        if hide_tids:
            edges = edges.where(~F.col(f"{side}_tid").isin(*hide_tids))
    return edges.withColumn("latency", F.col("dst_ts") - F.col("src_end"))


def level_of(length: Column) -> Column:
    """The power of two that a length fits in."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1e-3)))).cast("int")


def cells(low: Column, high: Column, level: Column) -> Column:
    """The cells of 2 ** level that [low, high] touches."""
    size = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low / size), F.floor(high / size))


def span_at(spans: DataFrame, probes: DataFrame, tolerance: float = 0.0, hide_categories=()) -> DataFrame:
    """probes (pid, tid, depth, t, ...) with event_id of the shortest span there, the first of equals; null for none.

    Spans of one depth hardly overlap: the last to start by a probe's time is all there can be if those before it have
    ended. That is told where spans and probes stand in order of time, a long key being cut into pieces. The probes of
    which it doesn't hold, if any, look for their spans by time cell.
    """
    seen = spans.where("in_thread")
    if hide_categories:
        seen = seen.where(~F.col("category").isin(*hide_categories))
    low, high = F.col("ts") - tolerance, F.col("end_ts") + tolerance
    seen = seen.select(*PLACE, "event_id", low.alias("low"), high.alias("high"), "dur", "seq").dropna(subset=[*PLACE, "low", "high"])
    more = [c for c in probes.columns if c not in (*PLACE, "t")]
    starts = seen.select(*PLACE, F.col("low").alias("_at"), F.lit(0).alias("_kind"), F.col("high").alias("_until"), F.col("event_id").alias("_event"))
    asked = probes.select(*PLACE, F.col("t").alias("_at"), F.lit(1).alias("_kind"), *more)
    order = ["_at", "_kind", "_until", "_event"]
    both = beside(cut(starts.unionByName(asked, allowMissingColumns=True), PLACE, "_at"), PLACE, order, _open=("max", "_until"))
    both = beside(both.withColumn("_span", F.when(F.col("_kind") == 0, F.struct("_event", "_until", "_open"))), PLACE, order, _last=("last", "_span"))
    sure = F.coalesce(F.col("_last._open") < F.col("_at"), F.lit(True))
    there = F.when(F.col("_last._until") >= F.col("_at"), F.col("_last._event"))
    asked_as = [F.col(c).cast(probes.schema[name].dataType).alias(name) for c, name in zip([*PLACE, "_at"], [*PLACE, "t"])]
    found = saved(both.where("_kind = 1").select(*asked_as, *more, there.alias("event_id"), sure.alias("_sure")), "spans-at")
    rest = found.where("NOT _sure").drop("_sure", "event_id")
    if not rest.take(1):
        return found.drop("_sure")
    best = _shortest_by_cells(seen, rest.select(*PLACE, "t").distinct())
    return found.where("_sure").drop("_sure").unionByName(rest.join(best.hint("merge"), [*PLACE, "t"], "left"))


def _shortest_by_cells(seen: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (pid, tid, depth, t) that some of ``seen`` (.., low, high) is at, with event_id of the shortest.

    A span's cells are as long as the next of every LEVEL_STEP-th power of two that it fits in, so it touches two at most,
    however long it is; a probe looks into one cell of each length that spans have, of which there are few. Neither side
    may be taken for small by what Spark estimates of it, which leaves out the cells: they are joined by a shuffle.
    """
    seen = seen.withColumn("_level", (F.ceil(level_of(F.col("high") - F.col("low")) / LEVEL_STEP) * LEVEL_STEP).cast("int"))
    levels = sorted(r[0] for r in seen.select("_level").distinct().collect())  # powers of two
    placed = seen.withColumn("_cell", F.explode(cells(F.col("low"), F.col("high"), F.col("_level"))))
    asked = probes.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("_cell", F.floor(F.col("t") / F.pow(F.lit(2.0), F.col("_level"))))
    met = asked.join(placed.hint("merge"), [*PLACE, "_level", "_cell"]).where("low <= t AND t <= high")
    return met.groupBy(*PLACE, "t").agg(F.min_by("event_id", F.struct("dur", "seq")).alias("event_id"))
