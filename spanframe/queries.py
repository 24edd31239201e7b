"""The registered trace queries over the driver's tables, and their SQL.

The trace is derived from the event table by integer arithmetic that all engines agree on; sums of durations stay exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.functions import columns
from spanframe.operators import counters, filters, flame, joins, lod, overview, ranges, tree
from spanframe.plans import spans as plan
from spanframe.plans import scratch, sqlapi
from spanframe.sources import adapter, sinks, spanstore, synth, trace_json

#: The view that range queries take: five days of the trace, in microseconds from its epoch.
START, END = 5 * 86_400_000_000.0, 10 * 86_400_000_000.0


def _trace(spark: SparkSession, d: str) -> trace_json.Trace:
    return adapter.trace_of(spark, d)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapter.events_of(spark, d)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return plan.build_spans(_events(spark, d))


def _light(spark: SparkSession, d: str) -> DataFrame:
    return plan.thread_spans(_events(spark, d))


def _busiest(spans: DataFrame) -> int:
    """The span with the most descendants, the smallest id of equals; -1 if there is none. One row comes to the driver."""
    first = spans.where("in_thread AND last_seq > seq").orderBy(F.desc(F.col("last_seq") - F.col("seq")), "event_id").select("event_id").limit(1).collect()
    return first[0]["event_id"] if first else -1


def hot_functions(spark: SparkSession, d: str) -> DataFrame:
    return overview.hot_functions(_events(spark, d)).withColumn("avg_dur", F.round("avg_dur", 3))


def a2_longest(spark, d):
    return overview.longest_events(_events(spark, d)).select("event_id", "name", "ts", "dur")


def a3_events_per_thread(spark, d):
    t = _trace(spark, d)
    return overview.events_per_thread(t.events, t.processes, t.threads).select("pid", "tid", "process_name", "thread_name", "n")


def a4_categories(spark, d):
    return overview.by_category(_events(spark, d))


def a5_counters(spark, d):
    return overview.counter_summary(_trace(spark, d).counters).withColumn("avg_value", F.round("avg_value", 6))


def a6_range_stats(spark, d):
    r = ranges.range_stats(_light(spark, d), START, END)
    return r.select("name", "n", "total", "min_part", "max_part", F.round("avg_part", 3).alias("avg_part"), F.round("pct", 6).alias("pct"), "longest")


def a7_children_by_name(spark, d):
    s = _spans(spark, d)
    r = tree.sorted_children(tree.children_by_name(s, _busiest(s), descendants=True), "total")
    return r.select("name", "n", "total", F.round("avg", 3).alias("avg"), "min", "max", F.round("pct", 6).alias("pct"), "longest")


def a8_search_stats(spark, d):
    return filters.name_stats(filters.matching(_events(spark, d), "SMALL")).withColumn("avg_dur", F.round("avg_dur", 3))


def a9_flame(spark, d):
    return flame.flame(_spans(spark, d), START, END).drop("keys")


def a9_flame_hidden(spark, d):
    return flame.flame(_spans(spark, d), START, END, hide_categories=["small"]).drop("keys")


def a10_flame_zoom(spark, d):
    nodes = flame.flame(_spans(spark, d), START, END)
    top = nodes.where("level = 1").orderBy(F.desc("total"), "pid", "tid", "path").limit(1).collect()
    pid, tid, keys = (top[0]["pid"], top[0]["tid"], [tuple(k) for k in top[0]["keys"]]) if top else (0, 0, [("", "")])
    return flame.flame_zoom(nodes, pid, tid, keys).select("pid", "tid", "path", "total", F.round("share", 6).alias("share"), F.round("avg", 3).alias("avg"))


def a11_call_rates(spark, d):
    return counters.call_rates(_events(spark, d), 0.0001).withColumn("rate", F.round("rate", 9))


def a12_runs(spark, d):
    s = _spans(spark, d)
    r = tree.consolidate_runs(s, _busiest(s))
    return r.select("first_event", "name", "depth", "n", "total", "total_self", F.round("avg", 3).alias("avg"), F.round("avg_self", 3).alias("avg_self"))


def a13_overview(spark, d):
    t = _trace(spark, d)
    return overview.overview(trace_json.Trace(adapter.with_flows(t.events), t.processes, t.threads, t.counters))


BUILT = sqlapi.QuerySpec(
    "events", select=["name", "category", ("COUNT", "event_id", "n"), ("SUM", "dur", "total"), ("MAX", "ts", "last_ts")],
    where=[("dur", ">", 1000), ("name", "LIKE", "%I%", "AND"), ("category", "IN", ["small"], "OR")], group_by=["name", "category"], having=[("n", ">", 5)], order_by=[("total", False)], limit=20,
)


def a14_builder(spark, d):
    return BUILT.to_df({"events": _events(spark, d)})


def a15_row_counts(spark, d):
    return sqlapi.row_counts(_trace(spark, d))


def b1_thread_order(spark, d):
    return plan.ordered(_events(spark, d)).select("event_id", "seq")


def b2_pairs(spark, d):
    rows = plan.paired(plan.ordered(adapter.begin_end(_events(spark, d))))
    return rows.where("NOT is_end").select("event_id", "phase", "ts", "dur")


def b4_dedup(spark, d):
    hours = _events(spark, d).withColumn("ts", F.floor(F.col("ts") / 86_400_000_000) * 86_400_000_000.0).withColumn("name", F.substring("name", 1, 1))
    return plan.deduplicated(plan.ordered(hours)).where("in_thread").select("event_id", "name", "ts", "dur")


def b5_spans(spark, d):
    return _spans(spark, d).select("event_id", "seq", "depth", "parent_id", "self_time", "child_time", F.round("self_pct", 6).alias("self_pct"))


def b6_max_depth(spark, d):
    return plan.max_depth(_spans(spark, d))


def b8_call_stack(spark, d):
    s = _spans(spark, d)
    deepest = s.where("in_thread").orderBy(F.desc("depth"), "event_id").select("event_id").limit(1).collect()
    return tree.call_stack(s, deepest[0]["event_id"] if deepest else -1)


def b11_bounds(spark, d):
    return plan.bounds(_light(spark, d))


def b12_categories(spark, d):
    return plan.categories(_events(spark, d))


def b13_name_index(spark, d):
    return plan.name_index(_light(spark, d))


def b14_counter_bounds(spark, d):
    return plan.counter_bounds(_trace(spark, d).counters)


def p1_visible(spark, d):
    return filters.visible(_events(spark, d), hide_pids=[1], hide_tids=[2], hide_categories=["small"]).select("event_id")


def p3_thread_counts(spark, d):
    return filters.thread_counts(_light(spark, d), _trace(spark, d).threads)


def p4_search(spark, d):
    return filters.search(_events(spark, d), "Li", unique=False).select("event_id", "name", "n", "total_dur")


def p6_overlapping(spark, d):
    return filters.overlapping(_light(spark, d), START, END).select("event_id")


def p6_stored_view(spark, d):
    """The spans of an hour and of an hour of one process, from stored blocks."""
    store = spanstore.write_spans(_light(spark, d), scratch.new_path(spark, "spans"), 500)
    hour = lambda **of: store.overlapping(START, START + 3.6e9, **of)
    return hour().select("event_id", F.lit("all").alias("of")).unionByName(hour(pid=1).select("event_id", F.lit("one").alias("of")))


def j3_counter_asof(spark, d):
    t = _trace(spark, d)
    probes = t.events.select("event_id", "pid", "name", (F.col("ts") + 1800000000.0).alias("t"))
    return joins.counter_asof(t.counters, probes).select("event_id", "point_ts", "value")


def j4_flow_edges(spark, d):
    edges = joins.flow_edges(adapter.with_flows(_events(spark, d)), START, END, hide_tids=[3])
    return edges.select("flow_id", "src_event", "dst_event_id", "latency").withColumn("flow_id", F.col("flow_id").cast("long"))


def j4_flow_one_id(spark, d):
    """Flow edges where all flow events lack an id: one flow holds them all."""
    edges = joins.flow_edges(adapter.with_flows(_events(spark, d)).withColumn("id", F.lit(0).cast("decimal(20,0)")))
    return edges.select("src_event", "dst_event_id", "latency")


def j6_span_at(spark, d):
    s = plan.build_spans(_events(spark, d).drop("id", "args")).where("in_thread")
    s = scratch.saved(s.select("pid", "tid", "depth", "event_id", "ts", "end_ts", "dur", "seq", "in_thread"), "spans")
    probes = s.select("pid", "tid", "depth", (F.col("ts") + 60_000_000).alias("t")).distinct()
    return joins.span_at(s, scratch.saved(probes, "probes"), 1000.0)  # both are read more than once


def j7_children(spark, d):
    s = _spans(spark, d)
    top = s.where("parent_id IS NOT NULL").select("parent_id", "event_id", "dur", "end_ts")
    up = s.select(F.col("event_id").alias("parent_id"), F.col("dur").alias("p_dur"), F.col("end_ts").alias("p_end"))
    return top.join(up, "parent_id").where("dur > 0 AND end_ts <= p_end").select("parent_id", "event_id", F.round(F.try_divide(F.col("dur") * 100, F.col("p_dur")), 6).alias("pct"))


def j8_range_stats_many(spark, d):
    days = spark.range(1, 20).select(F.col("id").alias("range_id"), (F.col("id") * 86_400_000_000.0).alias("start"), ((F.col("id") + 2) * 86_400_000_000.0).alias("end"))
    r = ranges.range_stats_many(_light(spark, d), days)
    return r.select("range_id", "name", "n", "total", "min_part", "max_part", "longest")


def w1_unique(spark, d):
    return filters.first_per_name(_events(spark, d)).select("event_id", "name")


def w2_longest_instance(spark, d):
    return tree.longest_instance(_light(spark, d))


def w3_navigation(spark, d):
    return tree.with_navigation(_spans(spark, d)).select("event_id", "prev_sibling", "next_sibling", "longest_child")


def w5_instances(spark, d):
    return tree.instances(_light(spark, d), "click").select("event_id", "n", "prev", "next", "dur")


def q1_sql(spark, d):
    t = _trace(spark, d)
    sqlapi.register(t)
    text = """SELECT p.name AS process, e.category, count(*) AS n, sum(e.dur) AS total FROM events e JOIN threads t ON e.pid = t.pid AND e.tid = t.tid
      JOIN processes p ON e.pid = p.pid WHERE e.dur > (SELECT avg(dur) FROM events) GROUP BY p.name, e.category"""
    return sqlapi.run_sql(spark, text, cap=None).rows


def d1_counter_buckets(spark, d):
    return counters.counter_buckets(_trace(spark, d).counters, START, END, 100)


def d2_timeline_lod(spark, d):
    r = lod.timeline_lod(_spans(spark, d), START, END, 2000)
    return r.select("pid", "tid", "depth", "kind", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"), "n", "event_id")


def s9_arg_counters(spark, d):
    asked = _events(spark, d).withColumn("phase", F.lit("C"))
    return trace_json.counters_of(asked).groupBy("pid", "name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def s13_csv(spark, d):
    return sinks.csv_lines(_events(spark, d).select("event_id", "name", "args"))


def s14_trace_json(spark, d):
    lines = sinks.trace_lines(_events(spark, d))
    parsed = F.from_json("value", "name string, cat string, ph string, ts double, dur double, pid bigint, tid bigint, args map<string,double>")
    return lines.select(parsed.alias("e")).select("e.name", "e.ts", "e.dur", "e.pid", "e.tid", F.col("e.args")["k"].alias("k"))


def x1_format_time(spark, d):
    """Numbers of all sizes; a quarter is added so that none lies half way between two roundings."""
    scaled = _events(spark, d).select("event_id", (F.floor(F.col("dur") / F.pow(F.lit(10.0), F.pmod("event_id", F.lit(12)))) + 0.25).alias("us"))
    return scaled.select("event_id", columns.format_time(F.col("us")).alias("told"))


def x2_source(spark, d):
    args = F.to_json(F.struct(F.concat(F.lit("C:\\Src\\f"), F.col("tid").cast("string"), F.lit(".py")).alias("src_file"), F.col("pid").alias("lineNumber")))
    return columns.with_source(_events(spark, d).withColumn("args", args), "c:/src/", "/mnt/code/").select("event_id", "source_file", "source_line")


def x3_remap_urls(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", columns.remap_source_path(F.col("url"), "HTTPS://", "/mirror").alias("path"))


def x4_args(spark, d):
    return columns.explode_args(_events(spark, d))


def x4_nested_args(spark, d):
    """Args nested in objects and arrays."""
    nested = F.to_json(F.struct(F.struct(F.col("tid").alias("t"), F.array("name", "category").alias("texts")).alias("a"), F.array(F.struct(F.col("pid").alias("p"))).alias("b")))
    return columns.explode_args(_events(spark, d).withColumn("args", nested))


def _json(t: DataFrame, *more) -> DataFrame:
    """Events as JSON text, with metadata and flow ids as a trace file has them."""
    return t.select("event_id", F.to_json(F.struct("name", F.col("category").alias("cat"), F.col("phase").alias("ph"), "ts", "dur", "pid", "tid", F.concat(F.lit("0x"), F.hex("tid")).alias("id"), *more)).alias("value"))


def s2_read_array(spark, d):
    """Array traces, one of them with brackets on the lines of events and two events on a line; times in nanoseconds."""
    path = scratch.new_path(spark, "array")
    lines = _json(_events(spark, d)).groupBy(F.floor(F.col("event_id") / 2).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))
    thread = lines.groupBy(F.pmod("k", F.lit(64)).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ",\n"), F.lit("]")).alias("value"))
    thread.repartition(8, "file").select("value").write.option("lineSep", "\n").text(path)  # several arrays to a file, so files are read line by line
    events = trace_json.read_trace(spark, path, time_unit="ns").events
    return events.select("name", "category", "ts", "dur", "pid", "tid", F.col("id").cast("long").alias("id"))


def s8_metadata(spark, d):
    """Names from metadata events; the last name of a thread holds."""
    path = scratch.new_path(spark, "metadata")
    e = _events(spark, d)
    meta = lambda name, n: F.to_json(F.struct(F.lit("M").alias("ph"), F.lit(name).alias("name"), "pid", "tid", F.struct(n.alias("name")).alias("args")))
    named = e.select("pid", "tid").distinct().select(F.array(meta("process_name", F.concat(F.lit("proc "), F.col("pid").cast("string"))), meta("thread_name", F.lit("first")), meta("thread_name", F.concat(F.lit("of "), F.col("tid").cast("string")))).alias("m"))
    named.select(F.array_join("m", ",\n").alias("value")).write.text(path)
    t = trace_json.read_trace(spark, path)
    return joins.with_names(t.threads.select("pid", "tid"), t.processes, t.threads)


def s10_ordinals(spark, d):
    """Each event's place in a trace of several files."""
    path = scratch.new_path(spark, "ordinals")
    _json(_events(spark, d), F.struct("event_id").alias("args")).repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    events = trace_json.read_trace(spark, path).events
    return events.select(F.col("event_id").alias("place"), F.get_json_object("args", "$.event_id").cast("long").alias("event_id"))


def s13_tsv(spark, d):
    """The lines of a TSV, its header among them."""
    path = scratch.new_path(spark, "tsv")
    sinks.export(_events(spark, d).select("event_id", "name", "args"), path, "\t")
    return spark.read.text(path)


def s14_trace_file(spark, d):
    """A trace in its envelope as one file, with counters among its events, read back with its places."""
    path = scratch.new_path(spark, "written")
    e = _events(spark, d)
    points = e.select((F.col("event_id") + 1_000_000_000).alias("event_id"), "name", "category", F.lit("C").alias("phase"), "ts", F.lit(0.0).alias("dur"), "pid", "tid", "id", F.col("dur").alias("value"))
    points = points.withColumn("args", sinks.args_json(points, "value", "name")).drop("value")
    sinks.write_trace(e.unionByName(points), path, one_file=True)
    back = trace_json.read_trace(spark, path).events
    arg = lambda k: F.get_json_object("args", f"$.{k}")
    return back.select("event_id", "name", "phase", "ts", "dur", "pid", "tid", arg("k").cast("double").alias("k"), arg("value").cast("double").alias("value"), arg("name").alias("arg_name"))


def q2_schema(spark, d):
    """The views' columns, types, keys and row counts."""
    sqlapi.register(_trace(spark, d))
    return sqlapi.describe_views(spark).select("view", "column", "type", "is_key", "rows")


def l2_row_cap(spark, d):
    """The row cap: at most so many rows, and whether there are more."""
    sqlapi.register(_trace(spark, d))
    answer = sqlapi.run_sql(spark, "SELECT event_id, name FROM events ORDER BY event_id", cap=100)
    return answer.rows.withColumn("truncated", F.lit(answer.truncated))


def _ranked(rows: DataFrame, *columns: str) -> DataFrame:
    """Sorted rows with their place, to show the order."""
    return rows.limit(50).withColumn("_at", F.monotonically_increasing_id()).select(*columns, F.row_number().over(Window.orderBy("_at")).alias("place"))


def l3_search_sort(spark, d):
    """The first 50 matches by duration, the longest first."""
    return _ranked(filters.search(_events(spark, d), "li", sort_by="dur", ascending=False), "event_id", "name", "dur")


def l4_instance_sort(spark, d):
    """The first 50 instances of a name, by duration."""
    return _ranked(tree.instances(_light(spark, d), "click"), "event_id", "dur", "n")


def l5_children_sort(spark, d):
    """The first 50 descendants of the span that has most, by share."""
    s = _spans(spark, d)
    return _ranked(tree.sorted_children(tree.children(s, _busiest(s), descendants=True), "pct"), "event_id", "dur")


def p2_categories(spark, d):
    """How many events are left when all categories are hidden, and when all are shown."""
    e = _events(spark, d)
    hidden = plan.categories(e)
    count = lambda show: filters.visible_categories(e, show, hidden).agg(F.count("*").alias("n")).select(F.lit(show).alias("show"), "n")
    return count(True).unionByName(count(False))


def a11_metadata(spark, d):
    """Call rates where metadata rows count too."""
    e = _events(spark, d)
    meta = e.select(F.lit("thread_name").alias("name"), F.lit(0.0).alias("ts"), "pid", "tid")
    return counters.call_rates(e, 0.0001, meta).withColumn("rate", F.round("rate", 9))


def j7_descendants(spark, d):
    """All descendants of the span that has most."""
    s = _spans(spark, d)
    return tree.children(s, _busiest(s), descendants=True).select("event_id", F.round("pct", 6).alias("pct"))


def s1_read_trace(spark, d):
    path = scratch.new_path(spark, "trace")
    sinks.write_trace(_events(spark, d), path, envelope=False)
    events = trace_json.read_trace(spark, path).events
    return events.select("name", "category", "phase", "ts", "dur", "pid", "tid", F.get_json_object("args", "$.k").cast("double").alias("k"))


def s1_read_object(spark, d):
    """Object traces on one line each, a file holding several, with nested metadata before and after the events and elements that are none."""
    path = scratch.new_path(spark, "object")
    lines = _json(_events(spark, d)).groupBy(F.floor(F.col("event_id") / 500).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("value"))
    head, tail = '{"otherData":{"version":"1","a":[{"ph":"X"}]},"displayTimeUnit":"ms","traceEvents":[5,', ',"}{"],"stackFrames":{"1":{"name":"traceEvents"}}}'
    lines.select(F.concat(F.lit(head), "value", F.lit(tail)).alias("value")).write.text(path)
    events = trace_json.read_trace(spark, path).events
    return events.select("name", "category", "ts", "dur", "pid", "tid", F.col("id").cast("long").alias("id"))


def s11_generated(spark, d):
    """Counter points, and flows that arrive later than they leave, of a generated trace as large as the event table."""
    rows = _events(spark, d).count()
    made = synth.generate_trace(spark, rows, counter_points=rows // 50, flows=rows // 10)
    points = trace_json.counters_of(made).groupBy("pid").agg(F.count("*").alias("n")).select(F.concat(F.lit("counter of "), F.col("pid").cast("string")).alias("what"), "n")
    edges = joins.flow_edges(made).where("latency > 0 AND src_event + 1 = dst_event_id").agg(F.count("*").alias("n")).select(F.lit("flows").alias("what"), "n")
    return points.unionByName(edges)


def b10_thread_order(spark, d):
    t = _trace(spark, d)
    return overview.thread_order(t.processes, t.threads)


def j2_names(spark, d):
    t = _trace(spark, d)
    return joins.with_names(t.events, t.processes, t.threads).select("event_id", "process_name", "thread_name")


def p7_children_filtered(spark, d):
    s = _spans(spark, d)
    return tree.children(s, _busiest(s), descendants=True, text="IC").select("event_id", "name", F.round("pct", 6).alias("pct"))


def q3_builder_sql(spark, d):
    t = _trace(spark, d)
    sqlapi.register(t)
    spec = sqlapi.QuerySpec("events", select=["name", ("COUNT", "event_id", "n"), ("MIN", "dur", "least")], where=[("dur", ">=", 1000), ("category", "IN", ["small", "large"], "AND")], group_by=["name"], having=[("n", ">", 5)], order_by=[("n", False), ("name", True)])
    return sqlapi.run_sql(spark, spec.to_sql()).rows


def w6_first_instances(spark, d):
    return tree.first_instances(_events(spark, d))


REGISTERED = [
    hot_functions, a2_longest, a3_events_per_thread, a4_categories, a5_counters, a6_range_stats, a7_children_by_name, a8_search_stats, a9_flame, a9_flame_hidden, a10_flame_zoom,
    a11_call_rates, a12_runs, a13_overview, a14_builder, a15_row_counts, b1_thread_order, b2_pairs, b4_dedup, b5_spans, b6_max_depth, b8_call_stack, b11_bounds, b12_categories,
    b13_name_index, b14_counter_bounds, p1_visible, p3_thread_counts, p4_search, p6_overlapping, p6_stored_view, j3_counter_asof, j4_flow_edges, j6_span_at, j7_children, j8_range_stats_many,
    w1_unique, w2_longest_instance, w3_navigation, w5_instances, q1_sql, d1_counter_buckets, d2_timeline_lod, s9_arg_counters, s13_csv, s14_trace_json, s14_trace_file, x1_format_time, x2_source,
    x3_remap_urls, x4_args, s1_read_trace, b10_thread_order, j2_names, p7_children_filtered, q3_builder_sql, w6_first_instances,
    j4_flow_one_id, x4_nested_args, s2_read_array, s8_metadata, s10_ordinals, s1_read_object, s11_generated, s13_tsv, q2_schema, l2_row_cap, l3_search_sort, l4_instance_sort,
    l5_children_sort, p2_categories, a11_metadata, j7_descendants,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def oracle_sql() -> dict[str, str]:
    from spanframe.oracle import oracle_sql as sql

    return sql()
