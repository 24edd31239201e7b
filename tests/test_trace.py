"""Ingest, span construction against a stack in plain Python, operators and sinks on small inputs."""

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from spanframe.functions import columns
from spanframe.operators import counters, filters, flame, joins, lod, overview, ranges, tree
from spanframe.plans import spans as plan
from spanframe.plans import sqlapi
from spanframe.sources import sinks, synth, trace_json

SCHEMA = "event_id bigint, name string, category string, phase string, ts double, dur double, pid bigint, tid bigint, id decimal(20,0), args string"


def events(spark, rows):
    """rows: (name, phase, ts, dur) on one thread, or with (pid, tid) after."""
    return spark.createDataFrame([(k, r[0], "c", r[1], float(r[2]), float(r[3]), *(r[4:6] or (1, 1)), Decimal(0), None) for k, r in enumerate(rows)], SCHEMA)


def stack_model(rows):
    """(event id -> dur, depth, parent, self) of the thread list, by the stack rules."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][2], -rows[k][3], k))
    dur, ends, opened = {k: float(rows[k][3]) for k in order}, set(), []
    for k in order:
        if rows[k][1] == "B":
            opened.append(k)
        elif rows[k][1] == "E" and opened:
            b = opened.pop()
            dur[b] = float(rows[k][2] - rows[b][2])
            ends.add(k)
    kept = []
    for k in (k for k in order if k not in ends):
        if kept and rows[kept[-1]][0] == rows[k][0] and rows[kept[-1]][2] == rows[k][2]:
            if dur[k] > dur[kept[-1]]:
                kept[-1] = k
        else:
            kept.append(k)
    stack, out = [], {}
    for k in kept:
        ts = rows[k][2]
        while stack and stack[-1][0] <= ts:
            stack.pop()
        out[k] = [dur[k], len(stack), stack[-1][1] if stack else None]
        if dur[k] > 0:
            stack.append((ts + dur[k], k))
    for k in out:
        end = rows[k][2] + dur[k]
        inner = sum(dur[c] for c in out if out[c][2] == k and dur[c] > 0 and rows[c][2] + dur[c] <= end)
        out[k].append(dur[k] - inner if dur[k] > 0 else 0.0)
    return {k: tuple(v) for k, v in out.items()}


def test_spans_equal_a_stack(spark):
    rng = random.Random(5)
    threads = []
    for t in range(40):
        n = rng.randrange(1, 25)
        threads.append([(rng.choice("ab"), rng.choice("XXXBBEi"), rng.randrange(30), 0) for _ in range(n)])
        threads[-1] = [(a, p, s, rng.choice([0, 1, 3, 8, 20]) if p == "X" else 0) for a, p, s, _ in threads[-1]]
    flat = [(*r, t % 3, t) for t, rows in enumerate(threads) for r in rows]
    got = {r["event_id"]: (r["dur"], r["depth"], r["parent_id"], r["self_time"]) for r in plan.build_spans(events(spark, flat)).where("in_thread").collect()}
    at = 0
    for rows in threads:
        want = {k + at: (d, depth, None if p is None else p + at, own) for k, (d, depth, p, own) in stack_model(rows).items()}
        assert want == {k: v for k, v in got.items() if at <= k < at + len(rows)}
        at += len(rows)


def test_reads_objects_arrays_and_lines(spark, tmp_path):
    rows = [
        {"ph": "M", "name": "process_name", "pid": 1, "tid": 0, "args": {"name": "Browser"}},
        {"ph": "M", "name": "thread_name", "pid": 1, "tid": 5, "args": {"name": "IO"}},
        {"args": {"a": True, "b": [1, {"c": None}]}, "ph": "X", "name": "run", "cat": "x", "ts": 5000, "dur": 2000, "pid": 1, "tid": 5},
        {"ph": "I", "name": "mark", "ts": 6000, "pid": 1, "tid": 5, "id": "0xff"},
        {"args": {"used": 42.5, "free": "7"}, "ph": "C", "name": "Memory", "ts": 100, "pid": 2},
    ]
    shapes = {
        "object": json.dumps({"traceEvents": rows, "other": 1}), "array": json.dumps(rows), "pretty": json.dumps({"traceEvents": rows}, indent=1),
        "lines": '{"traceEvents":[\n' + ",\n".join(map(json.dumps, rows)) + "\n]}\n",
    }
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
        t = trace_json.read_trace(spark, str(tmp_path / name), "ns")
        found = [(r["event_id"], r["name"], r["phase"], r["ts"], r["dur"], int(r["id"])) for r in t.events.orderBy("event_id").collect()]
        assert found == [(0, "run", "X", 5.0, 2.0, 0), (1, "mark", "i", 6.0, 0.0, 255), (2, "Memory", "C", 0.1, 0.0, 0)], name
        assert json.loads(t.events.where("event_id = 0").first()["args"]) == rows[2]["args"]
        assert {(r["pid"], r["name"]) for r in t.processes.collect()} == {(1, "Browser"), (2, "Process 2")}
        assert [(r["pid"], r["tid"], r["name"]) for r in t.threads.collect()] == [(1, 5, "IO")]
        assert {(r["name"], r["value"]) for r in t.counters.collect()} == {("Memory.used", 42.5), ("Memory.free", 7.0)}


def test_ranges_flames_and_probes(spark):
    s = plan.build_spans(events(spark, [("A", "X", 100, 200), ("B", "X", 200, 200), ("A", "X", 500, 100)]))
    assert {r["name"]: (r["n"], r["total"]) for r in ranges.range_stats(s, 250.0, 350.0).collect()} == {"A": (1, 50.0), "B": (1, 100.0)}
    assert ranges.range_stats(s, 700.0, 800.0).count() == 0
    f = plan.build_spans(events(spark, [("main", "X", 0, 100), ("foo", "X", 10, 40), ("bar", "X", 60, 30)]))
    got = {r["path"]: (r["total"], r["self_total"]) for r in flame.flame(f, 0.0, 100.0).collect()}
    assert got == {"main|c": (100.0, 30.0), "main|c > foo|c": (40.0, 40.0), "main|c > bar|c": (30.0, 30.0)}
    assert flame.flame(f, 0.0, 100.0, hide_categories=["c"]).count() == 0
    zoom = {r["path"]: r["share"] for r in flame.flame_zoom(flame.flame(f, 0.0, 100.0), 1, 1, "main|c").collect()}
    assert zoom["main|c > foo|c"] == 0.4
    assert {r["name"] for r in tree.children(f, 0).collect()} == {"foo", "bar"}
    assert [r["name"] for r in tree.call_stack(f, 1).orderBy("level").collect()] == ["main", "foo"]
    probes = spark.createDataFrame([(1, 1, 1, 20.0), (1, 1, 1, 99.0)], "pid bigint, tid bigint, depth int, t double")
    assert {r["t"]: r["event_id"] for r in joins.span_at(f, probes).collect()} == {20.0: 1, 99.0: None}
    assert {r["kind"] for r in lod.timeline_lod(f, 0.0, 100.0, 20).collect()} == {"slice"}


def test_counters(spark):
    points = spark.createDataFrame([(1, "m", 100.0, 5.0), (1, "m", 100.3, 10.0), (1, "m", 100.7, 3.0)], "pid bigint, name string, ts double, value double")
    r = counters.counter_buckets(points, 0.0, 1000.0, 1000).collect()
    assert [(x["min_value"], x["max_value"], x["last_value"], x["points"]) for x in r] == [(3.0, 10.0, 3.0, 3)]
    probes = spark.createDataFrame([(1, "m", 99.0), (1, "m", 100.3), (1, "m", 500.0)], "pid bigint, name string, t double")
    assert {x["t"]: x["value"] for x in joins.counter_asof(points, probes).collect()} == {99.0: None, 100.3: 10.0, 500.0: 3.0}


def test_columns(spark):
    df = spark.createDataFrame([(0.5,), (12.0,), (-1500.0,), (2.5e6,)], "us double")
    assert [r[0] for r in df.select(columns.format_time(F.col("us"))).collect()] == ["500.0 ns", "12.000 us", "-1.500 ms", "2.500 s"]
    a = spark.createDataFrame([('{"file": 3, "src": "x.c", "line": "7", "lineno": 9}',), ('{"line": "no", "lineno": 9}',), (None,)], "args string")
    assert [tuple(r) for r in a.select(columns.source_file(F.col("args")), columns.source_line(F.col("args"))).collect()] == [("x.c", 7), (None, None), (None, None)]
    p = spark.createDataFrame([("c:\\dev\\repo\\lib\\file.cpp",)], "p string")
    assert p.select(columns.remap_source_path(F.col("p"), "C:/dev/", "/mnt/c/dev")).first()[0] == "/mnt/c/dev/repo/lib/file.cpp"


def test_sql_builder_and_sinks(spark, tmp_path):
    e = events(spark, [("a,b", "X", 1, 5), ('q"q', "X", 2, 6), ("z", "X", 3, 0)])
    t = trace_json.Trace(e, *trace_json.dimensions(e), trace_json.counters_of(e))
    sqlapi.register(t)
    assert sqlapi.run_sql(spark, "SELECT nothing FROM events").error
    answer = sqlapi.run_sql(spark, "SELECT * FROM events", cap=2)
    assert answer.truncated and answer.rows.count() == 2 and not sqlapi.run_sql(spark, "SELECT * FROM events", cap=3).truncated
    spec = sqlapi.QuerySpec("events", ["name", ("SUM", "dur", "total")], where=[("dur", ">", 0)], group_by=["name"], having=[("total", ">", 5)], order_by=[("total", False)])
    assert [tuple(r) for r in spec.to_df({"events": e}).collect()] == [('q"q', 6.0)] == [tuple(r) for r in spark.sql(spec.to_sql().replace("HAVING total", "HAVING sum(dur)")).collect()]
    assert {r[0] for r in sinks.csv_lines(e.select("name")).collect()} == {'"a,b"', '"q""q"', "z"}
    sinks.write_trace(e, str(tmp_path / "out"), one_file=True)
    back = trace_json.read_trace(spark, str(tmp_path / "out"))
    assert {r["name"] for r in back.events.collect()} == {"a,b", 'q"q', "z"}
    assert {r["view"]: r["n"] for r in sqlapi.row_counts(t).collect()}["events"] == 3
    assert sqlapi.describe_views(spark).where("view = 'events'").count() > 5


def test_search_overview_and_generator(spark):
    e = events(spark, [("Load", "X", 1, 5), ("reload", "X", 2, 6), ("z", "X", 3, 0)])
    assert filters.search(e, "LOAD").count() == 2 and filters.search(e, "").count() == 0
    assert overview.hot_functions(e).first()["name"] == "reload"
    g = synth.generate(spark, 4000)
    s = plan.build_spans(g)
    assert 0.3 < g.count() / 4000 < 0.6 and s.agg(F.max("depth")).first()[0] == 3


def test_stream(spark, tmp_path):
    from spanframe.streaming import live

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"ph":"X","name":"f","ts":5,"dur":2,"pid":1,"tid":1},\n')
    q = live.hot_functions_live(live.stream_events(spark, str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT name, n FROM live").collect()[0]["n"] == 1


def test_flows_are_paired_by_phase(spark, tmp_path):
    rows = [{"ph": "X", "name": f"x{k}", "ts": k, "dur": 1, "pid": 1, "tid": 1} for k in range(5)]
    rows[1:1] = [{"ph": "s", "name": "f", "ts": 1200, "pid": 1, "tid": 1, "id": 1}]
    rows += [{"ph": "f", "name": "f", "ts": 4500, "pid": 2, "tid": 1, "id": "0x1"}, {"ph": "t", "name": "lone", "ts": 9, "pid": 1, "tid": 1, "id": 7}]
    (tmp_path / "t").write_text(json.dumps({"traceEvents": rows}))
    t = trace_json.read_trace(spark, str(tmp_path / "t"))
    got = [(r["src_event"], r["dst_event_id"], r["latency"]) for r in joins.flow_edges(plan.build_spans(t.events)).collect()]
    assert got == [(1, 6, 3300.0)] and overview.overview(t).first()["flows"] == 2
    joins.FLOW_CHUNK, kept = 2, joins.FLOW_CHUNK
    try:
        many = events(spark, [("f", "s", k, 0) for k in range(9)])
        assert {(r["src_event"], r["dst_event_id"]) for r in joins.flow_edges(many).collect()} == {(k, k + 1) for k in range(8)}
    finally:
        joins.FLOW_CHUNK = kept


def test_places_in_pieces(spark):
    from spanframe.plans.places import placed

    rng = random.Random(2)
    rows = [(k, rng.choice("aab"), float(rng.randrange(30))) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, name string, ts double")
    got = {r["event_id"]: (r["n"], r["prev"], r["next"]) for r in placed(df, "name", piece_rows=17).collect()}
    for name in "ab":
        ids = [k for k, n, _ in sorted(rows, key=lambda r: (r[2], r[0])) if n == name]
        assert all(got[k] == (i + 1, ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None) for i, k in enumerate(ids))
    assert placed(df.limit(0), "name").count() == 0


def test_nested_args_sorts_categories_and_rates(spark):
    e = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}], "s": "[1]"}, "e": [], "t": true}'), (2, None), (3, "no")], "event_id long, args string")
    want = {("a.b[0]", "1"), ("a.b[1].c", None), ("a.s", "[1]"), ("e", "[]"), ("t", "true")}
    assert {(r["key"], r["value"]) for r in columns.explode_args(e).collect()} == want
    s = plan.build_spans(events(spark, [("main", "X", 0, 100), ("b", "X", 10, 40), ("a", "X", 60, 30)]))
    assert [r["name"] for r in tree.sorted_children(tree.children(s, 0), "name", True).collect()] == ["a", "b"]
    assert [r["name"] for r in tree.sorted_children(tree.children_by_name(s, 0), "total").collect()] == ["b", "a"]
    assert filters.visible_categories(s, False).count() == 0 and filters.visible_categories(s, True).count() == 3
    assert [r["event_id"] for r in filters.first_per_name(events(spark, [("x", "X", 1, 1), ("x", "X", 0, 1)])).collect()] == [0]
    meta = spark.createDataFrame([("thread_name", 0.0)], "name string, ts double")
    assert {r["name"] for r in counters.call_rates(events(spark, [("x", "X", 1, 1), ("x", "X", 2, 1)]), 1.0, meta).collect()} == {"x", "thread_name"}
    f = flame.flame(plan.build_spans(events(spark, [("a|c > b", "X", 0, 9), ("a", "X", 20, 9), ("b", "X", 21, 2)])), 0.0, 100.0)
    assert {tuple(k["name"] for k in r["keys"]) for r in flame.flame_zoom(f, 1, 1, [("a", "c")]).collect()} == {("a",), ("a", "b")}
    sqlapi.register(trace_json.Trace(events(spark, [("x", "X", 1, 1)]), *trace_json.dimensions(events(spark, [("x", "X", 1, 1)])), trace_json.counters_of(events(spark, []))))
    assert sqlapi.run_sql(spark, "SELECT raise_error('at run time') FROM events").error
