"""Written traces and tables, stored blocks, hot series and islands in pieces, and args of any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanframe.functions import columns
from spanframe.operators import counters, filters, joins, lod, ranges, tree
from spanframe.plans import pieces, scratch, sqlapi
from spanframe.plans import spans as plan
from spanframe.sources import sinks, spanstore, synth, trace_json
from test_trace import events


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


@pytest.mark.parametrize("one_file", [True, False])
def test_written_traces_are_json(spark, tmp_path, one_file):
    rows = [(f'n"{k}\\', "XCiX"[k % 4], k, 1.5) for k in range(60)]
    sinks.write_trace(events(spark, rows).repartition(5), str(tmp_path / "t"), one_file=one_file)
    found = json.loads(text_of(tmp_path / "t"))
    assert found["displayTimeUnit"] == "us" and [e["name"] for e in found["traceEvents"]] == [r[0] for r in rows if r[1] in "XC"]
    assert len(list((tmp_path / "t").glob("part-*"))) == 1 or not one_file
    if one_file:
        assert trace_json.read_trace(spark, str(tmp_path / "t")).events.count() == 45
    sinks.write_trace(events(spark, []), str(tmp_path / "none"))
    assert json.loads(text_of(tmp_path / "none")) == {"traceEvents": [], "displayTimeUnit": "us"}


def test_tables_have_their_header(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b'), (2, None)], "k long, `x,y` string")
    sinks.export(df, str(tmp_path / "c"), one_file=True)
    assert text_of(tmp_path / "c") == 'k,"x,y"\n1,"a,""b"\n2,NULL\n'
    sinks.export(df, str(tmp_path / "t"), "\t")
    assert text_of(tmp_path / "t") == 'k\tx,y\n1\ta,"b\n2\tNULL\n'


def test_args_are_encoded_as_by_c(spark):
    rng = random.Random(6)
    numbers = [0.0, 1.0, -1.5, 100000.0, 1e6, 123456789.0, 0.0001, 0.00001234, 1 / 3, -2e-10, 1e300, 999999.5, float("nan"), float("inf"), None] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9) for _ in range(200)]
    df = spark.createDataFrame([(x, 'a"\n\\', 7, True) for x in numbers], "x double, s string, n long, b boolean")
    got = [r[0] for r in df.select(sinks.args_json(df, "x", "s", "n", "b")).collect()]
    for x, text in zip(numbers, got):
        told = "null" if x is None or x != x or abs(x) == float("inf") else "%.6g" % x
        assert text.startswith(f'{{"x":{told},') and json.loads(text) | {"x": 0} == {"x": 0, "s": 'a"\n\\', "n": 7, "b": True}


def test_stored_views_read_a_fraction(spark, tmp_path):
    rng = random.Random(2)
    rows = [("a", "X", k, rng.choice([0, 1, 5, 30]), 1 + k % 3, k % 7) for k in range(4000)] + [("long", "X", 0, 5000, 1, 99)]
    spans = plan.thread_spans(events(spark, rows))
    store = spanstore.write_spans(spans, str(tmp_path / "s"), 200)
    for of in ({}, {"pid": 2}, {"pid": 1, "tid": 99}):
        view = spanstore.read_spans(spark, str(tmp_path / "s")).overlapping(1000.0, 1020.0, **of)
        want = filters.overlapping(spans, 1000.0, 1020.0)
        for c, v in of.items():
            want = want.where(F.col(c) == v)
        assert {r["event_id"] for r in view.collect()} == {r["event_id"] for r in want.collect()} and want.count()
        assert 0 < store.near(1000.0, 1020.0, of.get("pid")).count() < store.blocks.count() / 2 and store.blocks.count() > 15
        assert "PartitionFilters: [block#" in view._jdf.queryExecution().toString() and "PushedFilters: [IsNotNull(ts)" in view._jdf.queryExecution().toString()
    assert spanstore.write_spans(spans.limit(0), str(tmp_path / "none")).overlapping(0.0, 9.0).count() == 0


@pytest.fixture
def both(monkeypatch):
    """Runs a question with whole keys and with keys cut into pieces; the answers are the same."""

    def ask(question):
        whole = sorted(map(repr, question().collect()))
        monkeypatch.setattr(pieces, "PIECE_ROWS", 20)
        cut = sorted(map(repr, question().collect()))
        monkeypatch.undo()
        assert cut == whole and whole
        return whole

    return ask


def test_hot_series_islands_and_siblings_in_pieces(spark, both):
    rng = random.Random(12)
    points = spark.createDataFrame([(1, "m", float(rng.randrange(400)), float(k)) for k in range(300)] + [(1, "late", 390.0, 1.0)], "pid long, name string, ts double, value double")
    probes = spark.createDataFrame([(1, rng.choice(["m", "late"]), rng.randrange(-5, 450) + rng.choice([0.0, 0.5])) for _ in range(300)], "pid long, name string, t double")
    both(lambda: joins.counter_asof(points, probes.distinct()))
    spans = plan.build_spans(events(spark, [(rng.choice("ab"), "X", k, rng.choice([1, 1, 2, 40])) for k in range(300)] + [("root", "X", 0, 400)]))
    both(lambda: lod.timeline_lod(spans, 0.0, 400.0, 300))
    both(lambda: tree.consolidate_runs(spans, 300))
    both(lambda: tree.with_navigation(spans).select("event_id", "prev_sibling", "next_sibling", "longest_child"))


def test_intervals_of_all_lengths(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("f", "X", rng.randrange(1000), 10 ** rng.uniform(-2, 4), 1, k % 5) for k in range(300)]
    spans = plan.thread_spans(events(spark, rows))
    asked = [(k, float(a), float(a + 10 ** rng.uniform(-2, 4))) for k, a in enumerate(rng.randrange(1000) for _ in range(25))] + [(90, 5.0, 1.0), (91, 7.0, 7.0)]
    df = spark.createDataFrame(asked, "range_id long, start double, end double")
    kept = spans.where("in_thread").collect()
    want = {}
    for k, a, b in asked:
        parts = [min(s["end_ts"], b) - max(s["ts"], a) for s in kept]
        parts = [p for p in parts if p > 0]
        if parts:
            want[k] = len(parts), round(sum(parts), 6)
    for few in (10_000, 3):
        monkeypatch.setattr(ranges, "FEW_RANGES", few)
        assert {r["range_id"]: (r["n"], round(r["total"], 6)) for r in ranges.range_stats_many(spans, df).collect()} == want
    s = plan.build_spans(events(spark, rows))
    probes = [(1, tid, depth, float(t)) for tid in range(5) for depth in range(4) for t in rng.sample(range(1100), 20)]
    found = {tuple(r[c] for c in ("pid", "tid", "depth", "t")): r["event_id"] for r in joins.span_at(s, spark.createDataFrame(probes, "pid long, tid long, depth int, t double"), 0.5).collect()}
    kept = s.where("in_thread").collect()
    for p in probes:
        there = [(r["dur"], r["seq"], r["event_id"]) for r in kept if (r["pid"], r["tid"], r["depth"]) == p[:3] and r["ts"] - 0.5 <= p[3] <= r["end_ts"] + 0.5]
        assert found[p] == (min(there)[2] if there else None)


def test_args_of_any_depth_in_one_scan(spark):
    deep = json.dumps({"a": json.loads("[" * 50 + "7" + "]" * 50), "s": 'br[a]ck{"et}s\\"', "n": {"x": None, "y": [{}, []]}})
    df = spark.createDataFrame([(1, deep), (2, None), (3, "no"), (4, "{}"), (5, '{"k": "v"}')], "event_id long, args string")
    rows = columns.explode_args(df)
    want = {(1, "a" + "[0]" * 50, "7"), (1, "s", 'br[a]ck{"et}s\\"'), (1, "n.x", None), (1, "n.y[0]", "{}"), (1, "n.y[1]", "[]"), (5, "k", "v")}
    assert set(map(tuple, rows.collect())) == want
    assert rows._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    assert [r[0] for r in df.orderBy("event_id").select(columns.nesting(F.col("args"))).collect()] == [51, 0, 0, 1, 1]


def test_lines_keys_views_and_caps(spark):
    df = spark.createDataFrame([('{"line":null,"lineno":5}',), ('{"line":"7"}',), ("{}",)], "args string")
    assert [r[0] for r in df.select(columns.source_line(F.col("args"))).collect()] == [None, 7, None]
    e = events(spark, [("x", "X", 1, 1), ("y", "X", 2, 1)]).unionByName(events(spark, [("z", "X", 3, 1)]).withColumn("category", F.lit(None).cast("string")))
    assert [r["name"] for r in filters.visible_categories(e, False).collect()] == ["z"]
    sqlapi.register(trace_json.Trace(e, *trace_json.dimensions(e), trace_json.counters_of(e)))
    told = {(r["view"], r["column"]): (r["is_key"], r["rows"]) for r in sqlapi.describe_views(spark).collect()}
    assert told["events", "event_id"] == (True, 3) and told["threads", "tid"] == (True, 1) and told["counters", "value"] == (False, 0)
    answer = sqlapi.run_sql(spark, "SELECT event_id, args FROM events ORDER BY event_id", cap=2)
    assert answer.truncated and answer.rows.count() == 2 and answer.rows.schema["args"].dataType.simpleString() == "string"
    assert counters.call_rates(e, 1.0).count() == 3


def test_generated_traces_have_counters_and_flows(spark):
    t = synth.generate_trace(spark, 2000)
    by = {r["phase"]: r["count"] for r in t.groupBy("phase").count().collect()}
    assert by["C"] == 4000 and by["s"] == by["f"] == 500 and 600 < by["X"] < 1200
    ids = [r[0] for r in t.select("event_id").collect()]
    assert len(set(ids)) == len(ids)
    points = trace_json.counters_of(t)
    assert {(r["pid"], r["name"]): (r["points"], r["min_value"] >= 0, r["max_value"] <= 100) for r in plan.counter_bounds(points).collect()} == {(p, "counter"): (1000, True, True) for p in range(4)}
    assert joins.flow_edges(t).where("latency > 0").count() == 500


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_folder", lambda spark: str(tmp_path / "app"))
    kept, gone = scratch.saved(spark.range(3), "kept"), scratch.saved(spark.range(4), "gone")
    scratch.unsaved(gone)
    assert kept.count() == 3 and [p.name.split("-")[0] for p in tmp_path.glob("app/*")] == ["kept"]
    scratch.clear(spark)
    assert not list(tmp_path.glob("app"))
