"""Spans at a point: no side is sent whole to the driver and the executors, and whatever way a probe takes finds what plain loops find."""

import random

import pytest

from spanframe import queries
from spanframe.operators import joins
from spanframe.plans import pieces

DATA = "/root/testdata/sf0.001"
SPAN = "pid long, tid long, depth int, event_id long, ts double, end_ts double, dur double, seq long, in_thread boolean, category string"
PROBE = "pid long, tid long, depth int, t double"


def plans_of(spark, run) -> list[str]:
    """The plans of all that ``run`` executes, as they ended."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {(e := store.executionsList().apply(k)).executionId(): e for k in range(store.executionsList().size())}
    old = ids()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return [e.physicalPlanDescription() for k, e in ids().items() if k not in old]


def test_probes_and_spans_are_not_broadcast(spark):
    """With cells they are many times what Spark takes them for."""
    plans = plans_of(spark, lambda: queries.queries()["j6_span_at"](spark, DATA).collect())
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_cells_are_few_and_not_broadcast(spark):
    """Spans of 41 powers of two over each other, which only cells tell apart: a probe looks into 11 at most."""
    spans = spark.range(41).selectExpr("1L AS pid", "1L AS tid", "0 AS depth", "id AS event_id", "0D AS ts", "pow(2D, id - 10) AS end_ts", "pow(2D, id - 10) AS dur", "id AS seq", "true AS in_thread")
    found = joins.span_at(spans, spark.createDataFrame([(1, 1, 0, 3.0)], PROBE))
    levels = found._jdf.queryExecution().analyzed().toString().split("explode(cast(array(")[1].split(")")[0]
    assert 2 <= len(levels.split(",")) <= 11
    plans = plans_of(spark, lambda: found.collect())
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]
    assert [r["event_id"] for r in found.collect()] == [12]


def _plainly(spans, probes, tolerance, hidden=()):
    found = []
    for p in probes:
        there = [] if None in p[:4] else [(s[6], s[7], s[3]) for s in spans if s[8] and s[9] not in hidden and s[:3] == p[:3] and s[4] - tolerance <= p[3] <= s[5] + tolerance]
        found.append((*p, min(there)[2] if there else None))
    return sorted(map(repr, found))


@pytest.mark.parametrize("piece", [None, 20])
def test_overlapping_spans_of_all_lengths(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(pieces, "PIECE_ROWS", piece)
    rng = random.Random(5)
    spans = []
    for k in range(400):
        length = rng.choice([0.0, -3.0, 16.0 ** rng.randrange(-2, 6), 16.0 ** rng.uniform(-2, 6), float(rng.randrange(40))])
        at = rng.choice([float(rng.randrange(-3000, 3000)), 4096.0 * rng.randrange(-3, 4), rng.uniform(-1e6, 1e6)])
        spans.append((1, k % 3, k % 2, k, at, at + length, length, rng.randrange(10**6), k % 7 > 0, "cd"[k % 5 > 0]))
    df = spark.createDataFrame([*spans, (None, 1, 0, 500, 0.0, 9.0, 9.0, 1, True, "d"), (1, 1, 0, 501, None, None, None, 1, True, "d")], SPAN)
    probes = [(1, tid, depth, t) for tid in range(4) for depth in range(2) for t in [s[4] for s in spans[::9]] + [s[5] for s in spans[::7]] + [rng.uniform(-4000, 4000) for _ in range(30)]]
    probes += [(None, 1, 0, 5.0), (1, 1, None, 5.0), (1, 1, 0, None), (1, 1, 0, -0.0)] + probes[:5]  # unknown places, and some asked for twice
    asked = spark.createDataFrame(probes, PROBE)
    for tolerance in (0.0, 0.5, 1000.0):
        assert sorted(map(repr, map(tuple, joins.span_at(df, asked, tolerance).collect()))) == _plainly(spans, probes, tolerance)
    assert sorted(map(repr, map(tuple, joins.span_at(df, asked, 0.5, ["c"]).collect()))) == _plainly(spans, probes, 0.5, ["c"])
    assert joins.span_at(df.where("false"), asked).where("event_id IS NULL").count() == len(probes)


@pytest.mark.parametrize("piece", [None, 20])
def test_spans_that_meet(spark, monkeypatch, piece):
    """One after the other, with and without a gap, and spans without a length between them: most probes need no cells."""
    if piece:
        monkeypatch.setattr(pieces, "PIECE_ROWS", piece)
    spans, at = [], 0.0
    for k in range(150):
        length = [40.0, 0.0, 3.0, 7.0][k % 4]
        spans.append((1, 1, 0, k, at, at + length, length, k, True, "c"))
        at += length + [0.0, 5.0, 100.0][k % 3]
    probes = [(1, 1, 0, t + d, n) for n, (t, d) in enumerate((s[c], d) for s in spans for c in (4, 5) for d in (-10.0, -1.0, 0.0, 1.0, 10.0))]
    asked = spark.createDataFrame(probes, PROBE + ", n long")
    for tolerance in (0.0, 2.0, 30.0):
        found = joins.span_at(spark.createDataFrame(spans, SPAN), asked, tolerance)
        assert found.columns == ["pid", "tid", "depth", "t", "n", "event_id"]
        assert sorted(map(repr, map(tuple, found.collect()))) == _plainly(spans, probes, tolerance)
    whole = joins.span_at(spark.createDataFrame(spans, SPAN), asked.selectExpr("CAST(pid AS int) AS pid", "tid", "depth", "CAST(t AS long) AS t"))
    assert dict(whole.dtypes) == {"pid": "int", "tid": "bigint", "depth": "int", "t": "bigint", "event_id": "bigint"}
