"""Threads cut into pieces give what whole threads give; trees of great depth stay small."""

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanframe.operators import flame, tree
from spanframe.plans import pieces
from spanframe.plans import spans as plan
from test_trace import SCHEMA, events, stack_model


@pytest.fixture
def small_pieces():
    kept, pieces.PIECE_ROWS = pieces.PIECE_ROWS, 3
    yield
    pieces.PIECE_ROWS = kept


def threads(rng, count, phases, most=40):
    out = []
    for t in range(count):
        rows = [(rng.choice("ab"), rng.choice(phases), rng.randrange(60)) for _ in range(rng.randrange(1, most))]
        out.append([(a, p, s, rng.choice([0, 1, 3, 8, 20, 90]) if p == "X" else 0) for a, p, s in rows])
    return out


@pytest.mark.parametrize("phases", ["XXXBBEi", "BE", "X"])
def test_cut_threads_equal_a_stack(spark, small_pieces, phases):
    lists = threads(random.Random(len(phases)), 30, phases)
    flat = [(*r, t % 3, t) for t, rows in enumerate(lists) for r in rows]
    spans = plan.build_spans(events(spark, flat)).where("in_thread").collect()
    got = {r["event_id"]: (r["dur"], r["depth"], r["parent_id"], r["self_time"]) for r in spans}
    by, at = {r["event_id"]: r for r in spans}, 0
    for rows in lists:
        want = {k + at: (d, depth, None if p is None else p + at, own) for k, (d, depth, p, own) in stack_model(rows).items()}
        assert want == {k: v for k, v in got.items() if at <= k < at + len(rows)}
        below = {k: 0 for k in want}
        for k in want:
            up = want[k][2]
            while up is not None:
                below[up] += 1
                up = want[up][2]
        places = sorted(by[k]["seq"] for k in want)
        for k in want:  # the interval of a span holds all that is under it and nothing else
            assert sum(by[k]["seq"] < s <= by[k]["last_seq"] for s in places) == below[k]
        at += len(rows)


def test_cut_threads_keep_order_and_light_spans(spark, small_pieces):
    lists = threads(random.Random(9), 6, "XBEi")
    df = events(spark, [(*r, 1, t) for t, rows in enumerate(lists) for r in rows])
    cut = sorted(map(tuple, plan.thread_spans(df).select("event_id", "seq", "dur", "is_end", "in_thread").collect()))
    pieces.PIECE_ROWS = 10**6
    assert cut == sorted(map(tuple, plan.thread_spans(df).select("event_id", "seq", "dur", "is_end", "in_thread").collect()))


def test_pieces_follow_density(spark):
    rows = [(k, 1, float(k) if k < 1000 else 1000.0 + (k - 1000) * 1000) for k in range(1200)] + [(5000 + k, 2, 7.0) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, tid long, ts double")
    cut = pieces.cut(df, ["tid"], rows=50)
    sizes = {r[pieces.PIECE]: r["count"] for r in cut.where("tid = 1").groupBy(pieces.PIECE).count().collect()}
    assert sum(sizes.values()) == 1200 and len(sizes) > 4 and {r[0] for r in cut.where("tid = 2").select(pieces.PIECE).collect()} == {pieces.UNCUT}
    order = cut.where("tid = 1").orderBy("ts").select(pieces.PIECE).collect()
    assert [r[0] for r in order] == sorted(r[0] for r in order)
    assert pieces.PIECE not in pieces.cut(df, ["tid"]).columns and pieces.cut(df.limit(0), ["tid"]).count() == 0


def test_deep_nests_are_fast(spark):
    n = 9000
    nest = spark.range(n).select(F.col("id").alias("event_id"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("name"), F.lit("c").alias("category"), F.lit("X").alias("phase"), F.col("id").cast("double").alias("ts"), (F.lit(2.0 * n) - 2 * F.col("id")).alias("dur"), F.lit(1).cast("long").alias("pid"), F.lit(1).cast("long").alias("tid"), F.lit(0).cast("decimal(20,0)").alias("id"), F.lit(None).cast("string").alias("args"))
    plan.build_spans(nest.limit(5)).count()
    began = time.time()
    spans = plan.build_spans(nest)
    assert spans.agg(F.max("depth")).first()[0] == n - 1
    assert time.time() - began < 20  # all paths on all rows took minutes
    assert [r["event_id"] for r in tree.call_stack(spans, 4000).orderBy("level").collect()] == list(range(4001))
    assert tree.children(spans, 100, descendants=True).count() == n - 101


def flames(rows, kept, hidden):
    """Totals by path from the tree of a thread: the rows that count give their time to their own path, others sum their children's."""
    steps = {}
    for k in kept:
        chain, up = [], k
        while up is not None:
            chain.append((rows[up][0], "hid" if rows[up][0] in hidden else "c"))
            up = kept[up][2]
        steps[k] = tuple(s for s in reversed(chain) if s[1] != "hid")
    own, nodes = {}, {steps[k][:n] for k in kept if rows[k][0] not in hidden for n in range(1, len(steps[k]) + 1)}
    for k, (dur, *_) in kept.items():
        if rows[k][0] not in hidden and rows[k][1] in "XB" and dur > 0:
            calls, total = own.get(steps[k], (0, 0.0))
            own[steps[k]] = calls + 1, total + dur
    total = {}
    for node in sorted(nodes, key=len, reverse=True):
        total[node] = own[node][1] if node in own else sum(total[n] for n in nodes if n[:-1] == node)
    return {n: (own.get(n, (0,))[0], t, max(0.0, t - sum(total[m] for m in nodes if m[:-1] == n))) for n, t in total.items() if t > 0}


@pytest.mark.parametrize("hide", [(), ("hid",)])
def test_flames_equal_a_walk(spark, hide):
    rng, flat, want = random.Random(4), [], {}
    for t in range(12):
        rows = [(rng.choice("abcd"), rng.choice("XXXXn"), rng.randrange(40), rng.choice([1, 3, 8, 20, 90])) for _ in range(rng.randrange(1, 40))]
        flat += [(n, "hid" if hide and n in "bd" else "c", p, float(s), float(d), t) for n, p, s, d in rows]
        model = flames(rows, stack_model(rows), set("bd") if hide else set())
        want |= {(t, tuple(n for n, _ in path)): v for path, v in model.items()}
    df = spark.createDataFrame([(k, n, c, p, s, d, 1, t, Decimal(0), None) for k, (n, c, p, s, d, t) in enumerate(flat)], SCHEMA)
    got = flame.flame(plan.build_spans(df), 0.0, 1000.0, hide_categories=list(hide)).collect()
    assert {(r["tid"], tuple(k["name"] for k in r["keys"])): (r["calls"], r["total"], r["self_total"]) for r in got} == want
