"""The probing queries over every event, against plain loops."""

from spanframe import queries

DATA = "/root/testdata/sf0.001"


def test_counters_are_asked_for_every_event(spark):
    t = queries._trace(spark, DATA)
    points = {}
    for c in t.counters.collect():
        points.setdefault((c["pid"], c["name"]), []).append((c["ts"], c["value"]))
    want = set()
    for e in t.events.collect():
        last = max((p for p in points.get((e["pid"], e["name"]), []) if p[0] <= e["ts"] + 1800000000.0), default=(None, None))
        want.add((e["event_id"], *last))
    got = queries.queries()["j3_counter_asof"](spark, DATA).collect()
    assert len(got) == len(want) == t.events.count() and set(map(tuple, got)) == want


def test_spans_are_asked_for_every_span(spark):
    spans = queries._spans(spark, DATA).where("in_thread").select("pid", "tid", "depth", "ts", "end_ts", "dur", "seq", "event_id").collect()
    want = set()
    for key in {(s["pid"], s["tid"], s["depth"], s["ts"] + 60_000_000) for s in spans}:
        there = [(s["dur"], s["seq"], s["event_id"]) for s in spans if (s["pid"], s["tid"], s["depth"]) == key[:3] and s["ts"] - 1000 <= key[3] <= s["end_ts"] + 1000]
        want.add((*key, min(there)[2] if there else None))
    got = queries.queries()["j6_span_at"](spark, DATA).select("pid", "tid", "depth", "t", "event_id").collect()
    assert len(got) == len(want) > 900 and set(map(tuple, got)) == want
