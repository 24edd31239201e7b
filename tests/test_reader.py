"""No shape of a trace file loses an event."""

import json
import random

import pandas as pd
import pytest

from spanframe.sources import structure, trace_json


def events(n, rng):
    args = [None, {"a": [1, {"b": "]}"}], "c": "x,\n{"}, {"list": [{}, {"ph": "X"}]}, {}, {"t": True, "s": '"traceEvents":['}]
    return [{"name": f"e{k}", "ph": rng.choice("XXiM"), "ts": k, "pid": 1, "tid": 2} | ({"args": a} if (a := rng.choice(args)) is not None else {}) for k in range(n)]


def names(spark, path, mode="auto"):
    rows = trace_json.numbered(trace_json.read_raw(spark, str(path), mode)).orderBy("event_id").collect()
    return [r["name"] for r in rows if r["ph"] == "M"], [r["name"] for r in rows if r["ph"] != "M"]


def test_shapes(spark, tmp_path):
    rows = events(6, random.Random(1))
    e = [json.dumps(r) for r in rows]
    want = [r["name"] for r in rows if r["ph"] == "M"], [r["name"] for r in rows if r["ph"] != "M"]
    shapes = {
        "array_lines": "[" + ",\n".join(e) + "]", "object_lines": '{"traceEvents":[' + ",\n".join(e) + "]}", "two_on_a_line": "[" + e[0] + "," + e[1] + ",\n" + ",\n".join(e[2:]) + "\n]",
        "pretty": json.dumps(rows, indent=2), "pretty_object": json.dumps({"traceEvents": rows, "x": [1, {"ph": "X"}]}, indent=1), "no_end": "[\n" + ",\n".join(e) + ",\n",
        "keys_around": '{"unit":"ms", "traceEvents":[\n' + ",\n".join(e) + '],"meta":{"a":[{"ph":"X"}]}}', "comma_first": "[\n" + e[0] + "\n," + "\n,".join(e[1:]) + "\n]", "one_line": json.dumps(rows),
        "broken_event": "[" + ",\n".join(e[:3]) + ",\n" + ",\n".join(e[3:]).replace('"ts"', '\n"ts"') + "]", "bare_lines": "\n\n".join(e), "other_array": '{"samples":[\n{"ph":"X"}\n],"traceEvents":[\n' + ",\n".join(e) + "\n]}",
    }
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
        assert names(spark, tmp_path / name) == want, name
    (tmp_path / "bad").write_text('[{"ph":"X"},\n{"ph":')
    with pytest.raises(Exception, match="not a trace"):
        names(spark, tmp_path / "bad")
    (tmp_path / "empty").write_text("")
    assert names(spark, tmp_path / "empty") == ([], [])


def test_random_breaks(spark, tmp_path):
    """White space and line breaks wherever JSON lets them be: each file has what json.loads has."""
    rng, want = random.Random(3), ([], [])
    for k in range(40):
        rows = events(rng.randrange(0, 7), rng)
        text, out, inside = json.dumps(rows if k % 2 else {"traceEvents": rows, "z": 1}), [], False
        for i, c in enumerate(text):
            inside ^= c == '"' and text[i - 1] != "\\"
            out.append(c)
            if not inside and c in "[]{},:" and rng.random() < (0.03, 0.3)[k % 3 == 0]:
                out.append(rng.choice(["\n", " \n ", "\n\n"]))
        (tmp_path / f"f{k:02d}").write_text("".join(out))
        for r in json.loads("".join(out)) if k % 2 else json.loads("".join(out))["traceEvents"]:
            want[r["ph"] != "M"].append(r["name"])
    assert names(spark, tmp_path) == want


FIELDS = {"name", "cat", "ph", "ts", "dur", "pid", "tid", "id", "args"}
ODD = ["", "a", "}", "{", "[", "]", '"', "\\", '\\"', "traceEvents", '"traceEvents":[', "é{", "x,y", "\n", "}}", '{"a":[']


def value(rng, depth=0):
    chance = rng.random()
    if depth > 3 or chance < 0.5:
        return rng.choice([1, 2.5, None, True, rng.choice(ODD), rng.choice(ODD) + rng.choice(ODD)])
    if chance < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(ODD) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}


def event(rng, k):
    more = {"args": {rng.choice(ODD): value(rng) for _ in range(2)}} if rng.random() < 0.4 else {}
    return {"name": rng.choice(ODD) + str(k), "ph": "X", "ts": k} | more


def top(rng, k):
    """A value of a trace file: an array, an object with its events among other keys, an event, or an object that is none."""
    chance = rng.random()
    inside = [event(rng, k * 100 + j) if rng.random() < 0.8 else value(rng, 3) for j in range(rng.randrange(6))]
    if chance < 0.3:
        return inside
    if chance < 0.7:
        items = [(n, value(rng)) for n in rng.sample(["displayTimeUnit", "otherData", "stackFrames", "meta"], rng.randrange(4))]
        items.insert(rng.randrange(len(items) + 1), ("traceEvents", inside))
        return dict(items)
    return event(rng, k) if chance < 0.9 else {"m": value(rng)}


def wanted(values):
    out = []
    for v in values:
        inside = v if isinstance(v, list) else v["traceEvents"] if "traceEvents" in v else [v] * bool(FIELDS & set(v))
        out += [e for e in inside if isinstance(e, dict)]
    return out


def file_of(rng):
    values = [top(rng, k) for k in range(rng.choice([1, 1, 1, 2, 4]))]
    told = [json.dumps(v, indent=rng.choice([None, None, 1]), ensure_ascii=rng.random() < 0.5) for v in values]
    return rng.choice(["", "\n", " "]) + rng.choice([",", "\n", ",\n", " "]).join(told) + rng.choice(["", "\n", ",\n"]), values


def cut_by_hand(text, borders, rng):
    """The events of a text whose rows are dealt to blocks at ``borders``, by the same sums, states and cuts as on a cluster."""
    rows = text.split(b"}")[: -1 if text.endswith(b"}") else None] if text else []
    blocks, b = {}, 0
    for k, row in enumerate(rows):
        b = k if k in borders else b
        blocks.setdefault(b, []).append(row)

    def batches(rows):
        while rows:
            n = rng.choice([1, 2, 5, 100])
            yield b"}".join([*rows[:n], b""])
            rows = rows[n:]

    sums = []
    for b, of in blocks.items():
        both = [structure.Sum(False), structure.Sum(True)]
        for part in batches(of):
            for s in both:
                s.add(part, structure._read(part))
        told = [{"in_string": s.in_string, "depth": s.depth, "low": s.low, "open": [[k, *v] for k, v in s.open.items()], "met": sorted(s.met)} for s in both]
        sums.append(("f", b, len(text), sum(len(r) + 1 for r in of), json.dumps(told)))
    out = []
    for state in structure.composed(pd.DataFrame(sums, columns=["file", "block", "size", "bytes", "sums"])).to_dict("records") if sums else []:
        cutter, parts = structure._Cutter(state), list(batches(blocks[state["block"]]))
        for k, part in enumerate(parts):
            out += cutter.add(part, k == len(parts) - 1)
    events = [(r["owner"], r["n"], r["alone"], r["text"]) for r in out if r["whole"]]
    for owner in {r["owner"] for r in out if not r["whole"]}:
        pieces = sorted((r for r in out if not r["whole"] and r["owner"] == owner), key=lambda r: r["block"])
        events.append((owner, max(p["n"] for p in pieces), pieces[0]["alone"], b"".join(p["text"] for p in pieces)))
    parsed = [(alone, json.loads(e)) for _, _, alone, e in sorted(events)]
    return [e for alone, e in parsed if not alone or FIELDS & set(e)]


def test_cut_blocks_equal_a_parser():
    rng = random.Random(11)
    for _ in range(1500):
        text, values = file_of(rng)
        rows = text.encode().count(b"}") + 1
        borders = set(rng.sample(range(1, rows + 1), min(rows, rng.choice([0, 1, 3, 50]))))
        assert cut_by_hand(text.encode(), borders, rng) == wanted(values), text


@pytest.mark.parametrize("block", ["40", "1000", "128m"])
def test_files_in_blocks_of_any_size(spark, tmp_path, block):
    rng, want = random.Random(7), []
    for k in range(12):
        text, values = file_of(rng)
        (tmp_path / f"f{k:02d}").write_text(text)
        want += wanted(values)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, (block, "0")):
            spark.conf.set(k, v)
        rows = trace_json.numbered(trace_json.read_raw(spark, str(tmp_path))).where("ph <> 'M' OR ph IS NULL").orderBy("event_id").collect()
    finally:
        for k, v in zip(keys, kept):
            spark.conf.set(k, v)
    assert [(r["name"], json.loads(r["args"]) if r["args"] else None) for r in rows] == [(e.get("name"), e.get("args") or None if e.get("args") is None else e["args"]) for e in want]


FIVE = [{"name": f"e{k}", "ph": "X", "ts": k, "dur": 1} for k in range(5)]
LOST = {  # files that readers by line or by document lose events of, or find events in that aren't there
    "one_line": (json.dumps({"otherData": {"version": "1"}, "traceEvents": FIVE}), 5), "frames": (json.dumps({"stackFrames": {}, "traceEvents": FIVE}), 5),
    "not_objects": (json.dumps({"traceEvents": [FIVE[0], 5, *FIVE[1:4], "x", None]}), 4), "none": ('{"displayTimeUnit":"ns"}', 0), "after": (json.dumps({"traceEvents": FIVE, "otherData": {"a": [{"ph": "X"}]}}), 5),
}


@pytest.mark.parametrize("mode", ["auto", "lines"])
def test_lost_files(spark, tmp_path, mode):
    for name, (text, n) in LOST.items():
        (tmp_path / name).write_text(text)
        assert [r["name"] for r in trace_json.read_raw(spark, str(tmp_path / name), mode).orderBy("line_no", "sub").collect()] == [f"e{k}" for k in range(n)], name


@pytest.mark.parametrize("text", ['[{"ph":"X"},{"ph":"X"', '{"traceEvents":[{"ph":"X"}]', "hello", '[{"ph":"X"}]]', '{"a":"x', '[{"ph":"X"}] 5', '[{"ph" "X"}]'])
def test_broken_files_are_errors(spark, tmp_path, text):
    (tmp_path / "broken").write_text(text)
    with pytest.raises(Exception, match="not a trace"):
        trace_json.read_raw(spark, str(tmp_path / "broken")).collect()


def test_stream_loses_no_event(spark, tmp_path):
    from spanframe.streaming import live

    (tmp_path / "in").mkdir()
    e = [json.dumps(r) for r in FIVE]
    (tmp_path / "in" / "a").write_text("[" + e[0] + ",\n" + e[1] + "," + e[2] + ",\n" + e[3] + "]\n")
    (tmp_path / "in" / "b").write_text(json.dumps({"otherData": {"v": "1"}, "traceEvents": FIVE[4:]}))

    def read(name, **options):
        q = live.stream_events(spark, str(tmp_path / "in"), **options).writeStream.format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
            return sorted(r["name"] for r in spark.sql(f"SELECT name FROM {name}").collect()), q.lastProgress
        finally:
            q.stop()

    assert read("whole")[0] == [f"e{k}" for k in range(5)]
    (tmp_path / "in" / "c").write_text('{"ph":\n')
    found, progress = read("counted", broken="count")
    assert found == [f"e{k}" for k in range(5)] and (progress.observedMetrics["lines"]["broken"], progress.observedMetrics["lines"]["read"]) == (1, 5)
    with pytest.raises(Exception, match="whole events"):
        read("failed")
