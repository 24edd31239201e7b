"""The tree of a thread's spans, from its rows in order: one pass over a stack of the spans that are open.

A span's parent is the last earlier span of its thread that hasn't ended by its start, contained or not, and its depth is
one more than its parent's. What is under a span follows it without a gap, so a span and the last row under it are an
interval that tells all its descendants. A path is known by a number: the hash of the path above and the row's name and
category.

Threads are whole in a task, and none has more rows than a piece. Longer ones are cut: each piece is summed up by the
time at which it last reaches the spans open before it, and by the spans that it leaves open; these sums, composed in
order, give each piece the stack that it starts with, and each starts again with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.plans.pieces import PIECE, UNCUT
from spanframe.plans.scratch import saved

THREAD = ["pid", "tid"]
TREE = "depth int, parent_id bigint, last_seq bigint, inner_dur double, path_id bigint, above_id bigint"
ROW = ("ts", "dur", "end_ts", "event_id", "name", "category", "seq")
ROOT = 0


def path_id(above: int, name: str, category: str) -> int:
    return xxhash.xxh64_intdigest(f"{above}\0{len(name)}\0{name}{category}".encode("utf-8", "surrogatepass")) - (1 << 63)


class _Stack:
    """The open spans of one thread. An entry: when it ends, its event, its path, its row, the last row under it, the time of its children."""

    def __init__(self, carried: list[tuple] = ()):
        self.open = [[end, event, path, None, None, 0.0] for end, event, path in carried]
        self.shut: list[list] = []  # carried spans that ended here
        self.paths: dict[tuple, int] = {}

    def walk(self, rows: Iterator[tuple], out: list[list]) -> None:
        """Adds for each row its depth, parent, last row under it, time of children, path and path above to ``out``."""
        opened, last = self.open, None
        for ts, dur, end, event, name, category, seq in rows:
            while opened and opened[-1][0] <= ts:
                self._close(opened.pop(), last, out)
            top = opened[-1] if opened else None
            above = top[2] if top else ROOT
            key = (above, name, category)
            path = self.paths.get(key)
            if path is None:
                path = self.paths[key] = path_id(*key)
            if top and dur > 0 and end <= top[0]:
                top[5] += dur
            out.append([len(opened), top[1] if top else None, seq, 0.0, path, above])
            if dur > 0:
                opened.append([end, event, path, len(out) - 1, seq, 0.0])
            last = seq
        while opened:
            self._close(opened.pop(), last, out)

    def _close(self, entry: list, last: int | None, out: list[list]) -> None:
        if entry[3] is None:
            if last is not None:
                entry[4] = last
                self.shut.append(entry)
        else:
            out[entry[3]][2:4] = [last, entry[5]]


def _columns(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[table.column(c).to_pylist() for c in ROW])


def _with_tree(batch: pa.RecordBatch, out: list[list]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return [*batch.columns, *[pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)]]


NAMES = [c.split()[0] for c in TREE.split(", ")]


def _threads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole threads, one after the other; a thread's rows are held until it is whole."""

    def walked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pids, tids, out = table.column("pid").to_pylist(), table.column("tid").to_pylist(), []
        cuts = [0, *[k for k in range(1, len(tids)) if tids[k] != tids[k - 1] or pids[k] != pids[k - 1]], len(tids)]
        rows = list(_columns(table))
        for a, b in zip(cuts, cuts[1:]):
            _Stack().walk(rows[a:b], part := [])
            out += part
        yield from pa.Table.from_arrays(_with_tree(table, out), [*table.schema.names, *NAMES]).to_batches()

    held: list[pa.RecordBatch] = []
    of = lambda batch, k: (batch.column("pid")[k], batch.column("tid")[k])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        begin = n
        while begin and of(batch, begin - 1) == of(batch, n - 1):
            begin -= 1
        if begin or held and of(held[-1], held[-1].num_rows - 1) != of(batch, 0):
            yield from walked(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield from walked(pa.Table.from_batches(held))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("seq")


SUM = "pid bigint, tid bigint, _piece bigint, reached double, open array<struct<ends:double,event:bigint,name:string,category:string>>"


def _sum(table: pa.Table) -> pa.Table:
    """What a piece does to the stack: the time at which it last reaches what was open before, and what it leaves open."""
    table, opened, reached = _sorted(table), [], None
    for ts, dur, end, event, name, category, _ in _columns(table):
        while opened and opened[-1]["ends"] <= ts:
            opened.pop()
        if not opened:
            reached = ts
        if dur > 0:
            opened.append({"ends": end, "event": event, "name": name, "category": category})
    row = {c: table.column(c)[0].as_py() for c in (*THREAD, PIECE)} | {"reached": reached, "open": opened}
    entry = pa.struct([("ends", pa.float64()), ("event", pa.int64()), ("name", pa.string()), ("category", pa.string())])
    return pa.Table.from_pylist([row], pa.schema([*[(c, pa.int64()) for c in (*THREAD, PIECE)], ("reached", pa.float64()), ("open", pa.list_(entry))]))


CARRY = "pid bigint, tid bigint, _piece bigint, k int, ends double, event bigint, path bigint"


def _carries(sums: pa.Table) -> pa.Table:
    """The stack that each piece of a thread starts with."""
    stack, out = [], []
    for row in sums.sort_by(PIECE).to_pylist():
        key = {c: row[c] for c in (*THREAD, PIECE)}
        out += [key | {"k": k, "ends": ends, "event": event, "path": path} for k, (ends, event, path) in enumerate(stack)]
        while stack and stack[-1][0] <= row["reached"]:
            stack.pop()
        for e in row["open"]:
            stack.append((e["ends"], e["event"], path_id(stack[-1][2] if stack else ROOT, e["name"], e["category"])))
    return pa.Table.from_pylist(out, pa.schema([*[(c, pa.int64()) for c in (*THREAD, PIECE)], ("k", pa.int32()), ("ends", pa.float64()), ("event", pa.int64()), ("path", pa.int64())]))


def _carried(carry: pa.Table) -> list[tuple]:
    return [(r["ends"], r["event"], r["path"]) for r in sorted(carry.to_pylist(), key=lambda r: r["k"])]


def _piece(table: pa.Table, carry: pa.Table) -> pa.Table:
    table, out = _sorted(table), []
    _Stack(_carried(carry)).walk(_columns(table), out)
    return pa.Table.from_arrays(_with_tree(table, out), [*table.schema.names, *NAMES])


def _told(table: pa.Table, carry: pa.Table) -> pa.Table:
    """What a piece adds to the spans that it starts with: the last row under them and the time of their children."""
    stack = _Stack(_carried(carry))
    stack.walk(_columns(_sorted(table)), [])
    rows = [{"event_id": e[1], "last": e[4], "more": e[5]} for e in stack.shut]
    return pa.Table.from_pylist(rows, pa.schema([("event_id", pa.int64()), ("last", pa.int64()), ("more", pa.float64())]))


def nested(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with end_ts and the tree: depth, parent_id, last_seq, inner_dur, path_id, above_id.

    rows: thread events with seq, partitioned by thread or by piece of one. last_seq: the seq of the last row under the
    span, its own if there is none; inner_dur: the duration of its children that end by its end. order: what seq follows.
    """
    rows = rows.withColumn("end_ts", F.col("ts") + F.col("dur"))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(TREE).fields])
    if PIECE not in rows.columns:
        return rows.sortWithinPartitions(*THREAD, *order).mapInArrow(_threads, schema)
    rows = saved(rows, "thread-pieces")
    short = rows.where(F.col(PIECE) == UNCUT).repartition(*THREAD).sortWithinPartitions(*THREAD, *order).mapInArrow(_threads, schema)
    long = rows.where(F.col(PIECE) != UNCUT)
    key = [*THREAD, PIECE]
    slim = long.select(*key, *ROW)
    carry = saved(slim.groupBy(*key).applyInArrow(_sum, SUM).groupBy(*THREAD).applyInArrow(_carries, CARRY), "thread-carries")
    told = slim.groupBy(*key).cogroup(carry.groupBy(*key)).applyInArrow(_told, "event_id bigint, last bigint, more double")
    told = told.groupBy("event_id").agg(F.max("last").alias("last"), F.sum("more").alias("more"))
    cut = long.groupBy(*key).cogroup(carry.groupBy(*key)).applyInArrow(_piece, schema).join(told, "event_id", "left")
    cut = cut.withColumns({"last_seq": F.greatest("last_seq", "last"), "inner_dur": F.col("inner_dur") + F.coalesce("more", F.lit(0.0))})
    return short.unionByName(cut.select(*short.columns))
