"""Events of JSON texts of any layout, cut out in parallel: a structural scan of pieces of files, whatever their line breaks.

A file is read in blocks, as rows that end at closing braces, so a text of one line is split like any other and only what
stands between two braces must fit a row. What a block does to a reader depends on how it comes in: within a string or not,
and how deep. So each block is first summed up for both cases: whether it ends within a string, how much deeper it ends,
how far up it goes between, and what the innermost brackets that it leaves open are. These sums are composed in order of
the blocks, which tells each block how it is come into; then each block cuts out its events by itself. An event that
crosses the border of a block is joined from its pieces.

A text is a sequence of values: the objects in an array are events, so are those in the array traceEvents of an object, and
an object without that key is an event itself, if it has a field of one. What stands elsewhere is passed over.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.plans.scratch import saved

#: Blocks' states are sent to all executors up to so many blocks; the default block has 128 MB.
MOST_BLOCKS = 2_000_000
#: What opens the array of events. A row of text is never cut within it, as it holds no closing brace.
KEY = re.compile(rb'"traceEvents"\s*:\s*\[')
BRACE, BRACKET = 1, 2  # what opens; closing ones are the negative
KINDS = np.zeros(256, np.int8)
KINDS[[ord(c) for c in "{[}]"]] = [BRACE, BRACKET, -BRACE, -BRACKET]
#: What may stand between the values of a text.
BETWEEN = b" \t\r\n,\x1e"
BOM = b"\xef\xbb\xbf"


@dataclass
class Tokens:
    """The brackets of a text outside its strings: where they are, what they are, how deep it is after each, and which open traceEvents."""

    at: np.ndarray
    kind: np.ndarray
    after: np.ndarray
    trace: np.ndarray
    in_string: bool

    @property
    def before(self) -> np.ndarray:
        return self.after - np.sign(self.kind)


def _quotes(text: bytes, data: np.ndarray) -> np.ndarray:
    """Where strings begin and end. Texts begin outside escapes."""
    quotes = np.flatnonzero(data == 34)
    if len(quotes) and b"\\" in text:
        plain = np.maximum.accumulate(np.where(data != 92, np.arange(len(data)), -1))
        run = np.where(quotes > 0, quotes - 1 - plain[np.maximum(quotes - 1, 0)], 0)
        quotes = quotes[run % 2 == 0]
    return quotes


def tokens(text: bytes, in_string: bool, depth: int, read: tuple | None = None) -> Tokens:
    """read: what _read() gives of the text, if it is known."""
    quotes, at, kind, keys = read if read is not None else _read(text)
    out = (np.searchsorted(quotes, at) + in_string) % 2 == 0
    at, kind = at[out], kind[out]
    after = depth + np.cumsum(np.sign(kind), dtype=np.int64)
    trace = np.isin(at, keys) if len(keys) else np.zeros(len(at), bool)
    return Tokens(at, kind, after, trace, bool((len(quotes) + in_string) % 2))


def _read(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    kinds = KINDS[data]
    at = np.flatnonzero(kinds)
    keys = [m.end() - 1 for m in KEY.finditer(text) if text[m.start() - 1 : m.start()] != b"\\" or m.start() == 0]
    return _quotes(text, data), at, kinds[at], np.array(keys, np.int64)


@dataclass
class Sum:
    """What a block does to a reader that comes in within a string or not; depths count from where it comes in.

    open: of the three outermost levels that it opens and leaves open, what opened them, whether that was a traceEvents
    array, and whether one stands in it. met: how deep traceEvents arrays stand in objects opened before.
    """

    in_string: bool
    depth: int = 0
    low: int = 0
    open: dict[int, tuple[int, bool, bool]] = field(default_factory=dict)
    met: set[int] = field(default_factory=set)

    def add(self, text: bytes, read: tuple) -> None:
        t = tokens(text, self.in_string, self.depth, read)
        self.in_string = t.in_string
        if not len(t.at):
            return
        before = t.before
        lows = np.minimum(self.low, np.minimum.accumulate(t.after))
        for k in np.flatnonzero(t.trace):
            if before[k] == (lows[k - 1] if k else self.low):
                self.met.add(int(before[k]))
        low, depth, was = int(lows[-1]), int(t.after[-1]), self.open
        self.open = {}
        for level in range(low, min(low + 3, depth)):
            opened = np.flatnonzero((before == level) & (t.kind > 0))
            inside = np.flatnonzero(t.trace & (before == level + 1))
            if len(opened):
                k = opened[-1]
                self.open[level] = (int(t.kind[k]), bool(t.trace[k]), bool((inside > k).any()))
            elif level in was:
                kind, trace, has = was[level]
                self.open[level] = (kind, trace, has or bool(len(inside)))
        self.low, self.depth = low, depth


def _joined(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, text) of the runs of rows of one block; each row's closing brace is put back."""
    files, blocks = batch.column("file").to_pylist(), np.asarray(batch.column("block"))
    values = batch.column("value").to_pylist()
    ends = [k for k in range(1, len(files)) if blocks[k] != blocks[k - 1] or files[k] != files[k - 1]]
    for a, b in zip([0, *ends], [*ends, len(files)]):
        if b > a:
            yield files[a], int(blocks[a]), b"}".join([*values[a:b], b""])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("sums", pa.string())])
    now, size, sums, count = None, 0, [], 0

    def told() -> pa.RecordBatch:
        rows = [{"in_string": s.in_string, "depth": s.depth, "low": s.low, "open": [[k, *v] for k, v in s.open.items()], "met": sorted(s.met)} for s in sums]
        return pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "size": size, "bytes": count, "sums": json.dumps(rows)}], schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = dict(zip(batch.column("file").to_pylist(), batch.column("size").to_pylist()))
        for file, block, text in _joined(batch):
            if (file, block) != now:
                if now is not None:
                    yield told()
                now, size, sums, count = (file, block), sizes[file], [Sum(False), Sum(True)], 0
            read = _read(text)
            for s in sums:
                s.add(text, read)
            count += len(text)
    if now is not None:
        yield told()


STATE = "file string, block bigint, in_string boolean, depth int, top int, wrapper boolean, trace boolean, level int, owner bigint, leaves_wrapper boolean, last boolean, cut boolean"


def composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """How each block of a file is come into. blocks: (file, block, size, bytes, sums)."""
    blocks = blocks.sort_values("block")
    whole, size = int(blocks["bytes"].sum()), int(blocks["size"].iloc[0])
    in_string, depth, levels, opened, wrappers, out = False, 0, {}, {}, set(), []
    for block, sums in zip(blocks["block"], blocks["sums"]):
        out.append([block, in_string, depth, dict(levels), dict(opened)])
        s = json.loads(sums)[in_string]
        if 0 in levels and levels[0][0] == BRACE and any(depth + m == 1 for m in s["met"]):
            wrappers.add(opened[0])
        low, left = depth + s["low"], {depth + k: v for k, *v in s["open"]}
        for level in range(3):
            if level >= low:
                levels.pop(level, None)
                opened.pop(level, None)
                if level in left:
                    levels[level], opened[level] = left[level], block
        if opened.get(0) == block and levels[0][2]:
            wrappers.add(block)
        in_string, depth = s["in_string"], depth + s["depth"]
    rows = []
    for block, within, deep, lev, opn in out:
        top, wrapper, trace = lev.get(0, (0, False, False))[0], opn.get(0) in wrappers, lev.get(1, (0, False, False))[1]
        level = 1 if top == BRACKET else 2 if wrapper and trace else 0 if top == BRACE and not wrapper else -1
        inside = 0 <= level < deep and lev.get(level, (0, False, False))[0] == BRACE
        last = block == out[-1][0]
        rows.append((blocks["file"].iloc[0], block, within, deep, top, wrapper, trace, level if inside else -1, opn[level] if inside else -1, block in wrappers, last, last and whole in (size + 1, size + 1 - len(BOM))))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])


class _Cutter:
    """Cuts a block's events out of its texts. top: what opened the outermost level; level, owner: of the event that is open."""

    def __init__(self, state: dict):
        self.file, self.block, self.in_string, self.depth = state["file"], state["block"], state["in_string"], state["depth"]
        self.top, self.wrapper, self.trace = state["top"], state["wrapper"], state["trace"]
        self.level, self.owner, self.number = state["level"], state["owner"], 0
        self.leaves_wrapper, self.last, self.cut = state["leaves_wrapper"], state["last"], state["cut"]
        self.held: list[bytes] = []

    def _event(self, text: bytes, whole: bool, owner: int, alone: bool) -> dict:
        self.number += 1
        return {"file": self.file, "owner": owner, "block": self.block, "n": self.number if owner == self.block else -1, "whole": whole, "alone": alone, "text": text}

    def add(self, text: bytes, ends: bool) -> Iterator[dict]:
        """The events that end in a further text of the block; ends: it is the block's last."""
        if ends and self.last and self.cut:
            text = text[:-1]
        if self.block == 0 and not self.number and not self.held and text.startswith(BOM):
            text = text[len(BOM) :]
        began, depth = self.in_string, self.depth
        t = tokens(text, began, depth)
        if len(t.at) and t.after.min() < 0:
            late = int(t.at[np.flatnonzero(t.after < 0)[0]])
            if not (ends and self.last and not self.cut and late == len(text) - 1 and text.endswith(b"}")):
                raise ValueError(f"not a trace: more brackets close than open in {self.file}")
            text = text[:-1]  # the brace put back at the end of a file whose length doesn't tell
            t = tokens(text, began, depth)
        self.in_string = t.in_string
        before, opens = t.before, t.kind > 0
        n, index = len(t.at), np.arange(len(t.at))
        tops = np.maximum.accumulate(np.where(opens & (before == 0), index, -1)) if n else index
        seconds = np.maximum.accumulate(np.where(opens & (before == 1), index, -1)) if n else index
        of = lambda last, kind, then: np.where(last >= 0, kind[np.maximum(last, 0)], then) if n else np.zeros(0, np.int8)
        top, trace = of(tops, t.kind, self.top), of(seconds, t.trace, self.trace).astype(bool)
        holders = tops[t.trace & (before == 1)]  # the objects here that hold a traceEvents array
        if (holders < 0).any():
            self.wrapper = True
        begins = opens & (t.kind == BRACE) & (((before == 1) & (top == BRACKET)) | ((before == 2) & (top == BRACE) & trace) | ((before == 0) & ~np.isin(index, holders)))
        if self.held or self.level >= 0:
            if self.level == 0 and self.wrapper:
                self.held, self.level, self.owner = [], -1, -1
        free = 0 if self.level < 0 and depth == 0 else -1  # from where on text stands between values
        closers = {level: np.flatnonzero((t.kind == -BRACE) & (t.after == level)) for level in range(3)}
        reached = 0
        if self.level >= 0:
            end = closers[self.level]
            if len(end):
                reached = int(t.at[end[0]]) + 1
                yield self._event(b"".join([*self.held, text[:reached]]), self.owner == self.block, self.owner, self.level == 0)
                begins &= t.at >= reached
                self.held, self.level, self.owner = [], -1, -1
            else:
                self.held.append(text)
                begins[:] = False
        for k in np.flatnonzero(begins):
            start, level = int(t.at[k]), int(before[k])
            if start < reached:
                continue
            end = closers[level][np.searchsorted(closers[level], k) :][:1]
            if len(end):
                reached = int(t.at[end[0]]) + 1
                yield self._event(text[start:reached], True, self.block, level == 0)
            else:
                self.held, self.level, self.owner = [text[start:]], level, self.block
                break
        self._between(text, t, depth, began)
        if n:
            self.depth = int(t.after[-1])
            if tops[-1] >= 0:
                self.top, self.wrapper = int(t.kind[tops[-1]]), bool((holders == tops[-1]).any())
            self.trace = bool(trace[-1])
        if ends:
            yield from self._end()

    def _between(self, text: bytes, t: Tokens, depth: int, in_string: bool) -> None:
        """Nothing but white space and commas may stand outside all values."""
        shut = np.flatnonzero(t.after == 0)
        begin = [0] if depth == 0 else []
        starts = [*begin, *(t.at[shut] + 1).tolist()]
        ends = [*t.at[np.flatnonzero((t.before == 0) & (t.kind > 0))].tolist(), len(text)]
        rest = b"".join(text[a:b] for a, b in zip(starts, ends)).strip(BETWEEN)
        if rest or depth == 0 and in_string:
            raise ValueError(f"not a trace: {rest[:80]!r} stands outside of arrays and objects in {self.file}")

    def _end(self) -> Iterator[dict]:
        if self.level >= 0 and self.held and not (self.level == 0 and (self.leaves_wrapper if self.owner == self.block else self.wrapper)):
            if self.last:
                raise ValueError(f"not a trace: {self.file} ends within an event")
            yield self._event(b"".join(self.held), False, self.owner, self.level == 0)
        elif self.last and (self.in_string or self.depth > (self.top == BRACKET)):
            raise ValueError(f"not a trace: {self.file} ends within a value")


FIELDS = ["in_string", "depth", "top", "wrapper", "trace", "level", "owner", "leaves_wrapper", "last", "cut"]


def _cuts(states: Broadcast, whole: bool):
    """The whole events of blocks, or the pieces of those that cross a border. states: of (file, block)."""
    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("alone", pa.bool_()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, waiting = None, None, b""
        told = lambda rows: pa.RecordBatch.from_pylist([r for r in rows if r["whole"] == whole], schema)
        for batch in batches:
            for file, block, text in _joined(batch):
                if (file, block) == now:
                    yield told(cutter.add(waiting, False))
                else:
                    if cutter is not None:
                        yield told(cutter.add(waiting, True))
                    now = file, block
                    cutter = _Cutter({"file": file, "block": block} | dict(zip(FIELDS, states.value[now])))
                waiting = text
        if cutter is not None:
            yield told(cutter.add(waiting, True))

    return run


def cut_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, alone, text): each event's text, line_no its place in its block; alone: it is no element of an array.

    Runs jobs: the files are read once for the sums of their blocks, and, if any has several, once for the events that cross
    borders, one for each block at most. spark.sql.files.maxPartitionBytes is the size of blocks.
    """
    rows = spark.read.text(path, lineSep="}").select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    sums = rows.mapInArrow(_sums, "file string, block bigint, size bigint, bytes bigint, sums string")
    found = sums.groupBy("file").applyInPandas(composed, STATE).limit(MOST_BLOCKS + 1).collect()  # a row for each block
    if len(found) > MOST_BLOCKS:
        raise ValueError(f"over {MOST_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    states = spark.sparkContext.broadcast({(r["file"], r["block"]): tuple(r[c] for c in FIELDS) for r in found})
    cut = "file string, owner bigint, block bigint, n bigint, alone boolean, text binary"
    of_block = ["file", F.col("owner").alias("block"), F.col("n").alias("line_no"), "alone", F.col("text").cast("string").alias("text")]
    events = rows.mapInArrow(_cuts(states, True), cut).select(*of_block)
    if all(r["last"] for r in found):
        return events
    pieces = saved(rows.mapInArrow(_cuts(states, False), cut), "trace-pieces")
    parts = F.sort_array(F.collect_list(F.struct("block", F.col("text").cast("string").alias("t"))))
    joined = pieces.groupBy("file", "owner").agg(F.max("n").alias("n"), F.max("alone").alias("alone"), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))
    return events.unionByName(joined.select(*of_block))
