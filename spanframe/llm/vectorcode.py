"""Compression of vectors to codes: codebooks for equal parts, fitted by rounds whose searches are cut by norm-of-sum bounds.

A vector's components become integers and are cut into parts; each part's codebook has a few entries. A round assigns each
part to the nearest entry and moves each entry to the mean of its parts. What a round learns is kept with the row: the
entry, and for each group of entries a bound below the distances to the group's other entries, with the stamp of the
round that measured it. All codebooks so far are kept as well (they are small), so a later round lowers a bound by how far
the entries really are from where they were at its stamp: the norm of the sum of the moves, which never exceeds the sum of
their norms. Only groups whose lowered bound doesn't clear the distance to the row's own entry are measured again, exactly.

Rows stay where they are: a round reads the table of rows, writes the next one to the shared folder, and sends to the
driver one sum for each entry and component, however many rows there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import saved, unsaved

#: Sums by label are sent to all executors up to so many labels; beyond, they are joined by a shuffle.
FEW_LABELS = 100_000


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    groups: int = 8
    scale: int = 256


@dataclass
class Codes:
    """rows: vec_id, label, code, error and rescans (groups measured after the first round). codebooks: part, entry, position."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.reshape(-1).tolist())).encode()).hexdigest()


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _down(bounds: np.ndarray) -> np.ndarray:
    """Not negative numbers as 16 bits, the upper half of a 32-bit float, rounded down."""
    low = np.nextafter(np.maximum(bounds, 0).astype("<f4"), np.float32(0))
    return (low.view("<u4") >> 16).astype("<u2")


def _up(halves: np.ndarray) -> np.ndarray:
    return (halves.astype("<u4") << 16).view("<f4").astype(np.float64)


def displacements(history: list[np.ndarray], net: bool = True) -> np.ndarray:
    """(stamp, part, entry): how far entries are from where they were in each round; not net: the sum of the moves since."""
    norm = lambda a, b: np.sqrt(((a - b).astype(np.float64) ** 2).sum(axis=-1))
    if net:
        far = [norm(history[-1], then) for then in history]
    else:
        moves = [norm(b, a) for a, b in zip(history, history[1:])]
        far = [sum(moves[t:], np.zeros(history[0].shape[:2])) for t in range(len(history))]
    return np.array(far) * (1 + 1e-9)


def assign(x: np.ndarray, history: list[np.ndarray], far: np.ndarray, groups: int, state: tuple | None) -> tuple[np.ndarray, ...]:
    """One round over rows ``x`` (row, part, position): entries, lower bounds, stamps, squared errors, groups measured.

    state: (entries, lower, stamps) of the round before, or None in the first one. Ties go to the entry of lower index.
    """
    n, parts, _ = x.shape
    book, now = history[-1], len(history) - 1
    cuts = np.linspace(0, book.shape[1], groups + 1).astype(int)
    none = np.iinfo(np.int64).max
    entries, errors, measured = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    lower, stamps = np.zeros((n, parts, groups), "<u2"), np.full((n, parts, groups), now, np.uint8)
    rows = np.arange(n)
    for p in range(parts):
        square = lambda at, a, b: ((x[at, p, None, :] - book[None, p, a:b, :]) ** 2).sum(axis=-1)
        found, scan = np.full((n, book.shape[1]), none), np.ones((n, groups), bool)
        if state is not None:
            old, low = state[0][:, p].astype(np.int64), _up(state[1][:, p])
            own = ((x[:, p] - book[p, old]) ** 2).sum(axis=-1)
            found[rows, old] = own
            moved = np.array([[far[t, p, a:b].max(initial=0) for a, b in zip(cuts, cuts[1:])] for t in range(now + 1)])
            low = low - moved[state[2][:, p], np.arange(groups)]
            reach = np.sqrt(own.astype(np.float64))
            scan = low <= (reach * (1 + 1e-9) + 1e-6)[:, None]
        for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
            at = np.flatnonzero(scan[:, g])
            if len(at) and b > a:
                found[at, a:b] = square(at, a, b)
        best = found.argmin(axis=1)
        entries[:, p], errors, measured = best, errors + found[rows, best], measured + scan.sum(axis=1)
        found[rows, best] = none
        for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
            least = np.sqrt(found[:, a:b].min(axis=1, initial=none).astype(np.float64))
            if state is not None:
                kept = ~scan[:, g]
                left = kept & (best != old) & (old >= a) & (old < b)  # the entry that the row leaves counts for its group again
                lower[:, p, g] = np.where(left, _down(np.minimum(low[:, g], reach)), np.where(kept, state[1][:, p, g], _down(least)))
                stamps[:, p, g] = np.where(kept & ~left, state[2][:, p, g], now)
            else:
                lower[:, p, g] = _down(least)
    return entries, lower, stamps, errors, measured


STATE = "vec_id {id}, label {label}, x array<int>, code binary, lower binary, stamps binary, error bigint, rescans bigint"


def _round(history: list[np.ndarray], far: np.ndarray, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shape = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first = batch.num_rows, "code" not in batch.schema.names
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, shape[0], shape[2])
            of = lambda c, kind, *size: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, *size)
            state = None if first else (of("code", np.uint8, shape[0]), of("lower", "<u2", shape[0], groups), of("stamps", np.uint8, shape[0], groups))
            entries, lower, stamps, errors, measured = assign(x, history, far, groups, state)
            rescans = np.zeros(n, np.int64) if first else batch.column("rescans").to_numpy() + measured
            pack = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            out = [batch.column("vec_id"), batch.column("label"), batch.column("x"), pack(entries), pack(lower), pack(stamps), pa.array(errors), pa.array(rescans)]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "x", "code", "lower", "stamps", "error", "rescans"])

    return run


def _sums(shape: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many parts each entry has and their sums by component, as (slot, total), once for each task."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], np.concatenate([x[:, p], np.ones((n, 1), np.int64)], axis=1))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total.reshape(-1)[slots])], ["slot", "total"])

    return run


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: CodeParams = CodeParams(), net: bool = True) -> Codes:
    """Codes of all rows whose vector has only finite components.

    Vectors have the length of the one with the smallest id; others are left out. A length that isn't a multiple of
    ``parts`` is filled up with zeros. The first codebooks are the parts of the vectors with the smallest ids (null ids
    come last, equal ids by their components); with fewer rows than entries there are as many entries as rows. Components
    saturate where squared distances would leave 64 bits, for 64 components at about 740,000. Repeated ids keep a row each.
    Other columns are ignored; an empty table gives empty rows and codebooks. net: False lowers bounds by accumulated
    moves, which gives the same codes with more measuring.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(_finite(F.col("v")))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(params.entries).collect()
    size = len(first[0]["v"]) if first else 0
    width = max(1, -(-size // params.parts))
    most = math.isqrt((1 << 61) // (width * params.parts))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * params.scale).cast("double"), F.lit(float(most))), F.lit(float(-most))).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), width * params.parts - size))
    table = rows.where(F.size("v") == size).select("vec_id", "label", filled.alias("x"))
    of = lambda v: [max(-most, min(most, math.floor(c * params.scale))) for c in v] + [0] * (width * params.parts - size)
    seeds = np.array([of(r["v"]) for r in first if len(r["v"]) == size], np.int64).reshape(-1, params.parts, width)
    history = [np.ascontiguousarray(seeds.transpose(1, 0, 2))]
    schema = STATE.format(id=kinds[id_col], label=kinds[label_col])
    groups = max(1, min(params.groups, history[0].shape[1]))
    state = None
    for k in range(params.rounds + 1):
        done = (state if state is not None else table).mapInArrow(_round(history, displacements(history, net), groups), schema)
        last, state = state, saved(done.select("vec_id", "label", "code", "error", "rescans") if k == params.rounds else done, "codes")
        if last is not None:
            unsaved(last)
        if k == params.rounds:
            return Codes(state, history[-1])
        sums = state.select("x", "code").mapInArrow(_sums(history[0].shape), "slot bigint, total bigint").groupBy("slot").agg(F.sum("total").alias("total"))
        total = np.zeros((*history[0].shape[:2], width + 1), np.int64)
        for slot, value in map(tuple, sums.collect()):  # a row for each entry and component at most
            total.reshape(-1)[slot] = value
        count = total[..., -1:]
        history.append(np.where(count > 0, total[..., :-1] // np.maximum(count, 1), history[-1]))
    raise ValueError("rounds must not be negative")


def digest(df: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of encode; label_error: the error of all rows of equal label.

    A label_error beyond 64 bits is null.
    """
    codes = encode(df, **options)
    labels = codes.rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")).withColumnRenamed("label", "of")
    few = labels.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    met = codes.rows.join(F.broadcast(labels) if few else labels, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
