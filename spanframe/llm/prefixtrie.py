"""The trie of conversation prefixes: every distinct beginning of conversations with what it is shared by.

Conversations become rows of turn ids (16 bytes of a SHA-256), and a range shuffle by these ids brings them into shards in
order. In a shard, blocks of rows become matrices of dense turn ids padded with zeros; lexsort puts the rows in order,
neighbouring rows are compared by column, and the changes, OR-accumulated along a row, mark where a node of each depth
starts. reduceat over these starts sums up the nodes of a depth at once.

All sums of a node are sums over its rows, once it is known which nodes a row is the first of and whether it is the last
of a leaf. Between blocks of a shard that is known from the row before. A node that reaches over the edge of a block is
emitted in pieces; the rows at a shard's edges are emitted as well, and what the shards' neighbours tell of them
corrects the pieces, which are then joined in order, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import WORD, bound_batches, saved, unsaved

#: Cells of a block's matrix, at most, but for a row that is longer alone.
CELLS = 1 << 20
#: Joined nodes are sent to all executors up to so many; beyond, they are joined by a shuffle.
FEW_NODES = 100_000
#: Rows in one Arrow batch.
BATCH_ROWS = 4096


def rebuilt(talks: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, turns, words): each conversation with the first turns of its family's first conversation before its own.

    talks: (conv_id, turn, role, text). turns are ids of role and text, words their words. Turns are in order of turn,
    null first, then of role and of the hash of the text. A conversation c takes the first h turns of conversation
    c - c % every in place of its own first h; h is the CRC-32 of c's decimal text modulo ``heads``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.unhex(F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32)))
    words = F.regexp_count(text, F.lit(WORD))
    step = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), role.alias("c"), turn.alias("id"), words.alias("w"))
    own = talks.where("conv_id IS NOT NULL").select("conv_id", step.alias("s")).groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    slim = F.transform("s", lambda s: F.struct(s["id"].alias("id"), s["w"].alias("w")))
    own = own.select("conv_id", slim.alias("s"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int").alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("base"))
    first = own.where("conv_id = base").select(F.col("base"), F.slice("s", 1, heads).alias("head"))
    both = own.join(first, "base", "left")
    head = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("s", 1, 0))
    whole = F.concat(head, F.slice("s", F.col("h") + 1, F.size("s") + 1))
    return both.select("conv_id", whole.alias("s")).select("conv_id", F.col("s.id").alias("turns"), F.col("s.w").alias("words"))


NODE = "shard int, pos bigint, first boolean, last boolean, depth int, key binary, parent binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, before bigint, ends binary, ends_sha256 string, turns array<binary>, words array<int>"


class _Rows:
    """Rows of one shard: conversation ids, the turns' ids as pairs of numbers, words, and where each row's turns start."""

    def __init__(self, convs, ids, words, starts):
        self.convs, self.ids, self.words, self.starts = convs, ids, words, starts

    def __len__(self) -> int:
        return len(self.convs)

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Rows:
        lists, counts = batch.column("turns"), batch.column("words")
        starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        ids = np.frombuffer(b"".join(lists.flatten().to_pylist()), ">u8").reshape(-1, 2)
        return _Rows(batch.column("conv_id").to_numpy(), ids, counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), starts)

    def cut(self, a: int, b: int) -> _Rows:
        x, y = self.starts[a], self.starts[b]
        return _Rows(self.convs[a:b], self.ids[x:y], self.words[x:y], self.starts[a : b + 1] - x)

    def joined(self, other: _Rows) -> _Rows:
        return _Rows(np.concatenate([self.convs, other.convs]), np.concatenate([self.ids, other.ids]), np.concatenate([self.words, other.words]), np.concatenate([self.starts, other.starts[1:] + self.starts[-1]]))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading turns two rows of ids share."""
    n = min(len(a), len(b))
    apart = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(apart[0]) if len(apart) else n


class _Block:
    """The nodes of consecutive rows. shared: leading turns in common with the row before, -1 for none; follows: the next row."""

    def __init__(self, rows: _Rows, shared: int, edge: bool, follows: np.ndarray | None, shard: int, pos: int):
        n, lengths = len(rows), np.diff(rows.starts)
        deep = int(lengths.max(initial=0))
        _, dense = np.unique(rows.ids.astype("<u8").view([("a", "<u8"), ("b", "<u8")]).reshape(-1), return_inverse=True)
        at = (np.repeat(np.arange(n), lengths), np.arange(len(rows.ids)) - np.repeat(rows.starts[:-1], lengths))
        ids, words = np.zeros((n, deep), np.int32), np.zeros((n, deep + 1), np.int64)
        ids[at] = dense.reshape(-1) + 1  # in the order of the ids' bytes, as the shards are
        order = np.lexsort((rows.convs, *ids.T[::-1]))
        words[at[0], at[1] + 1] = rows.words
        ids, words, lengths = ids[order], words[order], lengths[order]
        self.rows, self.order, self.lengths, self.convs, self.deep = rows, order, lengths, rows.convs[order], deep
        fresh = np.zeros((n, deep + 1), bool)  # whether a row is the first of its node at each depth
        fresh[1:, 1:] = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
        fresh[0] = np.arange(deep + 1) > shared
        within = np.arange(deep + 1) <= lengths[:, None]
        self.fresh, self.within = fresh & within, within
        follow = -1 if follows is None else _shared(self.ids_of(n - 1), follows)
        after = np.append((np.logical_and.accumulate(ids[1:] == ids[:-1], axis=1) & within[:-1, 1:]).sum(axis=1), follow)
        self.after, self.last_leaf = after, after < lengths
        tokens = np.where(within & ~self.fresh, words, 0)
        self.saved = tokens[:, ::-1].cumsum(axis=1)[:, ::-1]  # from each depth on
        self.before = np.concatenate([np.zeros((n, 1), np.int64), words.cumsum(axis=1)[:, :-1]], axis=1)
        self.edge, self.open_end, self.shard, self.pos = edge, follows is None, shard, pos

    def ids_of(self, row: int) -> np.ndarray:
        k = self.order[row]
        return self.rows.ids[self.rows.starts[k] : self.rows.starts[k + 1]]

    def _chain(self, row: int) -> list[bytes]:
        """Keys of the nodes above and at a row, by depth."""
        state = hashlib.blake2b(digest_size=16)
        out = [state.digest()]
        for turn in self.ids_of(row):
            state.update(turn.tobytes())
            out.append(state.digest())
        return out

    def nodes(self) -> Iterator[dict]:
        """A row for each node, or piece of a node, of these rows."""
        n = len(self.convs)
        firsts, lasts = self._chain(0), self._chain(n - 1)
        above_conv, above_key = np.full(n, -1), [None] * n  # of each row: what its node one depth up has
        none = hashlib.sha256(b"").hexdigest()
        for d in range(self.deep + 1):
            at = np.flatnonzero(self.within[:, d])
            begins = self.fresh[at, d].copy()
            begins[:1] = True
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(at))
            total = lambda x: np.add.reduceat(x, starts)
            least = np.minimum.reduceat(self.convs[at], starts)
            children = total(self.fresh[at, d + 1].astype(np.int64)) if d < self.deep else np.zeros(len(starts), np.int64)
            leaves, tokens = total(self.last_leaf[at].astype(np.int64)), total(self.saved[at, d])
            ended = total((self.lengths[at] == d).astype(np.int64))
            convs, keys, parents = np.full(n, -1), [None] * n, above_key
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                top, bottom = at[a], at[b - 1]
                first, last = self.edge and top == 0, self.open_end and bottom == n - 1
                whole = self.fresh[top, d] and not first and not last and self.after[bottom] < d
                key = None if whole else firsts[d] if top == 0 else lasts[d]
                text = ",".join(map(str, self.convs[at[a : a + ended[k]]].tolist())).encode() if ended[k] else None
                yield {
                    "shard": self.shard, "pos": self.pos, "first": bool(first), "last": bool(last), "depth": d, "key": key, "parent": parents[top], "conv_id": int(least[k]),
                    "parent_conv_id": None if d == 0 or parents[top] is not None else int(above_conv[top]), "n_convs": b - a, "n_children": int(children[k]), "n_leaves": int(leaves[k]),
                    "saved_tokens": int(tokens[k]), "before": int(self.before[top, d]), "ends": None if whole else text, "ends_sha256": (hashlib.sha256(text).hexdigest() if text else none) if whole else None,
                }
                span = slice(top, bottom + 1)
                convs[span] = least[k]
                if key is not None:
                    keys[span] = [key] * (bottom + 1 - top)
            above_conv, above_key = convs, keys


def _edge(rows: _Rows, row: int, shard: int, pos: int) -> dict:
    one = rows.cut(row, row + 1)
    return {"shard": shard, "pos": pos, "turns": [t.tobytes() for t in one.ids], "words": one.words.tolist()}


def _nodes_of_shard(cells: int):
    """Nodes of the rows of a partition, which come in order, and the shard's first and last row."""
    schema = pa.schema([("shard", pa.int32()), ("pos", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("depth", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "before")], ("ends", pa.binary()), ("ends_sha256", pa.string()), ("turns", pa.list_(pa.binary())), ("words", pa.list_(pa.int32()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
        for batch in batches:
            rows, a = _Rows.of(batch), 0
            lengths = np.diff(rows.starts) + 1
            while a < len(rows):
                widest = np.maximum.accumulate(lengths[a:])
                b = a + max(1, int(np.searchsorted(widest * np.arange(1, len(rows) - a + 1), cells, side="right")))
                yield rows.cut(a, b)
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pos, before, held = -1, 0, None, None

        def numbered() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            for batch in batches:
                if batch.num_rows:
                    shard = batch.column("shard")[0].as_py()
                    yield batch

        def emitted(rows: _Rows, follows: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            shared = -1 if before is None else _shared(before, rows.cut(0, 1).ids)
            out: list[dict] = []
            for node in _Block(rows, shared, before is None, follows, shard, pos).nodes():
                out.append(node)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

        for rows in blocks(numbered()):
            if held is None:
                yield pa.RecordBatch.from_pylist([_edge(rows, 0, shard, 0)], schema)
            else:
                yield from emitted(held, rows.cut(0, 1).ids)
                before, pos = held.cut(len(held) - 1, len(held)).ids, pos + 1
            held = rows
        if held is not None:
            yield from emitted(held, None)
            yield pa.RecordBatch.from_pylist([_edge(held, len(held) - 1, shard, 1)], schema)

    return run


def _joined(facts: dict[int, tuple[int, int, bool]]):
    """Nodes of their pieces, which come in order. facts: of a shard, the turns its first row shares with the row before it,
    these turns' words, and whether its last row is the last of a leaf."""
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), *[(c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, some = None, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or now["key"] != r["key"]:
                    if now is not None:
                        out.append(now | {"ends_sha256": state.hexdigest()})
                    now, state, some = {c: r[c] for c in ("key", "parent", "depth", "conv_id")} | dict.fromkeys(sums, 0), hashlib.sha256(), False
                shared, words, leaf = facts[r["shard"]]
                if r["first"] and r["depth"] <= shared:  # the row before has these nodes too
                    r["saved_tokens"] += words - r["before"]
                    r["n_children"] -= r["depth"] < shared
                r["n_leaves"] -= r["last"] and not leaf
                now["conv_id"] = min(now["conv_id"], r["conv_id"])
                for c in sums:
                    now[c] += r[c]
                if r["ends"]:
                    state.update(b"," * some + r["ends"])
                    some = True
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now | {"ends_sha256": state.hexdigest()}], schema)

    return run


def _facts(spark: SparkSession, edges: DataFrame) -> dict[int, tuple[int, int, bool]]:
    """What a shard's neighbours tell of its first and last row; two rows a shard."""
    order = Window.orderBy("shard", "pos")
    least = lambda a, b: F.least(F.size(a), F.size(b))
    apart = lambda a, b: F.array_position(F.zip_with(F.slice(a, F.lit(1), least(a, b)), F.slice(b, F.lit(1), least(a, b)), lambda x, y: x == y), False)
    same = lambda a, b: F.when(apart(a, b) == 0, least(a, b)).otherwise(apart(a, b) - 1)
    met = edges.select("shard", "pos", "turns", "words", F.lag("turns").over(order).alias("up"), F.lead("turns").over(order).alias("down"))
    shared = F.when((F.col("pos") == 0) & F.col("up").isNotNull(), same("up", "turns")).otherwise(-1)
    leaf = F.when((F.col("pos") == 1) & F.col("down").isNotNull(), same("turns", "down") < F.size("turns")).otherwise(True)
    rows = met.select("shard", shared.alias("shared"), "words", leaf.alias("leaf")).withColumn("sum", F.when(F.col("shared") > 0, F.aggregate(F.slice("words", F.lit(1), F.col("shared")), F.lit(0).cast("long"), lambda s, w: s + w)).otherwise(0))
    return {r["shard"]: (r["shared"], r["sum"], r["leaf"]) for r in rows.groupBy("shard").agg(F.max("shared").alias("shared"), F.max("sum").alias("sum"), F.min("leaf").alias("leaf")).collect()}


def trie(talks: DataFrame, cells: int = CELLS, shards: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    talks: (conv_id, turn, role, text) as rebuilt() takes them; null roles and texts are empty, other columns are ignored,
    rows without a conv_id belong to no conversation. A conversation without turns is a member of the root. No
    conversations at all: no root, so no rows. Repeated rows are turns of their own.
    """
    spark = talks.sparkSession
    bound_batches(spark, BATCH_ROWS)
    rows = rebuilt(talks.select("conv_id", "turn", "role", "text"))
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, "turns", "conv_id").sortWithinPartitions("turns", "conv_id").withColumn("shard", F.spark_partition_id())
    found = saved(ranged.mapInArrow(_nodes_of_shard(cells), NODE), "trie-nodes")
    facts = _facts(spark, found.where("turns IS NOT NULL"))
    pieces = found.where("key IS NOT NULL").select("key", "shard", "pos", "first", "last", "depth", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "before", "ends")
    joined = pieces.repartition("key").sortWithinPartitions("key", "shard", "pos").mapInArrow(_joined(facts), "key binary, parent binary, depth int, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    joined = saved(joined, "trie-joined")
    whole = found.where("key IS NULL AND depth IS NOT NULL")
    up = joined.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    up = F.broadcast(up) if up.limit(FEW_NODES + 1).count() <= FEW_NODES else up
    own = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    columns = ["parent", F.col("depth").cast("long").alias("depth"), *own]
    nodes = whole.select(*columns, "parent_conv_id").unionByName(joined.select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))).join(up, "parent", "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *own[1:])
