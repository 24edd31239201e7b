"""Classes of near duplicates by the Jaccard similarity of word shingles, exact.

Texts are linked where the sets of their hashed shingles have a Jaccard similarity of at least 4/5; the classes are the
connected components. Candidates come in two ways, and every one is held against the exact similarity.

SimHash fingerprints of the same shingles are searched by multi-index hashing (simhash.links). That finds the nearest copies
at once, and what it settles is not looked at again: only keys whose holders are still apart go on. Texts at 4/5 lie some
ten bits apart, so what it leaves is completed by prefixes: two sets of n and m members, n at most m, share 4/9 of n + m, so in any one order of all shingles the first member that they share
stands among the first n // 9 + 1 of the smaller and the first m // 5 + 1 of the larger: these are a set's keys, and only
sets that share a key so are compared. The order takes shingles that a sample of the texts holds often last, which keeps
passages that many texts share out of the keys; what the sample misses costs time and changes no result.

A key shared by a cloud of near copies would give pairs in the square of its size. So first each holder of a key is
compared with one other, the holder with the fewest members before the key, which is the cloud's middle if it has one,
and the links found join classes; then holders of a key are compared only where their classes differ. Every pair that
shares a key is thus in one class or compared.

Most pairs compared are settled by parities: a set's members each flip one of 2,048 bits, so two sets differ in at least
as many members as their parities differ in bits, and too many rule the pair out. The sets of the others are made again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, saved, unsaved

#: For the order of shingles: one in so many texts is looked at; shingles found so often there go last, so many at most.
SAMPLE_ONE_IN, OFTEN, OFTEN_ROWS = 16, 4, 65_536
PARITY_BITS = 2048


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct signed 64-bit hashes of a text's shingles, ascending; a text of fewer words is one shingle.

    ASCII letters are lower-cased, words are split at ASCII white space; texts without words are alike.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, seed)], dtype="<u8").view("<i8")
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(tokens) - words] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype="<u8").view("<i8"))


def parities(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount(hashes & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def _often(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts hold, ascending, and how many."""

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingles(t, words) for t in batch])

    some = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(SAMPLE_ONE_IN)) == 0).select(text_col).distinct()
    counts = some.select(F.explode(of(text_col)).alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    rows = sorted(map(tuple, counts.orderBy(F.desc("count"), "h").limit(OFTEN_ROWS).collect()))
    return np.array([h for h, _ in rows], dtype=np.int64), np.array([n for _, n in rows], dtype=np.int64)


def _compared(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(a, b) of ``pairs`` of set ids whose sets are similar, as a table; the sets are made again from one text each."""

    @F.pandas_udf("sid long, hashes array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [shingles(t, words) for t in batch]
            yield pd.DataFrame({"sid": [set_id(h) for h in found], "hashes": found})

    # else the join's test for null keys runs the function a second time, in a second Python worker beside each task
    of = of.asNondeterministic()
    side = lambda a, x: sets.select(F.col("sid").alias(a), F.col("n").alias(f"n_{a}"), F.col("bits").alias(x))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)
    pairs = pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").where(9 * apart <= F.col("n_a") + F.col("n_b"))
    pairs = saved(pairs.select("a", "b"), "jaccard-pairs")
    nodes = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    nodes = saved(sets.join(nodes, "sid", "left_semi").select("sid", "first"), "jaccard-nodes")
    # written before the function runs, which else sees all texts
    chosen = saved(docs.select(id_col, text_col).join(nodes.select(F.col("first").alias(id_col)).distinct(), id_col, "left_semi").select(text_col).distinct(), "jaccard-texts")
    texts = chosen.select(of(text_col).alias("s")).select("s.*")
    full = saved(texts.join(nodes, "sid", "left_semi").dropDuplicates(["sid"]), "jaccard-sets")
    left, right = full.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), full.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = saved(pairs.join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "jaccard-alike")
    unsaved(pairs, nodes, chosen, full)
    return alike


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """(a, b) of set ids whose fingerprints differ in three bits at most; copies of a fingerprint meet at the smallest id."""
    from spanframe.llm import simhash

    hubs = saved(sets.groupBy("fp").agg(F.min("sid").alias("hub")), "jaccard-prints")
    same = sets.join(hubs, "fp").where("sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    side = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}"))
    near = simhash.links(hubs.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return same.unionByName(near.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b")))


def _holders(sets: DataFrame) -> DataFrame:
    """(key, sid, n, pos, label, holders, hub, hub_n, hub_pos, hub_label) of the keys that sets of several classes hold.

    hub: the key's set to compare with. label: a set's class, which in ``sets`` is null where it is the set itself. Keys that the sample found often, which hot ones are among, are counted and joined, so that a hot key's holders can be
    split; all others have few holders each, which one shuffle and one sort bring together.
    """
    at = F.posexplode("keys").alias("pos", "key")
    # fewest members before the key, then the larger set, in one number; a cloud's keys mostly pick one hub, so pairs are few
    place = (F.shiftleft(F.col("pos").cast("long"), 32) - F.col("n")).alias("place")
    own = F.coalesce("label", "sid")
    often = sets.where("size(keys) > rare").select("sid", "n", "rare", "label", at).where("pos >= rare").select("key", "sid", "label", place)
    picked = often.groupBy("key").agg(F.count("*").alias("holders"), F.min(F.struct("place", "sid", own.alias("label"))).alias("hub"), F.min(own).alias("low"), F.max(own).alias("high"))
    picked = picked.where("low < high").select("key", "holders", F.col("hub.sid").alias("hub"), F.col("hub.place").alias("hub_place"), F.col("hub.label").alias("hub_label"))
    often = often.join(picked, "key")
    few = sets.select("sid", "n", "rare", "label", at).where("pos < rare").select("key", "sid", "label", place)
    of_key, in_order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("place", "sid")
    first = {"hub": F.first("sid"), "hub_place": F.first("place"), "hub_label": F.first(own)}
    few = few.withColumns({"holders": F.count("*").over(of_key), "low": F.min(own).over(of_key), "high": F.max(own).over(of_key)} | {c: f.over(in_order) for c, f in first.items()})
    few = few.where("low < high").drop("low", "high")
    pos = lambda c: F.shiftright(F.col(c) + F.lit(0xFFFFFFFF), 32)
    n = lambda c: (F.shiftleft(pos(c), 32) - F.col(c)).cast("int")
    ends = [n("place").alias("n"), pos("place").cast("int").alias("pos"), n("hub_place").alias("hub_n"), pos("hub_place").cast("int").alias("hub_pos")]
    return often.unionByName(few).select("key", "sid", own.alias("label"), "holders", "hub", "hub_label", *ends)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, text_hash, class) of every row of ``docs``, whose ids are not null. class: the smallest set id of a component."""
    from spanframe.llm.simhash import components, majority

    bound_batches(docs.sparkSession)
    often, counts = _often(docs, id_col, text_col, words)

    @F.pandas_udf("sid long, n int, fp long, bits array<long>, rare int, keys array<long>")
    def keyed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for hashes in (shingles(t, words) for t in batch):
                rank = np.zeros(len(hashes), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                    rank = np.where(often[at] == hashes, counts[at], 0)
                keys = hashes[np.argsort(rank, kind="stable")[: len(hashes) // 5 + 1]]
                rare = min(int((rank == 0).sum()), len(keys))
                out.append((set_id(hashes), len(hashes), majority(hashes.view("<u8")), parities(hashes), rare, keys))
            yield pd.DataFrame(out, columns=["sid", "n", "fp", "bits", "rare", "keys"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), keyed(text_col).alias("s"))
    rows = saved(rows.select("id", "text_hash", "s.*"), "jaccard-rows")
    parts = [F.first(c).alias(c) for c in ("n", "fp", "bits", "rare", "keys")]
    sets = saved(rows.groupBy("sid").agg(F.min("id").alias("first"), *parts), "jaccard-distinct")
    whole, rows = rows, saved(rows.select("id", "text_hash", "sid"), "jaccard-ids")
    unsaved(whole)
    prints = saved(_by_fingerprint(sets).distinct(), "jaccard-near")
    close = _compared(prints, sets, docs, id_col, text_col, words)
    settled = components(close).select(F.col("node").alias("sid"), "label")
    held = saved(_holders(sets.join(settled, "sid", "left")), "jaccard-held")
    #: x and y of sizes n and m with their first common member at these places can share 4/9 of both.
    near = "9 * least({0} - {1}, {2} - {3}) >= 4 * ({0} + {2})"
    stars = held.where("label <> hub_label AND " + near.format("n", "pos", "hub_n", "hub_pos")).select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b"))
    stars = saved(stars.distinct().join(prints, ["a", "b"], "left_anti"), "jaccard-stars")
    starred = _compared(stars, sets, docs, id_col, text_col, words)
    links, tried = close.unionByName(starred), prints.unionByName(stars)
    labels = components(links)
    labelled = held.where("holders > 2").drop("label").join(labels, F.col("sid") == F.col("node"), "left").select("key", "pos", "sid", "n", F.coalesce("label", "sid").alias("label"))
    labelled = saved(labelled, "jaccard-labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_keys = labelled.join(mixed, "key", "left_semi")
    smaller = open_keys.where("9 * pos <= n").select("key", F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"), F.col("label").alias("label_x"))
    later = "n_x < n OR n_x = n AND x < sid"
    rest = smaller.join(open_keys, "key").where(f"({later}) AND label <> label_x AND " + near.format("n", "pos", "n_x", "pos_x"))
    rest = rest.select(F.least("x", "sid").alias("a"), F.greatest("x", "sid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _compared(rest, sets, docs, id_col, text_col, words)
    if more.take(1):
        labels = components(links.unionByName(more))
    unsaved(sets, prints, close, held, stars, starred, labelled, more)
    return rows.join(labels, rows.sid == labels.node, "left").select("id", "text_hash", F.coalesce("label", "sid").alias("class"))
