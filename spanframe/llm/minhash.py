"""Near duplicates by MinHash: banded candidates, sequential Bayesian verification, exact confirmation on full sets.

Documents are sets of word shingles; equal sets are one from the start. A set's signature has for each of 256 hash
functions 16 bits of the smallest value. Sets that agree in all eight places of one of 32 bands are candidates: of pairs at
a similarity of 0.85, one in 25,000 shares no band, and fewer of more similar pairs.

Candidates are compared a batch of places at a time. With m of n places equal and any similarity as likely beforehand, the
similarity's posterior is Beta(m + 1, n - m + 1); a pair goes as soon as the posterior leaves less than the chosen miss
probability to the threshold. What survives all batches is confirmed on the full sets, made again from one text each.

A band value that a cloud of near copies holds would give pairs in the square of its size. So each holder is first
compared with one other, the holder that meets the most sets over all its bands, which is a cloud's middle if it has
one; the links found make classes. Only sets that share a band with another class are left, and those of them that can
be links at all meet by their rarest shingles. Each candidate pair is thus compared, ruled out or known to be in one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, saved, unsaved


@dataclass(frozen=True)
class MinHashParams:
    """numerator / denominator: the similarity of links. miss: the chance, in each batch, that a pair at it is pruned."""

    words: int = 3
    numerator: int = 85
    denominator: int = 100
    bands: int = 32
    places: int = 8
    batch: int = 32
    miss: float = 1e-7
    seed: int = 42


def shingles(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; a text of fewer words is one shingle, one of none has none.

    ASCII letters are lower-cased, words are split at ASCII white space.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(tokens) - words] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype="<u8"))


def signature(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> bytes:
    """16 bits of the smallest value of each hash function over a set that isn't empty."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):  # the values of a long text are not held all at once
        np.minimum(least, (hashes[at : at + 2048, None] * factors + terms).min(axis=0), out=least)
    return (least >> np.uint64(24)).astype("<u2").tobytes()


def _functions(params: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(params.seed)
    a, b = (random.integers(0, 1 << 64, params.bands * params.places, np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def fewest_equal(params: MinHashParams) -> list[tuple[int, int]]:
    """(n, m) for each batch: of n places at least m must be equal, else the threshold has less than ``miss`` of the posterior.

    That Beta(m + 1, n - m + 1) exceeds t is as likely as at most m successes in n + 1 trials of chance t.
    """
    t, out = params.numerator / params.denominator, []
    for n in range(params.batch, params.bands * params.places + 1, params.batch):
        total, m = 0.0, 0
        while m <= n:
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t)) if 0 < t < 1 else 0.0
            if total >= params.miss:
                break
            m += 1
        out.append((n, min(m, n)))
    return out


def _sets(params: MinHashParams):
    factors, terms = _functions(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, marks, known = [], [], [], {}
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, params.words, params.seed)
                sid = xxhash.xxh3_128_digest(hashes.tobytes())
                if sid not in known:
                    known[sid] = signature(hashes, factors, terms) if len(hashes) else b""
                sizes.append(len(hashes))
                ids.append(sid)
                marks.append(known[sid])
            out = [batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["id", "text_hash", "n", "sid", "signature"])

    return run


def _likely(params: MinHashParams):
    """Keeps the pairs that no batch of places rules out."""
    bounds, step = fewest_equal(params), params.batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, params.bands * params.places) for c in ("x", "y"))
            left, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, fewest in bounds:
                equal[left] += (x[left, n - step : n] == y[left, n - step : n]).sum(axis=1)
                left = left[equal[left] >= fewest]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(left)), batch.column("b").take(pa.array(left))], ["a", "b"])

    return run


def _full(params: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, params.words, params.seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()), pa.array([h.view("<i8") for h in found], pa.list_(pa.int64()))], ["sid", "hashes"])

    return run


def _full_sets(nodes: DataFrame, sets: DataFrame, texts: DataFrame, params: MinHashParams) -> DataFrame:
    """(node, hashes) of ``nodes``, made again from one text each, as a table."""
    needed = saved(sets.join(nodes, "node", "left_semi").select("node", "sid", "text_hash"), "minhash-needed")
    chosen = texts.join(needed.select("text_hash").distinct(), "text_hash", "left_semi")
    hashes = chosen.select("text").mapInArrow(_full(params), "sid binary, hashes array<bigint>").groupBy("sid").agg(F.first("hashes").alias("hashes"))
    full = saved(hashes.join(needed, "sid").select("node", "hashes"), "minhash-full")
    unsaved(needed)
    return full


def _linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, params: MinHashParams, full: DataFrame | None = None) -> DataFrame:
    """(a, b) of ``pairs`` of nodes whose sets are similar, as a table. full: the full sets, if they are made already."""
    side = lambda a, x: sets.select(F.col("node").alias(a), F.col("signature").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    likely = saved(both.select("a", "b", "x", "y").mapInArrow(_likely(params), "a bigint, b bigint"), "minhash-likely")
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    made = _full_sets(nodes, sets, texts, params) if full is None else full
    x, y = made.select(F.col("node").alias("a"), F.col("hashes").alias("x")), made.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    met = likely.join(x, "a").join(y, "b").select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s"))
    links = saved(met.where(f"{params.denominator} * c >= {params.numerator} * (s - c)").select("a", "b"), "minhash-links")
    unsaved(likely, *([made] if full is None else []))
    return links


def _mixed(held: DataFrame) -> DataFrame:
    """The rows of ``held`` whose key has holders of several classes."""
    mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return held.join(mixed, "key", "left_semi")


def _across(classed: DataFrame, stars: DataFrame, sets: DataFrame, texts: DataFrame, params: MinHashParams) -> DataFrame:
    """(a, b) of the links between sets of different classes that share a band, as a table. classed: (key, node, n, label).

    Sets of a cloud may lie close below the threshold, all of them apart, so that their bands pair them all. Here the full
    sets decide: with shingles in order of how many of these sets hold them, rarest first, the first that two sets share
    bounds what they can share by what is left after it, and stands early in both. So sets meet by their first shingles
    only, without those that have too few left for the smallest set of the key; all pairs that can be links are among them.
    """
    nodes = saved(_mixed(classed).select("node", "n", "label").distinct(), "minhash-apart")
    full = _full_sets(nodes.select("node"), sets, texts, params)
    members = full.select("node", F.explode("hashes").alias("h"))
    many = members.groupBy("h").agg(F.count("*").alias("c"))
    ranked = members.join(many, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    early = F.expr(f"slice(s, 1, cast(size(s) - (size(s) * {params.numerator}L + {params.denominator - 1}) div {params.denominator} + 1 as int))")
    keys = ranked.select("node", F.posexplode(early).alias("pos", "s")).where("s.c > 1").select("node", F.col("s.h").alias("key"), "pos")
    enough = lambda o, n, m: f"{params.denominator} * {o} >= {params.numerator} * ({n} + {m} - {o})"
    keyed = saved(keys.join(nodes, "node").withColumn("most", F.col("n") - F.col("pos")), "minhash-keys")
    least = keyed.groupBy("key").agg(F.min("n").alias("least"))
    able = keyed.join(least, "key").where(enough("most", "n", "greatest(least, most)")).select("key", "node", "n", "most", "label")
    able = saved(_mixed(able), "minhash-able")
    other = able.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("most").alias("most_b"), F.col("label").alias("of"))
    pairs = able.join(other, "key").where(f"node < b AND label <> of AND {enough('least(most, most_b)', 'n', 'm')}").select(F.col("node").alias("a"), "b").distinct()
    links = _linked(pairs.join(stars, ["a", "b"], "left_anti"), sets, texts, params, full)
    unsaved(nodes, full, keyed, able)
    return links


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) of the nodes of links(a, b), as a table: equal labels in a component, each label one of its nodes.

    Each round points nodes to their smallest neighbour and contracts the links by it, until no link is left. The smallest
    node of a component only gains, so the links shrink each round.
    """
    edges = saved(links.select("a", "b").where("a <> b"), "component-edges")
    told = None
    for _ in range(max_rounds):
        if not edges.take(1):
            if told is None:
                told = saved(edges.select(F.col("a").alias("node"), F.col("b").alias("label")), "component-labels")
            unsaved(edges)
            return told
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "component-up")
        hop = up.select(F.col("a").alias("via"), F.col("up").alias("far"))
        near = saved(up.join(hop, F.col("up") == F.col("via")).select(F.col("a").alias("node"), F.col("far").alias("label")), "component-near")
        to = lambda c: near.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to"))
        less = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        less = saved(less, "component-edges")
        if told is None:
            now = near
        else:  # what a node was told before leads on to what that was told now
            step = near.select(F.col("node").alias("via"), F.col("label").alias("far"))
            now = saved(told.join(step, F.col("label") == F.col("via"), "left").select("node", F.coalesce("far", "label").alias("label")), "component-labels")
            unsaved(told, near)
        unsaved(edges, up)
        edges, told = less, now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _held(sets: DataFrame, params: MinHashParams) -> DataFrame:
    """(key, node, n, many): the band values that several sets hold, and how many hold them, as a table."""
    width = 2 * params.places
    keys = F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * width + 1, F.lit(width))))
    rows = sets.select("node", "n", F.explode(keys).alias("key"))
    many = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    return saved(rows.join(many, "key"), "minhash-held")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHashParams = MinHashParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    component_id: the smallest id that is reachable over links of similarity 85 / 100 or more, the row's own included; kept: whether it is
    the row's own. Texts without words, null ones included, have no shingles and link with nothing, not with each other.
    Repeated rows each get a row, of which all or none are kept. Null ids are never a component's id unless all of its ids
    are null; a null id isn't kept unless its component has no other. Other columns are ignored; an empty table gives an
    empty result.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = dict(docs.dtypes)[id_col]
    rows = saved(texts.select("id", "text_hash", "text").mapInArrow(_sets(params), f"id {kind}, text_hash bigint, n bigint, sid binary, signature binary"), "minhash-rows")
    parts = [F.first("n").alias("n"), F.min("id").alias("first"), F.min("text_hash").alias("text_hash"), F.first("signature").alias("signature")]
    sets = saved(rows.where("n > 0").groupBy("sid").agg(*parts).withColumn("node", F.monotonically_increasing_id()), "minhash-sets")
    held = _held(sets, params)
    meets = held.groupBy("node").agg(F.sum("many").alias("meets"))
    hubs = held.select("key", "node", "n").join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    sized = f"{params.denominator} * least(n, hub_n) >= {params.numerator} * greatest(n, hub_n)"
    stars = held.select("key", "node", "n").join(hubs, "key").where(f"node <> hub AND {sized}").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    stars = saved(stars.distinct(), "minhash-stars")
    links = _linked(stars, sets, texts, params)
    labels = components(links)
    classed = held.where("many > 2").select("key", "node", "n").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    classed = saved(classed, "minhash-classed")
    more = _across(classed, stars, sets, texts, params)
    if more.take(1):
        unsaved(labels)
        labels = components(links.unionByName(more))
    of_set = sets.select("sid", "node", "first").join(labels, "node", "left").select("sid", "first", F.coalesce("label", "node").alias("label"))
    of_set = saved(of_set, "minhash-classes")
    firsts = of_set.groupBy("label").agg(F.min("first").alias("component_id"))
    known = saved(of_set.join(firsts, "label").select("sid", "component_id"), "minhash-known")
    unsaved(sets, held, stars, links, more, labels, classed, of_set)
    out = rows.select("id", "n", "sid").join(known, "sid", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
