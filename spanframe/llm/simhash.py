"""SimHash near-duplicate detection by multi-index hashing.

A text's fingerprint has a bit set where over half of the 64-bit hashes of its word shingles have it. Fingerprints that
differ in few bits link documents; the classes are the connected components. Links are searched by multi-index hashing:
a fingerprint is cut into two 32-bit segments, and of two fingerprints that differ in at most three bits one segment
differs in at most one bit. So each distinct fingerprint looks up the ball of radius one (33 values) around each of its
segments in the table of segments and the whole distances of the matches are verified.

A segment shared by very many fingerprints (a cloud of near copies) would give pairs in the square of its size. There
the other segment takes part in the key instead: each fingerprint writes the balls of radius one and two around its
other segment, and whoever meets at a point is linked to a fingerprint that is within one bit of the point. Two
fingerprints that differ in at most three bits always meet so, and all links made so are true ones, hence the
components are the same and the work stays in proportion to the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, fresh_name, saved

#: Segment values held by more distinct fingerprints than this are searched through meeting points.
CROWDED = 256
LOW = 0xFFFFFFFF


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text; 0 for null and for a text without words.

    ASCII letters are lower-cased, words are split at ASCII white space, shingles count as often as they occur.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens) - words + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number that has a bit set where over half of ``hashes`` have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # the bits of a long text are not held all at once
        block = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([simhash(t, words, seed) for t in batch], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def _ball(value: Column, radius: int) -> Column:
    """The 32-bit values that differ from ``value`` in exactly ``radius`` bits (0, 1 or 2), as an array."""
    one = [1 << i for i in range(32)]
    masks = {0: [0], 1: one, 2: [a | b for a in one for b in one if a < b]}[radius]
    mask = F.array(*[F.lit(m).cast("long") for m in masks]) if radius < 2 else F.expr(
        "flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    )
    return F.transform(mask, lambda m: value.bitwiseXOR(m))


def _segments() -> Column:
    fp = F.col("fp")
    hi, lo = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(LOW).cast("long"))
    entry = lambda seg, val, other: F.struct(F.lit(seg).cast("tinyint").alias("seg"), val.alias("val"), other.alias("other"))
    return F.explode(F.array(entry(0, hi, lo), entry(1, lo, hi)))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints ``fps(fp)`` whose components are those of distance 3 or less."""
    table = saved(fps.select("fp", _segments().alias("s")).select("fp", "s.*"), "simhash-table")
    crowds = saved(table.groupBy("seg", "val").count().where(F.col("count") > crowded).select("seg", "val"), "simhash-crowds")
    key = ["seg", "val"]
    some = bool(crowds.take(1))
    calm = table.join(crowds, key, "left_anti") if some else table
    near = calm.select("fp", "seg", F.explode(_ball(F.col("val"), 1)).alias("val"))
    probes = calm.select("fp", "seg", "val").unionByName(near)  # what a crowd's members have beside it meets them below
    found = (
        probes.withColumnRenamed("fp", "a")
        .join(calm.select("seg", "val", F.col("fp").alias("b")), key)
        .where("a <> b AND bit_count(a ^ b) <= 3")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    if not some:
        return found.distinct()
    within = table.join(crowds, key, "left_semi")
    rims = crowds.select("seg", F.col("val").alias("crowd"), F.explode(_ball(F.col("val"), 1)).alias("val"))
    beside = table.join(rims, key).select("fp", "seg", "other", F.col("crowd").alias("val"))
    point = lambda df, mode, centre, r: df.select(
        F.lit(mode).cast("tinyint").alias("mode"), "seg", "val", F.explode(_ball(F.col("other"), r)).alias("point"), "fp", F.lit(centre).alias("centre")
    )
    met = point(within, 0, True, 0)
    for part in (
        point(within, 0, True, 1), point(within, 0, False, 2), point(within, 1, True, 0), point(within, 1, True, 1),
        point(beside, 1, False, 0), point(beside, 1, False, 1),
    ):
        met = met.unionByName(part)
    at = ["mode", "seg", "val", "point"]
    hubs = met.groupBy(*at).agg(F.min(F.when(F.col("centre"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("n > 1 AND hub IS NOT NULL")
    stars = met.join(hubs, at).where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    return found.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of ``edges(a, b)``.

    Each round takes the smallest label of the neighbours and then the label's own label, so chains shorten by half.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        told = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        lower = labels.select("node", "label", F.col("label").alias("old")).unionByName(told.withColumn("old", F.lit(None).cast("long")))
        lower = lower.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        stepped = lower.join(hop, F.col("label") == F.col("via"), "left").select("node", F.least("label", "far").alias("label"), "old")
        stepped = saved(stepped, "labels")
        labels = stepped.select("node", "label")
        if not stepped.where("label <> old").take(1):
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    fingerprint: 16 hex digits. component_id: the smallest id that is reachable over links of at most three differing
    bits. A null text is an empty one; texts without words have fingerprint zero and link like others. Repeated rows
    each get a row. Null ids are never a component's id unless all of its ids are null. Other columns are ignored; an
    empty table gives an empty result.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    fps = saved(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = components(links(fps.select("fp"), crowded))
    known = fps.join(labels, fps.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    known = saved(known, "classes")
    firsts = known.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = known.join(firsts, "label").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near duplicates the row with the smallest id.

    Near duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: candidates come
    from fingerprints of these shingles by multi-index hashing and are completed to all such texts (jaccard.classes). A
    row that repeats another's id stays once; rows without an id can't be told apart and all stay.
    All columns stay.
    """
    from pyspark.sql import Window

    from spanframe.llm import jaccard

    classes = jaccard.classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    key, rank = fresh_name(docs, "_kept"), fresh_name(docs, "_rank")
    stay = classes.groupBy("class").agg(F.min("id").alias(key)).select(key).distinct()
    ranked = docs.join(stay, docs[id_col] == stay[key]).withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))))
    return ranked.where(F.col(rank) == 1).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
