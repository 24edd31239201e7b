"""Quality rules: log-likelihood ratio of hashed word n-grams between a trusted target and the raw corpus.

Two multinomials over hashed word unigrams and bigrams are counted: the raw one over every document, the target one over
a bounded sample of documents labelled good. A document's score is the mean log ratio of its n-grams, shrunk for short
texts, and every document is held against one threshold, so the same text always gets the same verdict. The threshold
comes from the labelled documents that the target did not take: the one that rejects most bad documents while it
rejects at most a set share of good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, bounded_sample, fresh_name, saved

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LlrParams:
    #: n-gram buckets, a power of two: half for unigrams, half for bigrams.
    buckets: int = 1 << 18
    #: Labelled rows used at most; the rows of smallest id hash are taken. Half count towards the target, half set the threshold.
    sample_rows: int = 40_000
    #: Pseudo-counts by which a bucket's ratio is drawn towards one.
    prior: float = 4.0
    #: Log ratios are drawn towards zero by this much, so that those near zero, which carry noise more than evidence, vanish.
    shrink: float = 0.5
    #: n-grams of ratio one added to each text, so that few n-grams don't decide.
    padding: float = 8.0
    #: Share of good documents that the threshold may reject.
    false_rejects: float = 0.003
    #: Threshold where labels have no bad documents to fit it to.
    default_threshold: float = -1.0


BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _coded(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number in the order of first occurrence, and the distinct words."""
    distinct = list(dict.fromkeys(words))
    number = {w: i for i, w in enumerate(distinct)}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), distinct


def _repeated(ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """How many words stand in a window of five words that occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0

    window = ids[:n].astype(np.uint64)
    for k in range(1, width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64)
    window.sort()
    if not (window[1:] == window[:-1]).any():  # equal windows would have equal hashes
        return 0

    def merged(a: np.ndarray, b: np.ndarray, base: int) -> tuple[np.ndarray, int]:  # equal pairs get equal numbers
        kinds, number = np.unique(a * base + b, return_inverse=True)
        return number, len(kinds)

    two, kinds = merged(ids[:-1], ids[1:], distinct)
    if kinds == len(two):
        return 0
    four, kinds = merged(two[:-2], two[2:], kinds)
    if kinds == len(four):
        return 0
    five, kinds = merged(four[:-1], ids[4:], max(distinct, 1))
    twice = np.bincount(five, minlength=kinds)[five] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_rules(text: str, ids: np.ndarray, distinct: int) -> tuple[int, int, int, int, int, bool]:
    n = len(ids)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = _repeated(ids, distinct)
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        n < 10 or 100 * repeated > 20 * n,
    )


def _buckets(ids: np.ndarray, distinct: list[bytes], size: int) -> np.ndarray:
    """Buckets of all unigrams and bigrams of a text."""
    if not distinct:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(crc32, distinct), np.uint64, len(distinct))[ids]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
    half = size // 2
    return np.concatenate([hashes.astype(np.int64) & (half - 1), (pairs.astype(np.int64) & (half - 1)) + half])


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def count_ngrams(docs: DataFrame, text_col: str, target_col: str, params: LlrParams) -> DataFrame:
    """(bucket, raw, target): counts over all rows, and over those whose ``target_col`` is true."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(params.buckets, np.int64), np.zeros(params.buckets, np.int64)
        for frame in frames:
            found = [_buckets(*_coded(_words(text or "")), params.buckets) for text in frame["text"]]
            raw += np.bincount(np.concatenate(found), minlength=params.buckets)
            if trusted := [x for x, yes in zip(found, frame["target"]) if yes]:
                target += np.bincount(np.concatenate(trusted), minlength=params.buckets)
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})

    parts = docs.select(F.col(text_col).alias("text"), F.col(target_col).alias("target")).mapInPandas(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, params: LlrParams) -> np.ndarray:
    """The log ratio of each bucket (as many numbers as buckets, whatever the corpus)."""
    raw, target = np.zeros(params.buckets), np.zeros(params.buckets)
    found = counts.toArrow()
    at = found["bucket"].to_numpy()
    raw[at], target[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    if not target.sum():
        return np.zeros(params.buckets)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + params.prior) / (expected + params.prior))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - params.shrink, 0)


def _scored(docs: DataFrame, text_col: str, ratios: np.ndarray, params: LlrParams):
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))
    size, padding = params.buckets, params.padding

    @F.pandas_udf(f"score double, {BASE_SCHEMA}")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value
        names = ["score", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        for batch in texts:
            rows = []
            for text in batch:
                text = text or ""
                ids, distinct = _coded(_words(text))
                found = _buckets(ids, distinct, size)
                rows.append((float(table[found].sum() / (len(found) + padding)), *base_rules(text, ids, len(distinct))))
            yield pd.DataFrame(rows, columns=names)

    return score(F.col(text_col))


@dataclass
class LlrModel:
    ratios: np.ndarray
    threshold: float
    params: LlrParams


def threshold_of(scores: list[tuple[float, bool]], params: LlrParams) -> float:
    """The threshold that rejects (scores below it) most bad rows less good ones, with at most the allowed share of good ones."""
    good = np.sort([s for s, ok in scores if ok])
    bad = np.sort([s for s, ok in scores if not ok])
    if not len(good) or not len(bad):
        return params.default_threshold
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = (cuts[:-1] + cuts[1:]) / 2
    if not len(cuts):
        return params.default_threshold
    lost = np.searchsorted(good, cuts) / len(good)
    caught = np.searchsorted(bad, cuts) / len(bad)
    value = np.where(lost <= params.false_rejects, caught - lost, -1)
    return float(cuts[int(np.argmax(value))]) if value.max() >= 0 else params.default_threshold


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LlrParams = LlrParams()) -> LlrModel:
    """labels: (doc_id, quality, toxic); a row is good if quality is 1 and toxic is not 1, bad if either says so."""
    bound_batches(docs.sparkSession)
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    judged = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), (~bad).alias("_good"))
    judged = judged.groupBy("_id").agg(F.min("_good").alias("_good"))
    judged = saved(bounded_sample(judged, "_id", params.sample_rows).select("_id", "_good", (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)) == 0).alias("_fit")), "labelled")
    work = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    target = work.join(F.broadcast(judged.where("_fit AND _good")), F.col("_doc") == F.col("_id"), "left")
    ratios = log_ratios(count_ngrams(target.withColumn("_target", F.col("_id").isNotNull()), "_text", "_target", params), params)
    held = work.join(F.broadcast(judged.where("NOT _fit")), F.col("_doc") == F.col("_id"))
    rows = held.select(_scored(held, "_text", ratios, params).getField("score").alias("score"), "_good").collect()
    return LlrModel(ratios, threshold_of([(r[0], r[1]) for r in rows], params), params)


def judge(docs: DataFrame, model: LlrModel, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    A null text is an empty one: it has no words and fails the base rules. Columns of ``docs`` with these names give
    way to the operator's. Repeated rows get equal verdicts; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    own = ["score", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    held = fresh_name(docs, "_judged")
    done = docs.withColumn(held, _scored(docs, text_col, model.ratios, model.params))
    result = F.col(held)
    columns = [F.col(c) for c in docs.columns if c.lower() not in own]
    return done.select(*columns, *[result[c].alias(c) for c in own[:-1]], (~result["base_failed"] & (result["score"] >= F.lit(model.threshold))).alias("kept"))
