"""Quality classifier from weak labels: a label model over heuristic labellers, and a hashed linear scorer trained on it.

Two targets are modelled alike: ``junk`` (text of low quality) and ``toxic``. For each, several heuristic labellers vote
for, against or abstain on every document. Expectation-maximisation over the counts of vote patterns, of which there are
few however large the corpus, estimates how often each labeller is right about either class and so weighs overlapping
votes. The posterior of each document's pattern then labels a bounded sample on which a linear scorer over hashed words,
word beginnings and text shapes is trained; the scorer judges every document, also those on which all labellers abstain.

The toxic word lists of two labellers are learnt from a bounded sample of labelled rows, so no word list is built in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, bounded_sample, fresh_name, saved

SYMBOLS = "#*$%&|<>"
#: Value of a shape feature; words have about one at a share of two in a hundred.
SHAPE = 8.0
#: Doubled marks.
MARKS = ["!!", "??", "**", "##", "&&", "%%", "$$", "~~", "==", "@@"]
TRIM = b".,;:!?\"'()[]"


@dataclass(frozen=True)
class WeakParams:
    #: Labelled rows used at most (those of smallest id hash): for the toxic lists and as votes of the labelled-table labeller.
    labelled_rows: int = 20_000
    #: Documents at most of each stratum (junk or not, toxic or not) on which the scorer is trained (those of smallest id hash).
    stratum_rows: int = 1_000
    #: Hash buckets of the scorer; a power of two.
    buckets: int = 1 << 20
    #: Entries at most in each learnt toxic list.
    list_rows: int = 2_000
    #: A list entry is so many times more often in toxic documents of the sample than in others, by at least this G statistic.
    list_lift: float = 12.0
    list_evidence: float = 25.0
    #: Documents whose junk or toxic probability is at least this are rejected.
    reject_at: float = 0.7
    em_rounds: int = 60
    #: Features in fewer training documents get no weight.
    least_documents: int = 12
    epochs: int = 100
    l2: float = 1e-5


JUNK = ["symbols", "capitals", "repeats", "cells", "lines", "marks", "known_junk"]
TOXIC = ["words", "beginnings", "several", "known_toxic"]


@dataclass(frozen=True)
class Lists:
    words: frozenset[bytes] = frozenset()
    beginnings: frozenset[bytes] = frozenset()


@dataclass
class Text:
    """What the labellers and the scorer see of a text.

    bare: its distinct words (split at ASCII white space, as UTF-8) in lower case without outer punctuation; counts: how
    often each occurs; n: the number of words; shape: shares that show what the text looks like.
    """

    bare: list[bytes]
    counts: np.ndarray
    n: int
    shape: dict[str, float]


def looked_at(text: str | None) -> Text:
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    counts = np.bincount(ids, minlength=len(distinct))
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    upper = [number[w] for w in distinct if w.isupper() and len(w) > 1]
    shape = {
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "capitals": float(counts[upper].sum()) / n,
        "runs": float((ids[1:] == ids[:-1]).sum()) / n,
        "cells": float(counts[number[b"|"]]) / n if b"|" in number else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        "many_lines": float(len(lines) > 3),
        "marks": sum(map(text.count, MARKS)) / n,
        "repeated": repeated_share(ids) if len(words) > 14 else 0.0,
    }
    return Text([w.lower().strip(TRIM) for w in distinct], counts, len(words), shape)


def repeated_share(ids: np.ndarray, width: int = 5) -> float:
    """The share of five-word windows that equal an earlier one."""
    window = ids[: len(ids) - width + 1].astype(np.uint64)
    for k in range(1, width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k].astype(np.uint64)
    window.sort()
    return float((window[1:] == window[:-1]).mean())


def votes(text: str | None, lists: Lists, known_junk: int | None, known_toxic: int | None) -> tuple[str, str]:
    """The votes of the labellers of JUNK and of TOXIC: 1 for, 0 against, - where a labeller abstains."""
    t = looked_at(text)
    s = t.shape
    known = lambda x: "-" if x is None else "1" if x else "0"
    if not t.n:
        return "-" * (len(JUNK) - 1) + known(known_junk), "-" * (len(TOXIC) - 1) + known(known_toxic)
    bit = lambda yes: "1" if yes else "0"
    junk = "".join([
        bit(s["symbols"] > 0.15),
        bit(s["capitals"] > 0.4) if t.n > 4 else "-",
        bit(s["repeated"] > 0.3 or s["runs"] > 0.2) if t.n > 14 else "-",
        bit(s["cells"] > 0.15),
        bit(s["lines"] > 0.45) if s["many_lines"] else "-",
        bit(s["marks"] > 0.3),
        known(known_junk),
    ])
    hits = len(lists.words.intersection(t.bare))
    begun = sum(w[:4] in lists.beginnings or w[:5] in lists.beginnings for w in t.bare)
    return junk, "".join([bit(hits), bit(begun), bit(hits + begun > 1), known(known_toxic)])


def _copies_key(text: str | None) -> int:
    """The smallest hash of the three-word shingles of a text: mostly equal for near copies."""
    words = (text or "").lower().split()
    return min((crc32(" ".join(x).encode("utf-8", "replace")) for x in zip(words, words[1:], words[2:])), default=crc32(" ".join(words).encode("utf-8", "replace")))


def learn_lists(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, params: WeakParams) -> Lists:
    """Words and word beginnings of toxic documents of the labelled sample that its other documents all but lack."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: Counter = Counter()
            for text, toxic in zip(frame["text"], frame["toxic"]):
                bare = {w.lower().strip(TRIM) for w in set((text or "").encode("utf-8", "replace").split())}
                starts = {w[:k] for w in bare for k in (4, 5) if len(w) > k}
                for kind, found in ((0, bare), (1, starts)):
                    rows.update((kind, w, bool(toxic)) for w in found)
            yield pd.DataFrame([(k, w, n * x, n * (not x)) for (k, w, x), n in rows.items()], columns=["kind", "term", "bad", "good"])

    @F.pandas_udf("long")
    def copies_key(texts: pd.Series) -> pd.Series:
        return pd.Series([_copies_key(t) for t in texts], dtype="int64")

    sample = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(
        F.broadcast(labelled.where("toxic IS NOT NULL").select(F.col("_id").alias("_doc"), (F.col("toxic") == 1).alias("toxic"))), "_doc"
    )
    # of copies one counts, else the words of a document that was copied often would pass for words of its class
    sample = saved(sample.select("text", "toxic", copies_key("text").alias("key")), "weak-sample").dropDuplicates(["key", "toxic"])
    found = sample.select("text", "toxic").mapInPandas(spread, "kind int, term binary, bad long, good long")
    sizes = sample.agg(F.sum(F.col("toxic").cast("long")), F.sum((~F.col("toxic")).cast("long"))).first()
    bad, good = max(1, sizes[0] or 0), max(1, sizes[1] or 0)
    total = found.groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = (F.col("bad") / F.lit(float(bad))) / ((F.col("good") + F.lit(0.5)) / F.lit(float(good)))
    both = F.col("bad") + F.col("good")
    against = lambda n, share: F.col(n) * F.log(F.greatest(F.col(n), F.lit(1e-9)) / (both * F.lit(share)))
    evidence = 2 * (against("bad", bad / (bad + good)) + against("good", good / (bad + good)))
    picked = total.where(F.length("term") > 2).where((lift >= params.list_lift) & (evidence >= params.list_evidence))
    lists = []
    for kind in (0, 1):
        rows = picked.where(F.col("kind") == kind).orderBy(F.desc("bad"), "term").limit(params.list_rows).collect()
        lists.append(frozenset(bytes(r["term"]) for r in rows))
    return Lists(*lists)


def _stratum(p: tuple[float, float]) -> int:
    return 2 * (p[0] >= 0.5) + (p[1] >= 0.5)


@dataclass
class LabelModel:
    """Class prior, and each labeller's chance to vote for, given the class."""

    prior: float
    hit: np.ndarray
    false_hit: np.ndarray

    def posterior(self, pattern: str) -> float:
        log = np.log(self.prior) - np.log(1 - self.prior)
        for j, v in enumerate(pattern):
            if v == "1":
                log += np.log(self.hit[j]) - np.log(self.false_hit[j])
            elif v == "0":
                log += np.log(1 - self.hit[j]) - np.log(1 - self.false_hit[j])
        return float(1 / (1 + np.exp(-np.clip(log, -50, 50))))


def fit_label_model(patterns: list[tuple[str, int]], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over (vote pattern, how many documents).

    The last labeller is the labelled table: the start believes it where it votes, else any vote for the class.
    """
    width = len(patterns[0][0]) if patterns else 0
    n = np.array([c for _, c in patterns], float)
    yes = np.array([[v == "1" for v in p] for p, _ in patterns], float).reshape(len(patterns), width)
    no = np.array([[v == "0" for v in p] for p, _ in patterns], float).reshape(len(patterns), width)
    if not n.sum():
        return LabelModel(0.05, np.full(width, 0.5), np.full(width, 0.05))
    q = np.where(yes[:, -1] + no[:, -1] > 0, 0.02 + 0.88 * yes[:, -1], np.where(yes.any(axis=1), 0.9, 0.02))
    model = LabelModel(0.05, np.full(width, 0.5), np.full(width, 0.05))
    for _ in range(rounds):
        w1, w0 = n * q, n * (1 - q)
        prior = float(np.clip((w1.sum() + 1) / (n.sum() + 20), 1e-4, 0.5))
        hit = (w1 @ yes + 1) / (w1 @ (yes + no) + 2)
        false_hit = (w0 @ yes + 0.02) / (w0 @ (yes + no) + 20)
        # a labeller that votes for says at least as much for the class as against it
        model = LabelModel(prior, np.clip(np.maximum(hit, false_hit), 1e-6, 1 - 1e-3), np.clip(false_hit, 1e-6, 0.5))
        q = np.array([model.posterior(p) for p, _ in patterns])
    return model


def features(text: str | None, lists: Lists, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: bucket numbers and values.

    Words and their first four and five bytes: the value of each occurrence is its share of the text, drawn towards zero
    in short texts. Shapes: one feature for each tenth reached; listed words: one for each step that their share reaches.
    """
    t = looked_at(text)
    keys = []
    for name in ("symbols", "capitals", "runs", "cells", "lines", "marks", "repeated"):
        keys += [f"s {name} {step}" for step in range(1, int(min(t.shape[name], 1.0) * 10) + 1)]
    found = [i for i, w in enumerate(t.bare) if w[:4] in lists.beginnings or w[:5] in lists.beginnings or w in lists.words]
    listed = int(t.counts[found].sum())
    keys += [f"t {step}" for step in (1, 2, 5, 10, 20, 50) if listed > 1 and 1000 * listed >= step * t.n]
    at = [crc32(w) for w in t.bare] + [crc32(w[:4], 4) for w in t.bare] + [crc32(w[:5], 5) for w in t.bare] + [crc32(k.encode()) for k in keys]
    value = np.concatenate([np.tile(t.counts * (50 / (t.n + 30)), 3), np.full(len(keys), SHAPE)])
    return np.array(at, np.int64) & (buckets - 1), value.astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], params: WeakParams) -> np.ndarray:
    """Weights (2, buckets + 1), the last column the bias: logistic regression on soft labels, by full-batch Adagrad steps.

    rows: bucket numbers, values, the junk and toxic probability, and the weight of each training document.
    """
    weights = np.zeros((2, params.buckets + 1))
    if not rows:
        weights[:, -1] = -5
        return weights
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    column = np.concatenate([r[0] for r in rows]).astype(np.int32)
    value = np.concatenate([r[1] for r in rows]).astype(np.float32)
    common = np.bincount(column, minlength=params.buckets) >= min(params.least_documents, len(rows))
    number = np.cumsum(common) - 1
    stay = common[column]
    owner, column, value = owner[stay], number[column[stay]].astype(np.int32), value[stay]
    used = int(common.sum())
    labels = np.array([r[2] for r in rows])
    share = np.array([r[3] for r in rows])
    share /= share.sum()
    for k in range(2):
        w, bias, seen, seen_bias = np.zeros(used), -2.0, np.full(used, 1e-10), 1e-10
        for _ in range(params.epochs):
            z = np.bincount(owner, weights=value * w.astype(np.float32)[column], minlength=len(rows)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[:, k]) * share
            grad = np.bincount(column, weights=value * error.astype(np.float32)[owner], minlength=used) + params.l2 * w
            seen += grad * grad
            w -= 0.3 * grad / np.sqrt(seen)
            g = error.sum()
            seen_bias += g * g
            bias -= 0.3 * g / np.sqrt(seen_bias)
        weights[k, np.flatnonzero(common)], weights[k, -1] = w, bias
    return weights


@dataclass
class Classifier:
    weights: np.ndarray
    params: WeakParams
    junk_model: LabelModel | None = None
    toxic_model: LabelModel | None = None
    lists: Lists = field(default_factory=Lists)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: WeakParams = WeakParams()) -> Classifier:
    """labels: (doc_id, quality, toxic). Rows without an id take part in the label model but not in the training sample."""
    spark = docs.sparkSession
    bound_batches(spark)
    labelled = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = saved(bounded_sample(labelled, "_id", params.labelled_rows), "weak-labelled")
    lists = learn_lists(docs, labelled, id_col, text_col, params)
    shared = spark.sparkContext.broadcast(lists)

    @F.pandas_udf("junk string, toxic string")
    def vote(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, quality, toxic in batches:
            known = lambda x: None if pd.isna(x) else int(x)
            yield pd.DataFrame(
                [votes(t, shared.value, None if (k := known(q)) is None else 1 - k, known(x)) for t, q, x in zip(text, quality, toxic)],
                columns=["junk", "toxic"],
            )

    work = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    voted = work.join(F.broadcast(labelled), F.col("_doc") == F.col("_id"), "left").select("_doc", vote("_text", F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("v"))
    voted = saved(voted.select("_doc", "v.*"), "weak-votes")
    pairs = voted.groupBy("junk", "toxic").count().orderBy("junk", "toxic").collect()  # as many as patterns
    models = []
    for c in ("junk", "toxic"):
        patterns: Counter = Counter()
        for r in pairs:
            patterns[r[c]] += r["count"]
        models.append(fit_label_model(list(patterns.items()), params.em_rounds))
    strata = {(r["junk"], r["toxic"]): (models[0].posterior(r["junk"]), models[1].posterior(r["toxic"])) for r in pairs}
    sizes: Counter = Counter()
    for r in pairs:
        sizes[_stratum(strata[r["junk"], r["toxic"]])] += r["count"]
    if not pairs:
        return Classifier(train([], params), params, *models, lists)
    rows_of = spark.createDataFrame([(j, t, _stratum(p)) for (j, t), p in strata.items()], "junk string, toxic string, stratum int")
    staged = saved(voted.dropDuplicates(["_doc"]).join(F.broadcast(rows_of), ["junk", "toxic"]), "weak-strata")
    parts = [bounded_sample(staged.where(F.col("stratum") == k), "_doc", params.stratum_rows) for k in sorted(sizes)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    chosen = saved(chosen.coalesce(1), "weak-chosen")

    @F.pandas_udf("at binary, value binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t, shared.value, params.buckets) for t in batch]
            yield pd.DataFrame([(a.astype(np.int32).tobytes(), v.astype(np.float16).tobytes()) for a, v in found], columns=["at", "value"])

    sample = work.join(F.broadcast(chosen), "_doc").select("_doc", "junk", "toxic", "stratum", hashed("_text").alias("h")).select("_doc", "junk", "toxic", "stratum", "h.*")
    sample = saved(sample, "weak-features").dropDuplicates(["_doc"]).orderBy("_doc")
    taken = Counter(r["stratum"] for r in chosen.select("stratum").collect())
    rows = []
    for r in sample.toLocalIterator():
        y = np.array(strata[r["junk"], r["toxic"]])
        weight = sizes[r["stratum"]] / taken[r["stratum"]]
        rows.append((np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float16), y, weight))
    return Classifier(train(rows, params), params, *models, lists)


def classify(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with p_junk, p_toxic and kept (false if either reaches the limit).

    A null or empty text has no features: its probabilities are those of the bias. Columns of ``docs`` with these names
    give way to the operator's. Repeated rows get equal verdicts; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    buckets, lists = model.params.buckets, model.lists

    @F.pandas_udf("p_junk double, p_toxic double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for batch in batches:
            rows = []
            for text in batch:
                at, value = features(text, lists, buckets)
                z = [float(w[at] @ value) + float(w[-1]) for w in weights]
                rows.append(tuple(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
            yield pd.DataFrame(rows, columns=["p_junk", "p_toxic"])

    held = fresh_name(docs, "_scored")
    own = ["p_junk", "p_toxic", "kept"]
    done = docs.withColumn(held, score(F.col(text_col)))
    limit = F.lit(model.params.reject_at)
    r = F.col(held)
    kept = (r["p_junk"] < limit) & (r["p_toxic"] < limit)
    return done.select(*[F.col(c) for c in docs.columns if c.lower() not in own], r["p_junk"].alias("p_junk"), r["p_toxic"].alias("p_toxic"), kept.alias("kept"))
