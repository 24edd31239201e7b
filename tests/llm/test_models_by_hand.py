"""Fitted models against plain versions: memberships and rates (op3), label model (op6), scores and verdicts (op9)."""

import itertools
import math
import random
from zlib import crc32

import numpy as np
import pytest
import xxhash

from spanframe.llm import mixing, qualityllr, weaklabel

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def ascii_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def test_memberships_and_rates(spark, docs, labels):
    params = mixing.MixParams()
    good = {r["doc_id"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] == 1 and not r["toxic"]}
    rows = docs.collect()
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    bucket = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42)) % params.buckets
    words = {r["doc_id"]: ascii_words((r["text"] or "").lower()) for r in rows}
    langs = sorted({r["lang"] for r in rows if r["doc_id"] in good and r["lang"] is not None})
    counts, sizes = np.zeros((len(langs), params.buckets)), np.zeros(len(langs))
    for r in rows:
        if r["doc_id"] in good and r["lang"] is not None:
            k = langs.index(r["lang"])
            sizes[k] += 1
            for w in words[r["doc_id"]]:
                counts[k, bucket(w)] += 1
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * params.buckets))
    targets = {d: float(k + 1) for k, d in enumerate(langs)}
    mixed, domains = mixing.mix(docs, labels, targets)
    got = {r["id"]: r for r in mixed.collect()}
    assert domains == langs and set(got) == set(words)
    for k, r in got.items():
        n = len(words[k])
        score = np.log(sizes / sizes.sum())
        if n:
            score = score + sum(logs[:, bucket(w)] for w in words[k]) * min(n, params.sharpness) / n
        want = np.exp(score - score.max())
        assert r["tokens"] == n and np.allclose(r["posterior"], want / want.sum(), atol=1e-9), k
    # rates are nonnegative, and their totals meet the targets
    part = np.array([np.array(r["posterior"]) * r["tokens"] for r in got.values()]) / sum(r["tokens"] for r in got.values())
    rates = np.array([r["rate"] for r in got.values()])
    goal = np.array([targets[d] for d in domains]) / sum(targets.values())
    assert rates.min() >= 0 and np.abs(part.T @ rates - goal).max() < 1e-6


def plain_em(patterns, rounds):
    width = len(patterns[0][0])
    q = []
    for p, _ in patterns:
        q.append((0.9 if p[-1] == "1" else 0.02) if p[-1] != "-" else 0.9 if "1" in p else 0.02)
    for _ in range(rounds):
        total = sum(c for _, c in patterns)
        prior = min(max((sum(c * x for (_, c), x in zip(patterns, q)) + 1) / (total + 20), 1e-4), 0.5)
        hit, miss = [], []
        for j in range(width):
            seen = [(p[j], c, x) for (p, c), x in zip(patterns, q) if p[j] != "-"]
            h = (sum(c * x for v, c, x in seen if v == "1") + 1) / (sum(c * x for _, c, x in seen) + 2)
            f = (sum(c * (1 - x) for v, c, x in seen if v == "1") + 0.02) / (sum(c * (1 - x) for _, c, x in seen) + 20)
            hit.append(min(max(h, f, 1e-6), 1 - 1e-3))
            miss.append(min(max(f, 1e-6), 0.5))
        new = []
        for p, _ in patterns:
            yes, no = prior, 1 - prior
            for v, h, f in zip(p, hit, miss):
                yes *= {"1": h, "0": 1 - h, "-": 1}[v]
                no *= {"1": f, "0": 1 - f, "-": 1}[v]
            new.append(yes / (yes + no))
        q = new
    return prior, hit, miss, q


def test_label_model_by_plain_steps_and_against_the_truth():
    rng = random.Random(4)
    hits, misses = [0.9, 0.7, 0.5, 0.95], [0.02, 0.05, 0.01, 0.01]
    counts, truth = {}, {}
    for _ in range(20_000):
        bad = rng.random() < 0.1
        votes = "".join("-" if rng.random() < (0.9 if j == 3 else 0.1) else str(int(rng.random() < (hits if bad else misses)[j])) for j in range(4))
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(bad)
    patterns = sorted(counts.items())
    for rounds in (1, 3, 60):
        model = weaklabel.fit_label_model(patterns, rounds)
        prior, hit, miss, q = plain_em(patterns, rounds)
        assert math.isclose(model.prior, prior, rel_tol=1e-6) and np.allclose(model.hit, hit, rtol=1e-6) and np.allclose(model.false_hit, miss, rtol=1e-6)
        assert np.allclose([model.posterior(p) for p, _ in patterns], q, rtol=1e-5)
    assert abs(model.prior - 0.1) < 0.02 and np.abs(model.hit - hits).max() < 0.06 and np.abs(model.false_hit - misses).max() < 0.02
    for p, n in patterns:
        if n >= 300:
            assert abs(model.posterior(p) - sum(truth[p]) / n) < 0.08, p


def test_toxic_documents_are_rejected_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in weaklabel.classify(docs, weaklabel.fit(docs, labels)).select("doc_id", "kept").collect()}
    rows = [r for r in labels.collect() if r["doc_id"] in kept]
    toxic = [kept[r["doc_id"]] for r in rows if r["toxic"] == 1]
    clean = [kept[r["doc_id"]] for r in rows if r["toxic"] == 0 and r["quality"] == 1]
    print("toxic rejected", 1 - sum(toxic) / len(toxic), "of", len(toxic), "clean kept", sum(clean) / len(clean))
    assert sum(toxic) <= 0.35 * len(toxic) and sum(clean) >= 0.97 * len(clean)


def test_scores_and_verdicts(spark, docs):
    params = qualityllr.LlrParams(buckets=1 << 12)
    half = params.buckets // 2

    def grams(text):
        words = [crc32(w.encode()) for w in ascii_words(text or "")]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F % (1 << 64) >> 20) % half + half for a, b in itertools.pairwise(words)]
        return [w % half for w in words] + pairs

    rows = docs.collect()
    trusted = {r["doc_id"] for r in rows if r["doc_id"] % 3 == 0}
    raw, target = np.zeros(params.buckets), np.zeros(params.buckets)
    for r in rows:
        for g in grams(r["text"]):
            raw[g] += 1
            target[g] += r["doc_id"] in trusted
    ratios = np.zeros(params.buckets)
    for g in range(params.buckets):
        x = math.log((target[g] + params.prior) / (raw[g] * target.sum() / raw.sum() + params.prior))
        ratios[g] = math.copysign(max(abs(x) - params.shrink, 0), x)
    marked = docs.selectExpr("*", "doc_id % 3 = 0 AS trusted")
    found = qualityllr.log_ratios(qualityllr.count_ngrams(marked, "text", "trusted", params), params)
    assert np.allclose(found, ratios)
    model = qualityllr.LlrModel(found, float(np.median(ratios)) - 0.01, params)
    for r in qualityllr.judge(docs, model).collect():
        g = grams(r["text"])
        score = sum(ratios[x] for x in g) / (len(g) + params.padding)
        assert math.isclose(r["score"], score, abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)


def test_threshold_by_all_cuts():
    rng = random.Random(6)
    params = qualityllr.LlrParams(false_rejects=0.1)
    for _ in range(30):
        scores = [(rng.randrange(20) / 4 + (1 if ok else 0), ok) for ok in (rng.random() < 0.6 for _ in range(40))]
        good, bad = [s for s, ok in scores if ok], [s for s, ok in scores if not ok]
        value = lambda t: sum(s < t for s in bad) / len(bad) - sum(s < t for s in good) / len(good)
        held = lambda t: sum(s < t for s in good) <= params.false_rejects * len(good)
        got = qualityllr.threshold_of(scores, params)
        every = [t / 8 + 0.01 for t in range(50) if held(t / 8 + 0.01) and min(good + bad) < t / 8 + 0.01 <= max(good + bad)]
        assert not every or (held(got) and math.isclose(value(got), max(map(value, every))))
