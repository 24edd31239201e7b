"""The pipeline's near-duplicate stage against all pairs' Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from spanframe.llm import jaccard


def brute(texts):
    """The class of each text, by all pairs of sets of five-word shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4:
                top[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return " ".join(out)


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    texts = [" ".join(word() for _ in range(rng.randrange(3, 90))) for _ in range(60)]
    cloud = [word() for _ in range(150)]
    texts += [edited(rng, cloud, rng.randrange(0, 6)) for _ in range(120)]  # some of them linked only through others
    passage = " ".join(word() for _ in range(30))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(2, 40))) for _ in range(60)]
    texts += [edited(rng, t.split(), rng.randrange(1, 3)) for t in texts[:60]]
    return texts


@pytest.mark.parametrize("often", [4, 10**9])
def test_near_duplicates_are_those_of_jaccard(spark, monkeypatch, often):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "SAMPLE_ONE_IN", 1)
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for k, top in enumerate(brute(texts)):
        want.setdefault(top, k)
    assert 60 < len(want) < len(texts) - 60
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()} == set(want.values())


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {}
    for (k, _), top in zip(rows, brute([t for _, t in rows])):
        want.setdefault(top, k)
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()} == set(want.values())
