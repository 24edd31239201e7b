"""What the fingerprint search settles in the near-duplicate stage is not looked at again by what follows it."""

import random

from spanframe.llm import jaccard, simhash

from test_jaccard import brute, edited


def test_fingerprints_take_work_from_what_follows(spark, monkeypatch):
    rng = random.Random(8)
    near = [f"n{rng.randrange(900)}" for _ in range(1500)]
    far = [f"f{rng.randrange(900)}" for _ in range(150)]
    texts = [edited(rng, near, k > 0) for k in range(8)] + [edited(rng, far, 2 * (k > 0)) for k in range(4)] + ["apart from all of them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want: dict = {}
    for k, top in enumerate(brute(texts)):
        want.setdefault(top, k)
    holders, search, held = jaccard._holders, jaccard._by_fingerprint, []

    def counted(sets):
        out = holders(sets)
        held.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_holders", counted)
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(want.values())
    monkeypatch.setattr(jaccard, "_by_fingerprint", lambda sets: search(sets).where("false"))
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(want.values())
    found, without = held
    assert 0 < found < without / 2
