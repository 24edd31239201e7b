"""Each step of the near-duplicate stage runs its Python function once on a text, so that a task has one Python worker."""

import random

from spanframe.llm import jaccard, simhash

from test_jaccard import edited


def test_sets_are_made_once(spark, monkeypatch):
    rng = random.Random(9)
    start = [f"w{rng.randrange(900)}" for _ in range(150)]
    docs = spark.createDataFrame([(k, edited(rng, start, k > 0)) for k in range(4)], "doc_id long, text string")
    write, evaluations = jaccard.saved, {}

    def seen(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        evaluations[name] = max(evaluations.get(name, 0), plan.count("ArrowEvalPython"))
        return write(df, name)

    monkeypatch.setattr(jaccard, "saved", seen)
    assert [r["doc_id"] for r in simhash.one_of_each(docs).collect()] == [0]
    assert evaluations["jaccard-rows"] == evaluations["jaccard-sets"] == 1
    assert max(evaluations.values()) == 1
