"""The stages of the corpus pipeline: odd rows, empty tables, and what each stage decides against a plain version."""

import re

import corpus_pipeline
import pytest
from spanframe.llm import simhash

from test_jaccard import brute

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, ID string, mix_rate double"
ODD = [None, "", " \n\t ", "one", "é ß 中 𝔘", "the end of the line " * 5000, "mail a.b@c.example.com now"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None, None, None, "k", "s", "i", 7.0) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "one", None, None, None, "k", "s", "i", 7.0), (None, None, None, None, None, None, None, None, None)], DOC)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_odd_rows_and_empty_tables(spark, odd, name, stage):
    got = stage(spark, odd, DATA)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert [c for c in got.columns if not c.startswith("mix_")] == [c for c in odd.columns if not c.startswith("mix_")]
    assert last or got.columns == odd.columns
    rows = got.collect()
    if name == "near_duplicates":  # texts without words are alike; rows without an id all stay
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
    elif name != "quality":
        assert len(rows) == odd.count()
    if name == "personal_data":
        assert {r["doc_id"]: r["text"] for r in rows}[6] == "mail [EMAIL] now"
    assert stage(spark, odd.limit(0), DATA).count() == 0


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages["quality"](spark, docs, DATA).collect()}
    clean = [d in kept for d, r in labels.items() if r["quality"] == 1 and not r["toxic"]]
    assert sum(clean) >= 0.95 * len(clean)

    # the stage links by Jaccard similarity of five-word shingles (tests/llm/test_jaccard.py holds it against all pairs);
    # three differing bits are op7's links
    one = {r["doc_id"] for r in stages["near_duplicates"](spark, docs, DATA).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    firsts: dict = {}
    for (doc, _), top_of in zip(rows, brute([t for _, t in rows])):
        firsts.setdefault(top_of, doc)
    assert one == set(firsts.values())

    whole = [simhash.simhash(r["text"]) & (1 << 64) - 1 for r in docs.collect()]
    parent = list(range(len(whole)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(whole):
        for j in range(i):
            if (a ^ whole[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == sum(parent[i] == i for i in range(len(parent)))

    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = stages["decontamination"](spark, docs, DATA).collect()
    assert 0 < len(left) < docs.count() and not any(i in r["text"] for r in left for i in items)
    shown = stages["personal_data"](spark, docs, DATA).collect()
    assert len(shown) == docs.count() and not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in shown)
