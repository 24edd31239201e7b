"""Malformed chat records, archives of failed attempts, markup, edits of benchmark items by brute force, and the whole pipeline."""

import json
import random

import corpus_pipeline
import numpy as np
from spanframe.llm import chat, decontam, htmltext, mixing, warc

DATA = "/root/testdata/sf0.001"


def test_malformed_chat_records_get_nulls(spark):
    bad = ['{"messages":"abc"}', '{"messages":5}', '{"messages":[{"role":"user","content":"x"},{"role":"user"}]}', "[" * 200_000, '{"messages":[{"role":"user","content":"x"},7]}', "[]", "3", None]
    good = json.dumps({"messages": [{"role": "assistant", "content": "<|im_end|>"}]})
    df = spark.createDataFrame([(k, r, f"keep{k}", k) for k, r in enumerate([*bad, good, '{"messages":null}'])], "conv_id long, record string, _chat string, _read int")
    out = chat.format_records(df)
    rows = {r["conv_id"]: r for r in out.collect()}
    assert all(rows[k]["formatted"] is None and rows[k]["loss_mask"] is None for k in range(len(bad)))
    assert rows[len(bad)]["formatted"] and rows[len(bad) + 1]["formatted"] == "" and all(r["_chat"] == f"keep{k}" and r["_read"] == k for k, r in rows.items())
    assert {r["n_turns"] for r in chat.digest(out).collect()} == {1, 0}


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(k % 40, f"u{k % 3}", "x" * 300 if k % 2 else f"own {k % 40} " * 40) for k in range(400)], "page_id long, url string, html string").repartition(6)
    manifest = warc.write(pages, str(tmp_path))
    name = manifest.first()["archive"]
    (tmp_path / name.replace(".warc", "x.warc")).write_bytes((tmp_path / name).read_bytes())  # an attempt that was overtaken
    (tmp_path / "part-000099-0000-0.warc.zst").write_bytes(b"half")  # one that failed
    got = warc.read(str(tmp_path), manifest).collect()
    assert len(got) == 400
    by = {}
    for r in got:
        by.setdefault(r["payload_digest"], []).append(r)
    for rows in by.values():
        assert sum(r["record_type"] == "response" for r in rows) == 1
        first = min(r["page_id"] for r in rows)
        assert all(r["page_id"] == first if r["record_type"] == "response" else r["refers_to"] == first for r in rows)
    warc.REPEATS, kept = 7, warc.REPEATS
    try:
        assert warc.records(pages).agg({"times": "sum"}).first()[0] == 400 and warc.records(pages).agg({"times": "max"}).first()[0] <= 7
        many = spark.createDataFrame([(1, "u", "s")] * 30, "page_id long, url string, html string")
        assert {r["record_type"] for r in warc.round_trip(many).collect()} == {"response"} and warc.round_trip(many).count() == 30
    finally:
        warc.REPEATS = kept


def test_markup(spark):
    cases = {
        '<div class="has-sidebar"><p>hello</p></div>': "hello", '<div class="no-sidebar"><article><p>x</p></article></div>': "x", "<object data=x><p>rest": "rest",
        '<article><h1 class="post-header">t</h1><p class="share-price">p</p><div class="comments-list">no</div></article>': "t p", "<div data-u=/a/ class=ad>advert</div><p>x": "x",
        '<article><div class="ad-slot">no</div><div id="comments">no</div><p>a<br/>b</p></article>': "a b", "<p>a<script>no": "a",
    }
    for page, want in cases.items():
        assert " ".join(t for _, t in htmltext.blocks(page)) == want, page


def edit_distance(item, text):
    """Least edits from the item to any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edited_items_are_found_and_others_not(spark):
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(400))
    items = [[word() for _ in range(rng.randrange(5, 40))] for _ in range(40)]
    docs = []
    for k in range(400):
        item = list(rng.choice(items))
        for _ in range(rng.randrange(0, int(0.3 * len(item)) + 2)):
            at, kind = rng.randrange(len(item)), rng.randrange(3)
            if kind == 0:
                item[at] = word()
            elif kind == 1:
                item.insert(at, word())
            elif len(item) > 1:
                del item[at]
        docs.append([word() for _ in range(rng.randrange(0, 30))] + item + [word() for _ in range(rng.randrange(0, 30))])
    params = decontam.DecontamParams(block=17)  # several passes
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: (set(r["item_ids"]), r["least_distance"]) for r in decontam.contaminated(df, bench, params=params).collect()}
    missed = total = 0
    for k, d in enumerate(docs):
        far = {i: edit_distance(item, d) for i, item in enumerate(items)}
        want = {i for i, n in far.items() if n <= int(0.2 * len(items[i]))}
        assert got[k][0] <= want
        missed, total = missed + len(want - got[k][0]), total + len(want)
        if got[k][0] == want and want:
            assert got[k][1] == min(far[i] for i in want)
    print("recall", 1 - missed / total, total)
    assert total > 150 and missed <= 0.05 * total


def test_rates_of_zero_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert mixing.with_rates(docs, spark.read.parquet(f"{DATA}/labels.parquet")).count() == docs.count()


def test_the_whole_pipeline(spark):
    """run() is its stages in turn, each on what the stage before has left."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = corpus_pipeline.run(spark, DATA).collect()
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, DATA)
        left = spark.createDataFrame(left.collect(), left.schema)
    want = left.collect()
    key = lambda r: (r["doc_id"], r["text"], round(r["mix_rate"], 6), r["mix_copies"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and 50 < len(got) < docs.count()
    assert np.isfinite([r["mix_rate"] for r in got]).all()
