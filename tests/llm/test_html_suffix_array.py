"""The host's suffix array: its order, its runs and how long the repeats in it are, by brute force."""

import random

from spanframe.llm import htmltext


def test_array_is_sorted_and_its_runs_are_on_enough_pages(spark):
    rng = random.Random(3)
    rows = [(k, f"h{k % 2}", k // 2, 0, at, rng.choice("ab") + " " + rng.choice("abc")) for k in range(12) for at in range(9)]
    suffixes = spark.createDataFrame(rows, "row_id long, host string, class long, stream int, at int, head string")
    head = {(r[0], r[4]): (r[1], r[5]) for r in rows}
    pages = {h: {r[2] for r in rows if (r[1], r[5]) == h} for h in head.values()}
    array = htmltext.ranked(suffixes, ["head"], 5)
    got = {(r["row_id"], r["at"]): r["rank"] for r in array.collect()}
    assert set(got) == {k for k, h in head.items() if len(pages[h]) >= 5} and 0 < len(got) < len(rows)
    at = sorted(got)
    assert all((got[a] < got[b]) == (head[a] < head[b]) for a in at for b in at)


def test_repeats_of_any_length_by_brute_force(spark):
    rng = random.Random(5)
    notices = [[f"n{k}x{i % 7}" for i in range(n)] for k, n in enumerate((4, 5, 9, 11, 23, 60))]
    pages, rows = {}, []
    for k in range(30):
        streams = []
        for _ in range(rng.randrange(1, 4)):
            words = []
            for _ in range(rng.randrange(1, 4)):
                words += [f"own{k}x{rng.randrange(99)}" for _ in range(rng.randrange(3))]
                words += rng.choice(notices)[rng.randrange(3) :]
            streams.append(words)
        pages[k] = (f"h{k % 3}", k // 2 if k < 6 else k, streams)
        texts = [t for words in streams for t in (" ".join(words), "article")]
        rows.append((k, pages[k][0], pages[k][1], [False, True] * len(streams), texts))
    table = spark.createDataFrame(rows, "row_id long, host string, class long, owns array<boolean>, texts array<string>")

    def classes(host, words):
        return len({c for h, c, streams in pages.values() if h == host and any(s[i : i + len(words)] == words for s in streams for i in range(len(s)))})

    want = {}
    for k, (host, _, streams) in pages.items():
        at = 0
        for words in streams:
            for i in range(len(words)):
                length = 5
                while i + length <= len(words) and classes(host, words[i : i + length]) >= 3:
                    want[k, at + i] = length
                    length *= 2
            at += len(words)
    got: dict = {}
    for r in htmltext.repeats(table, 5, 3).collect():
        got[r["row_id"], r["at"]] = max(r["length"], got.get((r["row_id"], r["at"]), 0))
    assert got == want and {5, 10, 20, 40} == set(want.values())
