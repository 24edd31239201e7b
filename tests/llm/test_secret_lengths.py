"""Added tokens by length and encoding, among words, names and paths of another make than the decoys of the operator."""

import random

from spanframe.llm import secretscan

WORDS = (
    "Verantwortung Gesellschaft Geschwindigkeit Versicherung international responsibility understanding government environment management "
    "configuration development application performance temperature neighbourhood entreprise gouvernement connaissance information "
    "desarrollo conocimiento universidad the of and river stone paper garden window morning letter because under seven although"
).split()
ENCODINGS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
LENGTHS = [20, 24, 32, 40]


def corpus(seed, count):
    """(text, length of the random token in it or None)"""
    rng = random.Random(seed)
    some = lambda n: [rng.choice(WORDS) for _ in range(n)]
    traps = [
        lambda: "".join(w.lower() for w in some(3)), lambda: "_".join(w.lower() for w in some(3)), lambda: "".join(w.capitalize() for w in some(3)),
        lambda: "/".join(["", *(w.lower() for w in some(3))]), lambda: "-".join(some(2)) + "-2024-06", lambda: "".join(some(2)).upper(), lambda: "Donaudampfschifffahrtsgesellschaft",
    ]
    for _ in range(count):
        size = None
        middle = rng.choice(traps)()
        if rng.random() < 0.3:
            size = rng.choice(LENGTHS)
            # hexadecimal from 32 characters on is a base span
            alphabet = rng.choice(ENCODINGS[1:] if size >= 32 else ENCODINGS)
            middle = "".join(rng.choice(alphabet) for _ in range(size))
        yield " ".join([*some(25), middle, *some(8)]), size


def test_every_length_from_twenty_characters_on(spark):
    made = list(corpus(11, 3000))
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_random"] for r in secretscan.digest(docs, secretscan.fit(docs)).collect()}
    for size in LENGTHS:
        mine = [k for k, (_, s) in enumerate(made) if s == size]
        print(size, sum(got[k] > 0 for k in mine) / len(mine))
    false = [made[k][0] for k, n in got.items() if n and made[k][1] is None]
    print("added", sum(got.values()), "wrongly", len(false), false[:3])
    for size in LENGTHS:
        mine = [k for k, (_, s) in enumerate(made) if s == size]
        assert sum(got[k] > 0 for k in mine) >= 0.9 * len(mine), size
    assert len(false) <= 0.1 * sum(got.values())


def test_habit_counts_the_pairs_of_all_words(spark):
    docs = spark.createDataFrame([(1, "Abc ab1c x"), (2, None), (3, ""), (4, "bca AB é" + "q" * 3)], "doc_id long, text string")
    found = secretscan.habit(docs)
    seen = {"ab": 2, "bc": 2, "ca": 1, "qq": 2}
    order = sorted(range(676), key=lambda i: -found.pairs[i])
    assert {secretscan.LETTERS[i // 26] + secretscan.LETTERS[i % 26] for i in order[:4]} == set(seen) and len(set(found.pairs)) == 3
    assert secretscan.habit(docs.limit(0)) is None
    assert secretscan.digest(docs, secretscan.fit(docs)).count() == 4 and secretscan.fit(docs.limit(0)).habit is None
