"""Personal data and secrets through their methods: planted spans that no base pattern matches, all spans by brute force, long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanframe.llm import native, pii, secretscan

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def luhn(n):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def corpus(seed, count=1500):
    """(text, planted spans that base patterns miss, traps) of generated documents."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(["river", "stone", "paper", "garden", "window", "morning", "letter", "because", "under", "seven"])
    phone = lambda: f"({rng.randrange(200, 999)}) {num(3)}-{num(4)}"
    out = []
    for _ in range(count):
        bits, planted = [word() for _ in range(6)], []
        kind = rng.randrange(8)
        put = {
            0: f"+1 {phone()}", 1: f"{word()}.{word()}@mail{num(1)}.example.com", 2: f"call {phone()} now", 3: f"{word()} (at) {word()} (dot) com",
            4: f"on 20{num(2)}-0{rng.randrange(1, 9)}-1{num(1)} there", 5: "ticket " + next(c for c in iter(lambda: num(16), None) if not luhn(c) and c[0] != "0"), 6: f"page {num(4)}", 7: f"account: {num(10)}",
        }[kind]
        text = " ".join(bits[:3]) + " " + put + " " + " ".join(bits[3:])
        if kind in (2, 3, 7):
            value = {2: put[5:-4], 3: put, 7: put[9:]}[kind]
            planted.append((text.index(value), text.index(value) + len(value)))
        out.append((text, planted))
    return out


def test_trees_add_what_base_patterns_miss(spark):
    made = corpus(3)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")
    model = pii.fit(docs)
    other = corpus(4, 600)
    rows = pii.find(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(other)], "doc_id long, text string"), model).collect()
    added = {(r["doc_id"], s["start"], s["end"]) for r in rows for s in r["pii_spans"] if s["kind"] > 3}
    want = {(k, a, b) for k, (_, planted) in enumerate(other) for a, b in planted}
    hit = {(k, a, b) for k, a, b in want if any(d == k and s < b and a < e for d, s, e in added)}
    right = {x for x in added if any(k == x[0] and x[1] < b and a < x[2] for k, a, b in want)}
    print("recall", len(hit) / len(want), "precision", len(right) / max(1, len(added)))
    assert len(hit) >= 0.9 * len(want) and len(right) >= 0.9 * len(added)
    told = pii.digest(docs, model).where("n_added > 0").first()
    assert ":added:" in told["judged"] and re.search("number|address", told["spans"])


def test_battery_adds_random_tokens_and_knows_base_secrets(spark):
    rng = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = "the of and river stone paper garden window morning letter because under seven although international responsibility".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    code = lambda n, a=chars: "".join(rng.choice(a) for _ in range(n))
    rows, planted, traps = [], {}, {}
    for k in range(1200):
        text, end = prose(30) + " ", " " + prose(10)
        if k % 6 == 0:
            planted[k] = code(rng.choice([24, 32, 40])) if k % 12 else code(40, chars[:52])  # letters alone too
            text += planted[k]
        elif k % 6 == 1:
            traps[k] = rng.choice(["_".join(rng.choice(words) for _ in range(4)), "release-2024-01-000000000000", "abcabcabcabcabcabcabcabc1", "-" * 30 + "a", "".join(rng.choice(words) for _ in range(5))])
            text += traps[k]
        elif k % 6 == 2:
            text += "token=" + code(32) if k % 12 == 2 else code(40, "0123456789abcdef")
        rows.append((k, text + end))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = secretscan.fit(docs)
    got = {r["doc_id"]: r for r in secretscan.digest(docs, cuts).collect()}
    found = [k for k in planted if got[k]["n_random"]]
    long = [k for k in planted if len(planted[k]) >= 32]  # at 24 characters words look random by chance more often
    short = [k for k in planted if len(planted[k]) < 32]
    false = [k for k in got if got[k]["n_random"] and k not in planted]
    known = [r["judged"] for r in got.values() if "base_" in r["judged"]]
    recall = sum("base_random" in j for j in known) / len(known)
    print("recall", len(found) / len(planted), "precision", len(found) / max(1, len(found) + len(false)), "on base secrets", recall)
    print("recall from 32 characters on", sum(k in found for k in long) / len(long), "and of 24", sum(k in found for k in short) / len(short))
    assert sum(k in found for k in long) >= 0.9 * len(long)
    assert len(false) <= 0.1 * (len(found) + len(false)) and recall >= 0.9


def test_all_counts_and_spans_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([None, "", "é+49 151 2345678, a@b.c.d 10.0.0.1 4111 1111 1111 1111", "𝔘 token: 'abcdefgh1' AKIA" + "A" * 14 + " " + "f0" * 20])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    number = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", EMAIL, lambda v: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(number(v)) <= 19 and luhn(number(v))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(number(v)) <= 15),
    ]
    for r in pii.digest(both, pii.fit(both)).collect():
        text = texts[r["doc_id"]]
        base = [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, text) if good(m[0])]
        assert [r[f"n_{k}"] for k, _, _ in kinds] == [sum(b[0] == k for b in base) for k, _, _ in kinds]
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if k in dict((x[0], 1) for x in kinds)] == base and len(spans) == len(base) + r["n_added"]
        assert all(not (int(a) < e and s < int(b)) for k, a, b in spans if k in ("number", "address") for _, s, e in base)
    for r in secretscan.digest(both, secretscan.fit(both)).collect():
        text = texts[r["doc_id"]]
        assign = [("assign", m) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
        rest = [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(assign), sum(k == "access" for k, _ in rest), sum(k == "hex" for k, _ in rest)]
        order = {"assign": 0, "access": 1, "hex": 2}
        base = [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(assign + rest, key=lambda x: (x[1].start(), order[x[0]]))]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == base and r["spans"].count("random") == r["n_random"]


def test_running_and_replaced(spark):
    rng = random.Random(1)
    values = [rng.randrange(9) for _ in range(1000)]
    text = "".join(rng.choice("ab𝔘é\n") for _ in range(10_000))
    spans = sorted((a, a + rng.randrange(1, 90), rng.randrange(2)) for a in rng.sample(range(9_990), 150))
    spans = [(a, min(b, 10_000), k) for a, b, k in spans]
    df = spark.createDataFrame([(values, text, spans)], "v array<int>, t string, s array<struct<start:int,end:int,kind:int>>")
    labels = F.array(F.lit("[X]"), F.lit("[YY]"))
    row = native.replaced(df.withColumn("r", native.running(F.col("v"), lambda a, b: a + b)).withColumn("n", F.col("t")), "n", "s", labels).first()
    assert row["r"] == [sum(values[:i]) for i in range(1000)]
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], "[X]" if k == 0 else "[YY]"]
        at = max(at, b)
    assert row["n"] == "".join(out) + text[at:]


@pytest.mark.parametrize("piece, run", [
    ("10.0.0.1 and 555 1234, ", lambda d: pii.digest(d, MODEL)), ("10.0.0.1 and 555 1234, ", lambda d: pii.redact(d, MODEL)), ("token=abcdefgh12 ", lambda d: secretscan.digest(d, {})),
])
def test_time_of_long_texts(spark, piece, run):
    def took(times):
        df = spark.createDataFrame([(1, piece * times)], "doc_id long, text string")
        began = time.time()
        run(df).collect()
        return time.time() - began

    took(10)
    small, large = took(6_000), took(24_000)
    print(small, large)
    assert large < 6 * small + 1


MODEL = pii.Trees([(0, 1, 2, [0.1, 0.2, 0.3, 0.4])] * 24, 0.0, 1.0)
