"""Secret scans: strict patterns, and a battery of randomness tests over long tokens. DataFrame functions only.

Base spans (assignments, access keys, hex strings) are matches of strict patterns. Every long token, in a base span or not,
is tested for randomness in the encoding inferred for it: how evenly it uses the alphabet (chi-squared), how often it
changes between vowels or even digits and the rest (runs), and how a character follows from the one before, by serial
correlation and by habit: whether its pairs of letters are those that the corpus's own words are made of, held against
letters drawn at random. Each test gives a deviation in standard deviations, z, whose p-value falls about as
exp(-z * z / 2); the tests are combined as Fisher's method combines p-values, by the sum of z * z. The smaller the sum, the
more random the token.

How random ordinary text looks by chance is read from the corpus: each document gives one decoy, a run of a token's length from
its plain words and numbers, joined as in names, which is tested like a token. A token's p-value is the share of decoys of its length class that
look as random. In each length class the Benjamini-Hochberg rule then picks the score up to which the share of false
discoveries is bounded, for the tokens in base spans and for the others by themselves: the former tell what the battery
recognises, and don't loosen the bound for the latter, of which those found random are added, if their score is also one
that random tokens have: where words lie far from these, the rate alone would let the cut-off run into the gap. Counts of scores by length
class, few however large the corpus, are all that is gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import fresh_name
from spanframe.llm.native import joined, let, marked, matches

#: Kinds in the order of the digest; the first three are base kinds.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"

#: Encodings tried in turn: pattern and alphabet. Letters alone are tested in the code alphabet that holds them.
ENCODINGS = [
    (r"^[0-9a-f]*[0-9][0-9a-f]*$", "0123456789abcdef"),
    (r"^[0-9A-F]*[0-9][0-9A-F]*$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]*[2-7][A-Z2-7]*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
#: Lower bounds of the length classes.
LENGTHS = [16, 20, 24, 32, 48]
#: Scores are counted in steps of a tenth, up to this many.
STEPS = 200


@dataclass(frozen=True)
class SecretParams:
    #: Bound on the share of false discoveries.
    false_share: float = 0.1
    #: Share of random tokens that may look less random than an added token must.
    missed: float = 1e-4
    #: Decoys that a length class needs of its own; with fewer it also takes those of the classes below.
    decoys: int = 200


def base_spans(text: Column) -> Column:
    """struct<kind, start, end> of all base spans by start, then kind; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    kept = lambda kind, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    assign = F.filter(matches(text, ASSIGN, text.rlike(r"[:=]")), lambda s: F.length(F.regexp_extract(s["value"], ASSIGNED, 1)) >= 8)
    return F.array_sort(F.concat(kept(0, assign), kept(1, matches(text, ACCESS, text.contains("AKIA"))), kept(2, matches(text, HEX, text.rlike("[0-9a-f]{32}")))))


@dataclass(frozen=True)
class Habit:
    """How often the corpus's words have each pair of letters: hundredths of log probabilities, 26 rows of 26."""

    pairs: list[int]

    def by_chance(self, letters: int) -> tuple[float, float]:
        """Mean and standard deviation of a pair drawn at random from the first so many letters."""
        drawn = [self.pairs[a * 26 + b] for a in range(letters) for b in range(letters)]
        mean = sum(drawn) / len(drawn)
        return mean, math.sqrt(sum((v - mean) ** 2 for v in drawn) / len(drawn))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def habit(docs: DataFrame, text_col: str = "text") -> Habit | None:
    """The letter pairs of all plain words of all texts; None where there are none."""
    word = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PLAIN), F.lit(0)))
    words = docs.select(word.alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    pair = F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z]{2}))"), F.lit(1)))
    seen = {r["pair"]: r["n"] for r in words.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # 676 rows at most
    total = sum(seen.values())
    return Habit([round(100 * math.log((seen.get(a + b, 0) + 0.5) / (total + 338))) for a in LETTERS for b in LETTERS]) if total else None


def score(token: Column, own: Habit | None = None) -> Column:
    """The tests' deviations of a token from randomness together: the root of the sum of their squares. Without ``own``, the test of habit is left out."""
    bare = F.rtrim(token, F.lit("="))
    alphabet = F.coalesce(*[F.when(bare.rlike(p) if p else F.lit(True), a) for p, a in ENCODINGS])

    def tested(x: Column) -> Column:
        word, letters = x["word"], x["letters"]
        n, k = F.length(word).cast("double"), F.length(letters).cast("double")
        chars = F.filter(F.split(word, ""), lambda c: c != "")
        counts = F.transform(F.array_distinct(chars), lambda c: F.length(word) - F.length(F.replace(word, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        even = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1))
        at = F.transform(chars, lambda c: F.instr(letters, c).cast("double"))
        square = lambda z: z * z
        return let(at, lambda a: F.sqrt(square(F.greatest(even, F.lit(0.0))) + square(_runs(chars, n)) + square(_serial(a, n)) + square(_habitual(word, k, own))))

    return F.when(F.length(bare) < 8, float(STEPS)).otherwise(let(F.struct(bare.alias("word"), alphabet.alias("letters")), tested))


#: One part of each alphabet for the runs test: vowels, which take turns with consonants in words, and even digits.
PART = "aeiouyAEIOUY02468"


def _runs(chars: Column, n: Column) -> Column:
    """Runs of characters from one part of the alphabet, against the number expected of so many from either part."""

    def told(halves: Column) -> Column:
        above = F.size(F.filter(halves, lambda h: h)).cast("double")
        below = n - above
        runs = 1 + F.size(F.filter(F.sequence(F.lit(1), F.size(halves) - 1), lambda i: F.get(halves, i) != F.get(halves, i - 1)))
        mean = 2 * above * below / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(spread > 0.01, (runs - mean) / F.sqrt(spread)).otherwise(F.sqrt(n))

    # bound once: else each place of a long token would work out all of them
    return let(F.transform(chars, lambda c: F.lit(PART).contains(c)), told)


def _serial(at: Column, n: Column) -> Column:
    """Correlation of each character with the next."""
    total = lambda f: F.aggregate(at, F.lit(0.0), lambda s, a: s + f(a))
    mean = total(lambda a: a) / n
    spread = total(lambda a: a * a) - n * mean * mean
    along = F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0.0), lambda s, i: s + (F.get(at, i) - mean) * (F.get(at, i - 1) - mean))
    return F.when(spread > 1e-9, along / spread * F.sqrt(n)).otherwise(F.sqrt(n))


def _habitual(word: Column, k: Column, own: Habit | None) -> Column:
    """By how much a token's pairs of letters are likelier in the corpus's words than pairs drawn from its encoding's letters."""
    if own is None:
        return F.lit(0.0)
    table = F.lit(own.pairs)
    (mean16, spread16), (mean, spread) = own.by_chance(6), own.by_chance(26)

    def worth(at: Column) -> Column:
        pair = lambda i: F.when((F.get(at, i) > 0) & (F.get(at, i - 1) > 0), F.get(table, F.get(at, i - 1) * 26 + F.get(at, i) - 27))
        return F.filter(F.transform(F.sequence(F.lit(1), F.size(at) - 1), pair), lambda v: v.isNotNull())

    def told(values: Column) -> Column:
        n = F.size(values).cast("double")
        total = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)
        by_chance = lambda m, d: (total - n * m) / (F.sqrt(n) * max(d, 1.0))
        return F.when(n == 0, 0.0).otherwise(F.greatest(F.when(k == 16, by_chance(mean16, spread16)).otherwise(by_chance(mean, spread)), F.lit(0.0)))

    places = F.transform(F.filter(F.split(F.lower(word), ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c))
    return let(let(places, worth), told)


#: What a decoy's words are joined by, as in names and paths.
JOINS = ["", "", "-", "_"]
#: A plain word: letters that are no part of a longer token.
NUMBERS = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z]++|[0-9]++)(?![A-Za-z0-9+/_=-])"
PLAIN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]++(?![0-9+/_=-])"


def _group(length: Column) -> Column:
    return sum((F.when(length >= low, 1).otherwise(0) for low in LENGTHS[1:]), F.lit(0))


def _step(token: Column, own: Habit | None) -> Column:
    return F.least(F.greatest(F.floor(score(token, own) * 10), F.lit(0)), F.lit(STEPS)).cast("int")


def decoy(text: Column, own: Habit | None = None) -> Column:
    """array<struct<class, step, key>> of one decoy of the text: its plain words and numbers, joined by what its hash picks, from a place that it picks.

    Empty where these have fewer characters than the shortest token.
    """
    words = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBERS), F.lit(0)), " ")
    between = lambda w: F.get(F.array(*[F.lit(v) for v in JOINS]), F.pmod(F.xxhash64(w, F.lit(3)), F.lit(len(JOINS))).cast("int"))
    letters = let(words, lambda w: F.replace(w, F.lit(" "), between(w)))

    def one(x: Column) -> Column:
        size = F.length(x)
        chance = lambda salt, n: F.pmod(F.xxhash64(x, F.lit(salt)), n)
        low = F.get(F.array(*[F.lit(v) for v in LENGTHS]), chance(1, _group(size) + 1).cast("int"))
        token = F.substring(x, chance(2, size - low + 1).cast("int") + 1, low)
        made = let(token, lambda t: F.struct(_group(F.length(t)).alias("class"), _step(t, own).alias("step"), F.xxhash64(t).alias("key")))
        return F.when(size >= LENGTHS[0], F.array(made)).otherwise(F.array().cast("array<struct<class:int,step:int,key:bigint>>"))

    return let(letters, one)


def candidates(text: Column, base: Column, own: Habit | None = None) -> Column:
    """struct<start, end, known, class, step, key> of the long tokens; known: it meets a base span."""
    text = F.coalesce(text, F.lit(""))
    wanted = F.filter(matches(text, TOKEN, text.rlike("[A-Za-z0-9+/_=-]{16}")), lambda s: s["value"].rlike("[A-Za-z]"))

    def one(s: Column, meets: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), meets.alias("known"), _group(F.length(s["value"])).alias("class"), _step(s["value"], own).alias("step"), F.xxhash64(s["value"]).alias("key"))

    return let(wanted, lambda w: marked(w, base, one))


#: Groups of counts: decoys, tokens in base spans, other tokens.
DECOY, KNOWN, OTHER = 0, 1, 2


class Cuts(dict[tuple[int, int], int]):
    """The highest score of each (length class, group), and the habit that scores are worked out with."""

    habit: Habit | None = None


def cutoffs(rows: list[tuple[int, int, int, int]], params: SecretParams) -> dict[tuple[int, int], int]:
    """rows: (class, group, step, how many). The highest step of each class at which the false share holds, for known and
    for other tokens; -1 for none. Other tokens must also look as random as random tokens do: the sum of the squares of four
    normal deviations exceeds x with a chance of exp(-x / 2) * (1 + x / 2)."""
    counts = [[[0] * (STEPS + 1) for _ in LENGTHS] for _ in range(3)]
    for length, group, step, n in rows:
        counts[group][length][step] += n
    out = {}
    for length in range(len(LENGTHS)):
        own = list(counts[DECOY][length])
        for lower in range(length - 1, -1, -1):
            if sum(own) >= params.decoys:
                break
            own = [a + b for a, b in zip(own, counts[DECOY][lower])]
        total = sum(own)
        for group in (KNOWN, OTHER):
            best, below, found, tested = -1, 0, 0, sum(counts[group][length])
            for step in range(STEPS + 1):
                x = step * step / 100
                if group == OTHER and math.exp(-x / 2) * (1 + x / 2) < params.missed:
                    break
                below += own[step]
                found += counts[group][length][step]
                if total and found and (below + 1) / (total + 1) * tested / found <= params.false_share:
                    best = step
            out[length, group] = best
    return out


def fit(docs: DataFrame, text_col: str = "text", params: SecretParams = SecretParams()) -> Cuts:
    """The habit of the corpus's words, then the cut-offs, from the counts of all texts' tokens and decoys; what is repeated, in copies of a text, counts once."""
    text, own = F.col(text_col), habit(docs, text_col)
    row = lambda group, c: F.struct(c["class"].alias("class"), group.alias("group"), c["step"].alias("step"), c["key"].alias("key"))
    tokens = let(base_spans(text), lambda base: F.transform(candidates(text, base, own), lambda c: row(F.when(c["known"], KNOWN).otherwise(OTHER), c)))
    decoys = F.transform(decoy(text, own), lambda c: row(F.lit(DECOY), c))
    found = docs.select(F.explode(F.concat(tokens, decoys)).alias("c")).groupBy("c.class", "c.group", "c.step").agg(F.count_distinct("c.key"))
    cuts = Cuts(cutoffs([tuple(r) for r in found.collect()], params))  # as many rows as classes, groups and steps at most
    cuts.habit = own
    return cuts


def located(text: Column, cuts: dict[tuple[int, int], int]) -> Column:
    """struct<base, spans, judged>; base and spans: arrays of struct<start, kind, end>; spans has the added tokens too.

    judged: struct<start, end, step, known, random> of every long token, random being the battery's verdict.
    """
    limits = [F.array(*[F.lit(cuts.get((length, group), -1)) for length in range(len(LENGTHS))]) for group in (KNOWN, OTHER)]

    def told(base: Column) -> Column:
        def verdict(c: Column) -> Column:
            random = c["step"] <= F.when(c["known"], F.get(limits[0], c["class"])).otherwise(F.get(limits[1], c["class"]))
            return F.struct(*[c[x].alias(x) for x in ("start", "end", "step", "known")], random.alias("random"))

        def whole(judged: Column) -> Column:
            added = F.transform(F.filter(judged, lambda c: c["random"] & ~c["known"]), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
            return F.struct(base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"), judged.alias("judged"))

        return let(F.transform(candidates(text, base, getattr(cuts, "habit", None)), verdict), whole)

    return let(base_spans(text), told)


def find(docs: DataFrame, cuts: dict[tuple[int, int], int], text_col: str = "text") -> DataFrame:
    """``docs`` with secret_base and secret_spans: arrays of struct<start, kind, end> by start, then kind; and secret_judged.

    secret_judged has each long token's score and verdict (located()). A null or empty text has none. Columns of ``docs``
    with these names give way to the operator's.
    """
    held = fresh_name(docs, "_secrets")
    own = {"secret_base": "base", "secret_spans": "spans", "secret_judged": "judged"}
    plain = [F.col(c) for c in docs.columns if c.lower() not in own]
    return docs.withColumn(held, located(F.col(text_col), cuts)).select(*plain, *[F.col(held)[field].alias(name) for name, field in own.items()])


def digest(docs: DataFrame, cuts: dict[tuple[int, int], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, judged) of every row.

    n_random: tokens added. judged: start:end:verdict:score of each long token, verdict being base or token, then random or
    plain, the score in tenths; joined by commas.
    """
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    verdict = lambda c: F.concat(F.when(c["known"], "base_").otherwise("token_"), F.when(c["random"], "random").otherwise("plain"))
    one = lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), verdict(c), c["step"].cast("string"))
    told = lambda f: F.struct(
        *[count(f["base"], k).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])],
        F.sha2(joined(f["base"], KINDS), 256).alias("base_sha256"), joined(f["spans"], KINDS).alias("spans"),
        count(f["spans"], 3).alias("n_random"), F.array_join(F.transform(f["judged"], one), ",").alias("judged"),
    )
    return docs.select(F.col(id_col).alias("doc_id"), let(located(F.col(text_col), cuts), told).alias("found")).select("doc_id", "found.*")
