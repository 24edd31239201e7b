"""Personal data: strict patterns, and boosted trees over the candidates of lenient ones. DataFrame functions only.

Base spans (e-mail addresses, IP addresses, card and phone numbers) are matches of strict patterns that pass their checks.
Generators with high recall propose further spans, which may overlap: numbers in groups, and addresses with ``at`` and
``dot`` spelled out or set apart. Each candidate is described by bits of its format and context.

Positive examples are candidates that meet a base span, and those whose context gives them away: numbers behind a word such
as ``phone``, and addresses that are spelled out. Trees fitted to these alone would learn the patterns back, so each
example counts half as it stands and half with its marks (plus sign, label, spelling) taken away: what looks like a phone
number but for its plus sign is then held against numbers that lack one and are none.

As there are few bit patterns however large the corpus, their counts over all documents are all that fitting needs.
Gradient-boosted trees of depth two are fitted to the counts of one half of the texts (by hash); their scores are
calibrated by isotonic regression on the other half, and the threshold is the lowest that keeps the wanted precision there.
The fitted trees go back into the plan as column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import fresh_name
from spanframe.llm.native import digits, joined, let, luhn, marked, matches, replaced

#: Kinds in the order of the digest; the first four are base kinds.
KINDS = ["email", "ip", "card", "phone", "number", "address"]
#: The same matches as the plain patterns have, written so that no text makes them slow: runs aren't tried from within.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){3,}+"
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+)*+"

#: Conditions that hold wherever a pattern matches.
NEEDS = {
    EMAIL: lambda text: text.contains("@"),
    IP: lambda text: text.rlike(r"[0-9]\.[0-9]"),
    CARD: lambda text: text.rlike(r"[0-9][\x20-]?[0-9]"),
    PHONE: lambda text: text.contains("+"),
    NUMBER: lambda text: text.rlike(r"[0-9]"),
    ADDRESS: lambda text: text.rlike(r"@|[(\[]at[)\]]"),
}

LABELS = r"(?i)(tel|phone|call|fax|mobile|card|iban|account|ssn|contact|mail|konto|compte|cuenta)[^A-Za-z0-9]{0,4}$"


@dataclass(frozen=True)
class PiiParams:
    trees: int = 24
    rate: float = 0.3
    #: Precision that the calibrated threshold keeps.
    precision: float = 0.9
    #: Candidates of a bit pattern that must be seen before it can be selected.
    support: int = 20


def base_spans(text: Column) -> Column:
    """struct<kind, start, end> of all base spans by kind, then start; no text is an empty one."""
    text = F.coalesce(text, F.lit(""))

    def kept(kind: int, pattern: str, good) -> Column:
        return F.transform(F.filter(matches(text, pattern, NEEDS[pattern](text)), good), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    parts = lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    number = lambda s: digits(s["value"])
    card = lambda s: F.when(F.length(number(s)).between(13, 19), luhn(number(s))).otherwise(False)
    phone = lambda s: F.length(number(s)).between(9, 15)
    return F.concat(kept(0, EMAIL, lambda s: F.lit(True)), kept(1, IP, parts), kept(2, CARD, card), kept(3, PHONE, phone))


def _octets(value: Column) -> Column:
    return value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _card(value: Column) -> Column:
    return F.when(F.length(digits(value)).between(13, 19), luhn(digits(value))).otherwise(False)


#: Format and context of a candidate; each is a condition on its value and on the text before and after it.
FEATURES = {
    "address": lambda v, before, after: v.rlike("[A-Za-z]"),
    "domain": lambda v, before, after: v.rlike(r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,}$"),
    "seven_digits": lambda v, before, after: F.length(digits(v)) >= 7,
    "nine_digits": lambda v, before, after: F.length(digits(v)) >= 9,
    "more_digits": lambda v, before, after: F.length(digits(v)) >= 13,
    "three_groups": lambda v, before, after: v.rlike(r"^\D*\d+\D+\d+\D+\d+"),
    "phone_groups": lambda v, before, after: v.rlike(r"\d{3}\)?[\x20.-]\d{3}[\x20.-]\d{4}$"),
    "date": lambda v, before, after: v.rlike(r"^(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4})$"),
    "octets": lambda v, before, after: _octets(v),
    "luhn": lambda v, before, after: _card(v),
    "glued": lambda v, before, after: before.rlike(r"[A-Za-z0-9_.]$") | after.rlike(r"^[A-Za-z0-9_]"),
    "plus": lambda v, before, after: v.startswith("+"),
    "labelled": lambda v, before, after: before.rlike(LABELS),
    "spelled": lambda v, before, after: v.rlike(r"[(\[](?:at|dot)[)\]]"),
}
BITS = {name: 1 << i for i, name in enumerate(FEATURES)}
#: What gives an example away; half of each example is fitted without.
MARKS = BITS["plus"] | BITS["labelled"] | BITS["spelled"]


def candidates(text: Column, base: Column) -> Column:
    """struct<kind, start, end, known, bits> of the generators' proposals by kind, then start; known: it meets a base span."""
    text = F.coalesce(text, F.lit(""))

    def described(kind: int, pattern: str) -> Column:
        def one(s: Column, meets: Column) -> Column:
            bits = sum((F.when(f(s["value"], s["before"], s["after"]), BITS[name]).otherwise(0) for name, f in FEATURES.items()), F.lit(0))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), meets.alias("known"), bits.alias("bits"))

        return let(matches(text, pattern, NEEDS[pattern](text)), lambda found: marked(found, base, one))

    return F.concat(described(4, NUMBER), described(5, ADDRESS))


def given_away(bits: Column) -> Column:
    """Whether a candidate's context or spelling says what it is."""
    has = lambda *names: bits.bitwiseAND(F.lit(sum(BITS[n] for n in names))) == sum(BITS[n] for n in names)
    return (has("labelled", "seven_digits") & ~has("date")) | has("spelled", "domain")


@dataclass
class Trees:
    """Depth-two trees over bits, (bit, bit if clear, bit if set, four leaves), and the patterns selected."""

    trees: list[tuple[int, int, int, list[float]]] = field(default_factory=list)
    start: float = 0.0
    threshold: float = math.inf

    def score(self, bits: int) -> float:
        total = self.start
        for first, clear, set_, leaves in self.trees:
            side = bits >> first & 1
            total += leaves[2 * side + (bits >> (set_ if side else clear) & 1)]
        return total

    def column(self, bits: Column) -> Column:
        on = lambda b: bits.bitwiseAND(F.lit(1 << b)) != 0
        total = F.lit(self.start)
        for first, clear, set_, x in self.trees:
            total = total + F.when(on(first), F.when(on(set_), x[3]).otherwise(x[2])).otherwise(F.when(on(clear), x[1]).otherwise(x[0]))
        return total


def without_marks(counts: list[tuple[int, int, int]]) -> list[tuple[int, float, float]]:
    """Each example half as it is and half without its marks."""
    out: dict[int, list[float]] = {}
    for bits, p, n in counts:
        for b in (bits, bits & ~MARKS):
            both = out.setdefault(b, [0.0, 0.0])
            both[0] += p / 2
            both[1] += n / 2
    return [(b, p, n) for b, (p, n) in sorted(out.items())]


def boost(counts: list[tuple[int, int, int]], params: PiiParams, held_out: list[tuple[int, int, int]] | None = None) -> Trees:
    """counts: (bits, positives, negatives) of each pattern. Newton steps on the logistic loss.

    held_out: counts of other texts, on which the threshold is chosen; without, it is chosen on those fitted.
    """
    model = Trees()
    positives, total = sum(p for _, p, _ in counts), sum(p + n for _, p, n in counts)
    if not positives or positives == total:
        return model
    model.start = math.log(positives / (total - positives))
    scores = {bits: model.start for bits, _, _ in counts}
    width = len(FEATURES)

    def sums(rows, bit):  # gradient and curvature on both sides of a bit
        out = [[0.0, 1.0], [0.0, 1.0]]
        for bits, p, n in rows:
            q = 1 / (1 + math.exp(-scores[bits]))
            side = out[bits >> bit & 1]
            side[0] += p - q * (p + n)
            side[1] += q * (1 - q) * (p + n)
        return out

    def best(rows):
        return max(range(width), key=lambda b: (sum(g * g / h for g, h in sums(rows, b)), -b))

    for _ in range(params.trees):
        first = best(counts)
        sides = [[r for r in counts if (r[0] >> first & 1) == s] for s in (0, 1)]
        second = [best(rows) if rows else 0 for rows in sides]
        leaves = [params.rate * max(-4.0, min(4.0, g / h)) for rows, b in zip(sides, second) for g, h in sums(rows, b)]
        model.trees.append((first, second[0], second[1], leaves))
        scores = {bits: model.score(bits) for bits, _, _ in counts}
    model.threshold = calibrated_threshold([(model.score(b), p, n) for b, p, n in (counts if held_out is None else held_out)], params)
    return model


def calibrated_threshold(rows: list[tuple[float, int, int]], params: PiiParams) -> float:
    """The lowest score whose calibrated probability (isotonic regression by pooling) is at least the wanted precision."""
    blocks: list[list[float]] = []
    for score, p, n in sorted(rows):
        blocks.append([score, p, p + n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, p1, n1 = blocks.pop()
            blocks[-1][1] += p1
            blocks[-1][2] += n1
    for score, p, n in blocks:
        if n >= params.support and p >= params.precision * n:
            return score
    return math.inf


def fit(docs: DataFrame, text_col: str = "text", params: PiiParams = PiiParams()) -> Trees:
    """The trees, from counts of bit patterns over all texts; texts are dealt to the two halves by their hash."""
    spans = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("text").rlike(r"[0-9]|@|[(\[]at[)\]]"))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")
    found = spans.select(half, F.explode(let(base_spans(F.col("text")), lambda base: candidates(F.col("text"), base))).alias("c"))
    good = F.col("c.known") | given_away(F.col("c.bits"))
    counts = found.groupBy("half", "c.bits").agg(F.sum(good.cast("long")).alias("p"), F.sum((~good).cast("long")).alias("n"))
    rows = counts.orderBy("half", "bits").collect()  # twice as many rows as bit patterns at most
    halves = [without_marks([(r["bits"], r["p"], r["n"]) for r in rows if r["half"] == h]) for h in (0, 1)]
    return boost(halves[0], params, halves[1])


def located(text: Column, model: Trees) -> Column:
    """struct<base, spans, judged>: the base spans; with them the selected candidates that meet none; and all candidates.

    judged: struct<kind, start, end, score, verdict> of every candidate; verdict 0: it meets a base span, 1: selected, 2:
    refused, 3: an address that gives way to a selected number.
    """
    three = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    limit = F.lit(model.threshold)

    def scored(found: Column) -> Column:
        def one(c: Column) -> Column:
            score = model.column(c["bits"])
            verdict = F.when(c["known"], 0).when(score >= limit, 1).otherwise(2)
            return F.struct(*[c[x].alias(x) for x in ("kind", "start", "end")], score.alias("score"), verdict.alias("verdict"))

        return F.transform(found, one)

    def apart(judged: Column) -> Column:
        numbers = F.filter(judged, lambda c: (c["kind"] == 4) & (c["verdict"] == 1))
        gives = lambda c, meets: F.struct(*[c[x].alias(x) for x in ("kind", "start", "end", "score")], F.when(meets & (c["verdict"] == 1), 3).otherwise(c["verdict"]).alias("verdict"))
        addresses = let(numbers, lambda n: marked(F.filter(judged, lambda c: c["kind"] == 5), n, gives))
        return F.concat(F.filter(judged, lambda c: c["kind"] == 4), addresses)

    def told(base: Column) -> Column:
        def whole(judged: Column) -> Column:
            added = F.transform(F.filter(judged, lambda c: c["verdict"] == 1), three)
            return F.struct(base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"), judged.alias("judged"))

        return let(let(scored(candidates(text, base)), apart), whole)

    return let(base_spans(text), told)


def find(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with pii_base and pii_spans: arrays of struct<kind, start, end> by kind, then start; and pii_judged.

    pii_spans holds the base spans and the selected candidates that meet no base span; an address that meets a selected
    number gives way. pii_judged has every candidate's score and verdict (located()). A null text is an empty one. Columns
    of ``docs`` with these names give way.
    """
    held = fresh_name(docs, "_pii")
    own = {"pii_base": "base", "pii_spans": "spans", "pii_judged": "judged"}
    plain = [F.col(c) for c in docs.columns if c.lower() not in own]
    return docs.withColumn(held, located(F.col(text_col), model)).select(*plain, *[F.col(held)[field].alias(name) for name, field in own.items()])


VERDICTS = ["base", "added", "refused", "gave_way"]


def digest(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, judged) of every row.

    judged: kind:start:end:verdict:score of each candidate, the score in thousandths, joined by commas.
    """
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    names = F.array(*[F.lit(v) for v in VERDICTS])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda c: F.concat_ws(":", F.get(kinds, c["kind"]), c["start"].cast("string"), c["end"].cast("string"), F.get(names, c["verdict"]), F.round(c["score"] * 1000).cast("long").cast("string"))
    told = lambda f: F.struct(
        *[count(f["base"], k).alias(f"n_{n}") for k, n in enumerate(KINDS[:4])],
        F.sha2(joined(f["base"], KINDS), 256).alias("base_sha256"), joined(f["spans"], KINDS).alias("spans"),
        (F.size(f["spans"]) - F.size(f["base"])).cast("long").alias("n_added"), F.array_join(F.transform(f["judged"], one), ",").alias("judged"),
    )
    return docs.select(F.col(id_col).alias("doc_id"), let(located(F.col(text_col), model), told).alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets, as ``[EMAIL]``; overlapping spans by the first's."""
    held = fresh_name(docs, "_pii")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = lambda found: F.array_sort(F.transform(found["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = docs.withColumn(held, let(located(F.col(text_col), model), ordered))
    return replaced(out, text_col, held, names).select(*docs.columns)
