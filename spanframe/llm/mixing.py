"""Mixing sources to target weights by soft membership. DataFrame functions only.

A naive-Bayes classifier over hashed words, trained on a bounded sample of labelled documents, gives every document a
posterior over domains. Nonnegative rates are then fitted by projected gradient least squares so that the expected tokens
of each domain, the sum of rate times tokens times posterior, match the targets. A gradient step needs only the residual,
one number for each domain, so each round is one aggregation over the documents; a document's rate follows from its own
row and the list of residuals so far. Residuals are weighed by the inverse Gram matrix of the domains, which gives steps
of length one and few rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bounded_sample, fresh_name, saved


@dataclass(frozen=True)
class MixParams:
    #: Labelled rows used at most for the classifier; those of smallest id hash.
    labelled_rows: int = 20_000
    #: Word buckets of the classifier.
    buckets: int = 4096
    #: Domains at most; more is an error.
    most_domains: int = 64
    #: A text's evidence counts as that of so many words, so that long texts don't get certain memberships.
    sharpness: float = 12.0
    #: Without targets, a domain's weight is its natural share to this power.
    temperature: float = 0.7
    rounds: int = 60
    tolerance: float = 1e-9


WORDS = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")


def _bucket(word: Column, params: MixParams) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(params.buckets)).cast("int")


@dataclass
class DomainModel:
    domains: list[str]
    #: For each domain: log prior, and the log likelihood of each bucket.
    priors: list[float]
    logs: np.ndarray


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, params: MixParams) -> DomainModel:
    """The classifier of ``domain_col``, from labelled documents of good quality that aren't toxic."""
    good = labels.where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("_id")).distinct()
    sample = docs.join(F.broadcast(bounded_sample(good, "_id", params.labelled_rows)), F.col(id_col) == F.col("_id")).where(F.col(domain_col).isNotNull())
    sample = sample.select(F.col(domain_col).cast("string").alias("domain"), _words(F.col(text_col)).alias("words"))
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().orderBy("domain").limit(params.most_domains + 1).collect()}
    if len(sizes) > params.most_domains:
        raise ValueError(f"{domain_col} has more than {params.most_domains} values")
    domains = sorted(sizes)
    counts = np.zeros((len(domains), params.buckets))
    # explode() would have texts split once more below the join, for all documents, to test that they have words
    words = sample.select("domain", F.explode_outer("words").alias("word")).where("word IS NOT NULL")
    rows = words.groupBy("domain", _bucket(F.col("word"), params).alias("bucket")).count()
    for r in rows.collect():  # as many as domains times buckets at most
        counts[domains.index(r["domain"]), r["bucket"]] = r["count"]
    total = sum(sizes.values())
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * params.buckets))
    return DomainModel(domains, [math.log(sizes[d] / total) for d in domains], logs)


def memberships(docs: DataFrame, model: DomainModel, id_col: str, text_col: str, params: MixParams) -> DataFrame:
    """(id, text_hash, tokens, posterior array) of each distinct (id, text); tokens are summed over repeated rows."""
    spark = docs.sparkSession
    names = [f"l{k}" for k in range(len(model.domains))]
    table = spark.createDataFrame([(b, *map(float, model.logs[:, b])) for b in range(params.buckets)], "bucket int, " + ", ".join(f"{n} double" for n in names))
    text = F.col(text_col)
    # the hash is worked out below the explode, once for a text and not once for each of its words
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.split(F.lower(text), WORDS).alias("words"))
    words = texts.select("id", "text_hash", F.explode_outer("words").alias("word"))
    words = words.withColumn("word", F.when(F.col("word") != "", F.col("word"))).withColumn("bucket", _bucket(F.col("word"), params))
    scored = words.join(F.broadcast(table), "bucket", "left")
    sums = scored.groupBy("id", "text_hash").agg(F.count("word").alias("tokens"), *[F.sum(F.when(F.col("word").isNotNull(), F.col(n))).alias(n) for n in names])
    n = F.greatest(F.col("tokens"), F.lit(1))
    scale = F.least(n, F.lit(params.sharpness)) / n
    logs = F.array(*[F.lit(p) + F.coalesce(F.col(x), F.lit(0.0)) * scale for p, x in zip(model.priors, names)])
    power = F.transform(F.col("logs"), lambda x: F.exp(x - F.array_max("logs")))
    out = sums.select("id", "text_hash", "tokens", logs.alias("logs")).select("id", "text_hash", "tokens", power.alias("power"))
    whole = F.aggregate("power", F.lit(0.0), lambda s, x: s + x)
    return out.select("id", "text_hash", "tokens", F.transform("power", lambda x: x / whole).alias("posterior"))


def _rate(part: Column, history: list[list[float]]) -> Column:
    """The rate after the steps of ``history``: each takes part . step off, and then the rate is made nonnegative."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in history])
    dot = lambda g: F.aggregate(F.arrays_zip(part.alias("a"), g.alias("g")), F.lit(0.0), lambda s, x: s + x["a"] * x["g"])
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(members: DataFrame, domains: int, targets: list[float] | None, params: MixParams) -> tuple[list[list[float]], list[float]]:
    """The steps from rates of one, and the targets as shares of all tokens."""
    total = members.agg(F.sum("tokens")).first()[0] or 0
    if not total or not domains:
        return [], targets or []
    part = [F.get("posterior", k) * F.col("tokens") / F.lit(float(total)) for k in range(domains)]
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(part)]
    squares = [F.sum(part[i] * part[j]).alias(f"q{i}_{j}") for i in range(domains) for j in range(i, domains)]
    first = members.agg(*sums, *squares).first()
    share = np.array([first[f"s{k}"] for k in range(domains)])
    gram = np.array([[first[f"q{min(i, j)}_{max(i, j)}"] for j in range(domains)] for i in range(domains)])
    if targets is None:
        tempered = share**params.temperature
        targets = list(tempered / tempered.sum())
    goal = np.array(targets)
    weigh = np.linalg.pinv(gram, hermitian=True)
    history: list[list[float]] = []
    now = share
    for _ in range(params.rounds):
        error = now - goal
        if np.abs(error).max() <= params.tolerance:
            break
        history.append(list(weigh @ error))
        parts = F.transform("posterior", lambda p: p * F.col("tokens") / F.lit(float(total)))
        row = members.select(parts.alias("part")).withColumn("rate", _rate(F.col("part"), history)).agg(*[F.sum(F.get("part", k) * F.col("rate")) for k in range(domains)]).first()
        before, now = now, np.array(row)
        if np.abs(now - before).max() <= params.tolerance / 10:  # no nonnegative rates come nearer
            break
    return history, list(goal)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", params: MixParams = MixParams()) -> tuple[DataFrame, list[str]]:
    """(id, text_hash, tokens, posterior, rate) of each distinct (id, text), and the names of the domains in order.

    targets: domain -> weight, scaled to sum to one; a domain left out has weight zero. Rates say how often a document is
    to be taken; their weighted tokens sum to the corpus's tokens. A text without words has the prior as posterior and
    rate one. Rows that repeat an id and a text share a row. Without labelled documents there is one domain, and all
    rates are one. Null ids and texts are ids and texts like others; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, domain_col, params)
    if not model.domains:
        model = DomainModel(["all"], [0.0], np.zeros((1, params.buckets)))
        targets = None
    members = saved(memberships(docs, model, id_col, text_col, params), "mix-members")
    goal = None
    if targets is not None:
        weights = [targets.get(d, 0.0) for d in model.domains]
        goal = [w / sum(weights) for w in weights]
    history, _ = fit_rates(members, len(model.domains), goal, params)
    total = F.lit(float(members.agg(F.sum("tokens")).first()[0] or 1))
    parts = members.withColumn("part", F.transform("posterior", lambda p: p * F.col("tokens") / total))
    return parts.withColumn("rate", _rate(F.col("part"), history)).drop("part"), model.domains


def digest(docs: DataFrame, labels: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(doc_id, tokens, domain, posterior, rate) with posteriors and rates rounded to six places."""
    mixed, domains = mix(docs, labels, params=params)
    names = F.array(*[F.lit(d) for d in domains])
    best = F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return mixed.select(
        F.col("id").alias("doc_id"), "tokens", best.alias("domain"), F.transform("posterior", lambda p: F.round(p, 6)).alias("posterior"), F.round("rate", 6).alias("rate")
    )


def with_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MixParams = MixParams()) -> DataFrame:
    """``docs`` with mix_rate and mix_copies, the rate rounded up or down by the id's hash so that its mean is kept.

    Documents of rate zero stay, with zero copies. Columns of ``docs`` with these names give way to the operator's.
    """
    mixed, _ = mix(docs, labels, None, id_col, text_col, params=params)
    key, text = fresh_name(docs, "_mix_id"), fresh_name(docs, "_mix_hash")
    rates = mixed.select(F.col("id").alias(key), F.col("text_hash").alias(text), F.col("rate").alias("mix_rate"))
    plain = docs.select(*[F.col(c) for c in docs.columns if c.lower() not in ("mix_rate", "mix_copies")])
    joined = plain.join(rates, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(text)))
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    copies = (F.floor("mix_rate") + (chance < F.col("mix_rate") - F.floor("mix_rate")).cast("long")).alias("mix_copies")
    return joined.select(*plain.columns, "mix_rate", copies)
