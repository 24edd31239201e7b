"""A corpus pipeline of five stages, each applying one operator to all that the stage before kept.

Order: quality classifier, near-duplicate removal, benchmark decontamination, personal data, mixing. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanframe.llm import decontam, mixing, pii, simhash, weaklabel
from spanframe.llm.common import read_table, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality and toxic ones."""
    model = weaklabel.fit(docs, read_table(spark, sf_dir, "labels"))
    return weaklabel.classify(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a passage of the benchmark."""
    return decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark")).where("kept").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    return pii.redact(docs, pii.fit(docs))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds mix_rate and mix_copies: how often each document is to be taken so that domains have their target weights."""
    return mixing.with_rates(docs, read_table(spark, sf_dir, "labels"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_rates),
]

#: SQL can't express the stages: trained models, random walks and fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
