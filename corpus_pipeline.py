"""A corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from terrafolio.llm import decontam, langid, mixing, ngram_join, pii
from terrafolio.llm.common import Scratch, table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, by a model of the documents' own languages: those without a letter, or in
    which no language has half of the posterior, go."""
    return langid.keep(docs, langid.fit(docs), least_score=0.5)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest doc_id."""
    return ngram_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the rates at which to draw them, so that languages weigh the same."""
    model = mixing.fit(docs, mixing.language_quality(docs, table(spark, sf_dir, "labels")))
    return mixing.mix(docs, replace(model, params=replace(model.params, weights=mixing.balanced(model.domains))))


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_domains),
]

#: SQL can't express the stages' models; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table; what a stage returns is written as Parquet and read by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
