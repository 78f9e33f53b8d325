"""The corpus pipeline: toxicity, language, near duplicates, benchmark contamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import decontaminate, language, neardup, packing, toxicity
from wayfare.llm.common import persisted, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no learned language with a mean marginal of 0.35, go."""
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id stays."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: Trained models and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to all that the stage before it kept, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name)
        release()  # what the stage's model took in the driver
    return STAGES[-1][1](spark, docs, sf_dir)
