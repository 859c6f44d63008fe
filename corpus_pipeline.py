"""From raw documents to a training mixture: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightwell.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from brightwell.llm.common import discard, materialize, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source carry go; no document goes."""
    return line_dedup.drop_boilerplate(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by epoch, to the target weights of the sources."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", contaminated), ("mixing", mixture)]
# SQL cannot express the language models of the first stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*kept)  # what the stage before it kept is no longer read
        kept = [docs]
    return docs
