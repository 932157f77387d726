"""A training corpus from documents: toxic ones go, one of each near-duplicate group stays, sources are mixed to their
targets, and what the mix takes is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnloom.llm import common, mixing, neardups, packing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of their language; the classifier learns from the labels of those that are
    there. A null or empty text has the score of no words, a null language the common threshold; rows repeat as they
    come; without documents or labels of both kinds nothing goes."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs, net, docs.columns).where(~F.col("flagged"))
    return kept.select("_row.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; documents without words stay, once a doc_id; of rows with one
    doc_id one stays; a null doc_id stays only without words."""
    return neardups.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source in part. A null source is one of its own; null and
    empty texts have no words to take and go."""
    return mixing.repeat(mixing.mix(docs, docs.columns), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null text would be empty, but none is left."""
    return packing.pack(docs, keep_ids=False)


STAGES = [("toxicity", toxicity_stage), ("near_dups", near_dup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stash(docs, f"pipeline-{name}")
    return docs
