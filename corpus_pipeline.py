"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination and mixing, each on what the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from tessera.llm.shared import shared_dir, table


def unused(name: str, docs: DataFrame) -> str:
    """The name, or a longer one that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model scores below a half."""
    score = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return docs.where(score < 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that an earlier place has."""
    gone = unused("removed", docs)
    out = line_dedup.drop_repeats(docs, out=gone)
    n = F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*[f"`{c}`" for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark."""
    hits = unused("hits", docs)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out=hits)
    return found.where(~decontaminate.contaminated(F.col(hits))).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix(docs).select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The learned and hashed stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
