"""From raw documents to packed token rows, in five stages.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Stages with Python tasks bound the session's Arrow batches
(``small_batches``): what they return is computed when it is written, by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import decontamination, mixing, neardup, packing, quality
from vecspark.llm.support import small_batches, table, write_step


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    small_batches(spark)
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumnRenamed("score", "__score"), model)
    return scored.where(scored["score"] >= quality.THRESHOLD).drop("score").withColumnRenamed("__score", "score")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that sources meet their target weights."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into rows of fixed length."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the trained classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_step(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
