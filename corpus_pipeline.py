"""Corpus pipeline: quality, near copies, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage's result is written as Parquet and
reread as the next one's documents, then deleted. What a stage stages on the way is
deleted as soon as its decision, a table of ids, is written.

Edge cases, for every stage: an empty table stays empty; extra columns are carried
through. Null and empty texts are judged by the classifier like any other, have no
near copies, leak nothing, hold no secret and pack as their end mark. Repeated rows
are judged each by the classifier; near copies keep all rows of the id that stays.
Rows without a doc_id pass through the stages that decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, packing, quality, secrets
from tidemark.llm.common import crc_fold, release, settled, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the classifier rejects (score below 0.5)."""
    return quality.keep(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 3) != 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group linked by 5-word shingles at 0.8."""
    drop = settled(lambda: jaccard.join(docs, percent=80, words=5, turns=2).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    drop = settled(lambda: decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by a mark; every document stays."""
    return secrets.scan(docs, secrets.train(docs), redact=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
        release(spark, *done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
