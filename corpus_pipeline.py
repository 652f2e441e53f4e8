"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
calls one operator of ``trustlens.llm``.  All but the last return rows of the columns of
``documents``.  ``run`` writes every stage's rows as Parquet under the shared checkpoint
folder and reads them as the next one's documents.

The stages' parameters are the operators' own defaults.  Labels for the quality stage
and the benchmark come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trustlens.llm import bpe, decontaminate, exact_dedup, quality, simhash
from trustlens.llm.common import documents, table
from trustlens.session import materialize, prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject; all, without a label to learn from."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    prepare(spark)
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    prepare(spark)
    return bpe.round_trip(docs, bpe.vocabulary())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage),
          ("benchmark_decontamination", benchmark_stage), ("bpe", bpe_stage)]

#: SQL cannot express the field's training, SimHash and BPE; tests/llm/test_pipeline.py
#: holds the rows against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
