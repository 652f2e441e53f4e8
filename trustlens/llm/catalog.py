"""Queries and SQL checks of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from trustlens.llm import (bpe, chat_format, decontaminate, exact_dedup, fill_in_middle, license_scan, mixing, periodic_runs, quality, sharding, simhash,
                           substring_dedup, token_files)
from trustlens.session import prepare

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_suffix_array_dedup": substring_dedup.op3_suffix_array_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_token_files": token_files.op6_token_files,
    "op7_chat_formatting": chat_format.op7_chat_formatting,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_source_mixing": mixing.op11_source_mixing,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op3_suffix_array_dedup": substring_dedup.ORACLE,
    "op7_chat_formatting": chat_format.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        return run
    return {k: prepared(fn) for k, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    sql = corpus_pipeline.ORACLE_SQL
    return ORACLE | ({"pipeline": sql} if sql else {})
