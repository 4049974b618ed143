"""Registered queries of the training-data operators: name -> function, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytecnn, decontam, hmm, importance, linecrf, lshforest, merkle, mixing, oracles, pii, secret_scan, simhash, token_cache, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_language_model": hmm.query,
        "op3_token_counts": token_cache.query,
        "op4_quality_cnn": bytecnn.query,
        "op5_source_mixing": mixing.query,
        "op6_secret_scan": secret_scan.query,
        "op7_pii": pii.query,
        "op8_decontamination": decontam.query,
        "op9_line_quality": linecrf.query,
        "op10_near_duplicates": lshforest.query,
        "op11_simhash": simhash.query,
        "op12_merkle_manifest": merkle.query,
        "op13_importance_resampling": importance.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_secret_scan": oracles.SECRET_SCAN,
        "op7_pii": oracles.PII,
        "op10_near_duplicates": oracles.NEAR_DUPLICATES,
        "op12_merkle_manifest": oracles.MERKLE,
        "op13_importance_resampling": oracles.RESAMPLE,
    }
