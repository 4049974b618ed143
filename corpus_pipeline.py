"""A training-data pipeline over ``documents``: STAGES, run() and ORACLE_SQL.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet to the shared folder and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridquill.llm import decontam, lshforest, mixing, secret_scan, toxicity
from gridquill.llm.common import materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", lshforest.stage),
    ("benchmark_decontamination", decontam.stage),
    ("secret_scans", secret_scan.stage),
    ("mixing", mixing.stage),
]

#: Trained models, hashing and drawing are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
