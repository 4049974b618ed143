"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE re-plans joins and splits skewed partitions at run time; UTC keeps timestamps comparable.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("gridquill")
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def doctor(spark: SparkSession) -> dict[str, object]:
    """Health report: versions, settings that matter, optional model libraries."""
    import importlib.util

    return {
        "spark": spark.version,
        "settings": {k: spark.conf.get(k, None) for k in DEFAULTS},
        "optional": {m: importlib.util.find_spec(m) is not None for m in ("fastembed", "openpyxl", "onnxruntime", "tokenizers")},
    }
