"""Tables that a plan stores once and reads several times, in the folder all nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that has none gets a temporary one: on a
    cluster every machine would write to its own disk, so there it is an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        path = tempfile.mkdtemp(prefix="gridquill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as Parquet and read back, in a folder per value of ``by``."""
    path = f"{scratch_dir(df.sparkSession)}/gridquill/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
