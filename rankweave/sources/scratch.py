"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if the executors are this process (tests), else an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[context.applicationId]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that what follows may read it more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: Column | int = 64, max_bytes: int = 64 << 20) -> DataFrame:
    """df (a saved table) with a broadcast hint if its rows, of row_bytes each, come to at most max_bytes; else df: Spark then shuffles."""
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes else df
