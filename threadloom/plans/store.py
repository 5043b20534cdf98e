"""A table that is written once where a plan forks."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="threadloom-")


def base_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one serves a local master, and a cluster gets an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local()
    return base.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The frame, written to the folder in spark.checkpoint.dir and read back: later steps read the columns they need, and a lost executor recomputes nothing.

    The folder is that of ``base_dir``.
    """
    spark = df.sparkSession
    path = f"{base_dir(spark)}/threadloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
