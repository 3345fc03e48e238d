"""Tables of the given folder, and intermediate ones in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir; where that is unset, as in local tests, below a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/chronofold-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to a new folder and read back: later steps survive lost executors and do not redo it."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
