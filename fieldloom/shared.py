"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it names nothing, a temporary folder serves a local session (tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
    if not hasattr(spark, "_fieldloom"):
        spark._fieldloom = tempfile.mkdtemp(prefix="fieldloom-")
    return spark._fieldloom


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else has."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder."""
    path = fresh(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
