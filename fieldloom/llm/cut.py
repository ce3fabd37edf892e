"""Cutting lineage where an iterative or branching plan would otherwise recompute its input.

Tables are written as Parquet to the shared folder and read again. Unlike a checkpoint of the rows, a
table brings true sizes to the planner; estimates carried over many joins multiply without bound.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it names none, a temporary one serves a local session (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="fieldloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def named(name: str) -> Column:
    """A column by its name, dots and backticks included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _folder(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into shared storage; a lost executor costs no recomputation of its input. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def until_exit(spark, path: str) -> None:
    """Has a folder deleted when the application ends."""
    files, at = _folder(spark, path)
    files.deleteOnExit(at)


def drop(df: DataFrame) -> None:
    """Deletes the table behind a result of cut() that nothing will read again."""
    remove(df.sparkSession, df._cut)


def remove(spark, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


def small_batches(spark, most: int = 4 << 20) -> None:
    """Bounds the bytes of an Arrow batch: texts may be long, and a batch is held in the JVM and in Python.

    The planner reads the setting when a result is computed, so it stays for the session; a lower one is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name).removesuffix("b")
    if not had.isdigit() or int(had) > most:
        spark.conf.set(name, str(most))
