"""Results kept until their input files change, per key (such as the layout the files belong to).

A key's signature is made from its files' paths, sizes and times of modification. Results carry the signature they were computed
from, and both are written by commits; a later call computes the keys whose signature is new, and reads everything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import atomic


def with_files(df: DataFrame) -> DataFrame:
    """Rows read from files with what a signature needs: file, changed_at, size."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed_at"), F.col("_metadata.file_size").alias("size"))


def signature() -> Column:
    """Of rows (file, changed_at, size): number of files, latest change, and a sum of hashes that any other change shows in."""
    return F.concat_ws("-", F.count(F.lit(1)), F.unix_micros(F.max("changed_at")), F.hex(F.expr("try_cast(sum(cast(xxhash64(file, changed_at, size) as decimal(38, 0))) % 9223372036854775807 as long)")))


def signatures(files: DataFrame, key: list[str]) -> DataFrame:
    """key and signature; files: key columns, file, changed_at, size, a file perhaps in many rows."""
    return files.select(*key, "file", "changed_at", "size").distinct().groupBy(*key).agg(signature().alias("signature"))


def refreshed(files: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Results of all keys of files (rows as with_files gives them, and key columns). compute turns the rows of some keys into results with the key columns; it gets only keys
    whose files have changed since the results at path, or that are new. Results of keys without files are no longer seen."""
    spark: SparkSession = files.sparkSession
    now = signatures(files, key)
    done = atomic.committed(spark, f"{path}/signatures", key, now.schema)
    changed = now.join(done, [*key, "signature"], "left_anti")
    schema = compute(files).schema
    if not changed.isEmpty():
        rows = compute(files.join(changed.select(*key), key, "left_semi"))
        atomic.commit(rows.join(changed, key), f"{path}/results", key)
        # the keys that have been computed, those without results too; last, so that a run that is cut off computes them again
        atomic.commit(changed, f"{path}/signatures", key)
    kept = atomic.committed(spark, f"{path}/results", key, schema.add("signature", "string"))
    return kept.join(now, [*key, "signature"], "left_semi").select(*[c for c in kept.columns if c != "signature"])
