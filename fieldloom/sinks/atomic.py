"""Tables that change by commits: a job's files are staged, and one manifest makes them visible or nothing does.

A table is a folder with ``data/batch=<id>/`` for each write and ``log/<version>.json`` for each commit. A manifest names its
batch, the schema, the slots it fills (values of the slot columns, such as experiment and layout) and for each file its rows and a
checksum over them. Manifests are renamed into place and never change; of two writers that want the same version, one
takes the next. Readers see the batches in the log only, and of each slot the newest one. What a killed job leaves behind is in no
manifest: it is never read, and ``vacuum`` deletes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, batch string, schema string, note string, slots array<map<string,string>>, files array<struct<file:string,rows:long,checksum:long>>"


class Folder:
    """Files beside a table, wherever Spark's file systems can put them."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, name: str) -> list[str]:
        at = self.at(name)
        return sorted(x.getPath().getName() for x in self.files.listStatus(at)) if self.files.exists(at) else []

    def publish(self, text: str, name: str) -> bool:
        """Writes a file under a name of its own and renames it; False if the name is taken."""
        hidden = self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self.files.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        options = self.gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").NONE
        try:
            context.rename(hidden, self.at(name), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.files.delete(hidden, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)


#: Over rows in any order, repeated ones too.
CHECKSUM = "try_cast(sum(cast(h as decimal(38, 0))) % 9223372036854775807 as long)"


def _measured(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows and checksum by key; rows as they are in files."""
    own = [c for c in rows.columns if c not in key]
    return rows.withColumn("h", F.xxhash64(F.to_json(F.struct(*own)) if own else F.lit(""))).groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.expr(CHECKSUM).alias("checksum"))


def log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The manifests, a row each."""
    names = [n for n in Folder(spark, path).names("log") if not n.startswith(".")]
    if not names:
        return spark.createDataFrame([], MANIFEST)
    found = spark.read.schema(MANIFEST).json([f"{path}/log/{n}" for n in names])
    return found if upto is None else found.where(F.col("version") <= upto)


def commit(df: DataFrame, path: str, slots: list[str] = (), note: str = "") -> int:
    """Writes df and makes it visible at once; returns the version. With slot columns, it replaces what earlier commits put into its slots; without, it adds rows."""
    spark, folder, batch = df.sparkSession, Folder(df.sparkSession, path), f"b{uuid.uuid4().hex}"
    staged = f"{path}/data/batch={batch}"
    out = df.write
    (out.partitionBy(*slots) if slots else out).parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged).select("*", F.col("_metadata.file_path").alias("_file"))
    found = _measured(rows, ["_file", *slots]).collect()  # a row per file
    filled = [dict(x) for x in {tuple((s, None if r[s] is None else str(r[s])) for s in slots): 0 for r in found}] if slots else []
    files = [{"file": r["_file"].rpartition(f"batch={batch}/")[2], "rows": r["rows"], "checksum": r["checksum"]} for r in found]
    version = len([n for n in folder.names("log") if not n.startswith(".")])
    while True:
        text = json.dumps({"version": version, "batch": batch, "schema": df.schema.json(), "note": note, "slots": filled, "files": files})
        if folder.publish(text, f"log/{version:012}.json"):
            return version
        version += 1


def filled(spark: SparkSession, path: str, slots: list[str], upto: int | None = None) -> DataFrame:
    """The slots that hold rows, each with the batch that filled it last."""
    one = log(spark, path, upto).select("version", "batch", F.explode("slots").alias("slot"))
    return one.groupBy(*[F.col("slot")[s].alias(s) for s in slots]).agg(F.max_by("batch", "version").alias("batch"))


def committed(spark: SparkSession, path: str, slots: list[str] = (), schema: StructType | str | None = None, upto: int | None = None) -> DataFrame:
    """The table as of its last commit, or of an earlier version. schema: what an empty table has; needed before the first commit only."""
    known = log(spark, path, upto).orderBy(F.desc("version")).select("schema").first()
    if known is None:
        if schema is None:
            raise ValueError(f"nothing was committed to {path}")
        return spark.createDataFrame([], schema)
    kind = StructType.fromJson(json.loads(known["schema"]))
    rows = spark.read.schema(StructType.fromJson(kind.jsonValue()).add("batch", "string")).parquet(f"{path}/data")
    live = (filled(spark, path, slots, upto) if slots else log(spark, path, upto).select("batch")).withColumnsRenamed({s: f"_{s}" for s in slots})
    same = F.col("batch") == F.col("_batch")
    for s in slots:
        same = same & rows[s].cast("string").eqNullSafe(F.col(f"_{s}"))
    return rows.join(live.withColumnRenamed("batch", "_batch"), same, "left_semi").select(*kind.names)


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Files of committed batches that are gone, changed or added since: batch, file, and rows and checksum as written (was) and as found (now)."""
    head = log(spark, path)
    schemas = [r["schema"] for r in head.select("schema").distinct().collect()]
    was = head.select("batch", F.explode("files").alias("f")).select("batch", "f.file", F.struct("f.rows", "f.checksum").alias("was"))
    now = None
    for text in schemas:  # a table has few
        kind = StructType.fromJson(json.loads(text))
        batches = head.where(F.col("schema") == text).select("batch", F.explode(F.when(F.size("slots") > 0, F.map_keys(F.get("slots", F.lit(0)))).otherwise(F.array(F.lit("")))).alias("slot")).groupBy("batch").agg(F.collect_set("slot").alias("slots"))
        slots = sorted({s for r in batches.select("slots").distinct().collect() for s in r["slots"]} - {""})
        rows = spark.read.schema(StructType.fromJson(kind.jsonValue()).add("batch", "string")).parquet(f"{path}/data").select("*", F.col("_metadata.file_path").alias("_file")).join(batches.select("batch"), "batch", "left_semi")
        part = _measured(rows, ["batch", "_file", *slots]).select("batch", F.regexp_extract("_file", r"batch=[^/]+/(.*)$", 1).alias("file"), F.struct("rows", "checksum").alias("now"))
        now = part if now is None else now.unionByName(part)
    return was.join(now, ["batch", "file"], "full").where(~F.col("was").eqNullSafe(F.col("now"))) if now is not None else was.withColumn("now", F.col("was")).limit(0)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the batches that no manifest names; for times when nobody writes. Returns them."""
    folder, known = Folder(spark, path), {r["batch"] for r in log(spark, path).select("batch").collect()}
    gone = [n for n in folder.names("data") if n.removeprefix("batch=") not in known]
    for n in gone:
        folder.delete(f"data/{n}")
    return gone
