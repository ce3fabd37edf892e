"""Tables by commits, and results kept until their files change."""

import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fieldloom.plans import kept
from fieldloom.sinks import atomic

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark, rows):
    return spark.createDataFrame(rows, "exp_id string, layout_id string, n int, tags map<string,string>").repartition(2)


def seen(spark, path, **more):
    return sorted(((r.exp_id, r.layout_id, r.n) for r in atomic.committed(spark, path, ["exp_id", "layout_id"], **more).collect()), key=str)


def test_commits_replace_their_slots(spark, tmp_path):
    at = str(tmp_path)
    assert seen(spark, at, schema="exp_id string, layout_id string, n int") == []
    with pytest.raises(ValueError):
        atomic.committed(spark, at)
    first = table(spark, [("a/b", "l 1", 1, {"x": "y"}), ("a/b", "l 1", 2, None), ("a/b", None, 3, {}), ("c", "2", 4, {})])
    assert atomic.commit(first, at, ["exp_id", "layout_id"]) == 0
    assert atomic.commit(table(spark, [("a/b", "l 1", 9, {})]), at, ["exp_id", "layout_id"], "again") == 1
    rows = [("a/b", "l 1", 9), ("a/b", None, 3), ("c", "2", 4)]
    assert seen(spark, at) == sorted(rows, key=str)
    assert len(seen(spark, at, upto=0)) == 4 and atomic.filled(spark, at, ["exp_id", "layout_id"]).count() == 3
    assert atomic.committed(spark, at, ["exp_id", "layout_id"]).columns == first.columns
    assert atomic.commit(first.limit(0), at, ["exp_id", "layout_id"]) == 2 and len(seen(spark, at)) == 3


def test_a_job_that_dies_leaves_nothing_to_see(spark, tmp_path):
    at, marker = str(tmp_path / "t"), tmp_path / "once"

    @F.udf("int")
    def breaks(n):
        if n == 77 and not os.path.exists(marker):
            time.sleep(1)  # the other partition is written by then
            raise RuntimeError("lost")
        return n

    whole = spark.range(0, 100, 1, 2).select(F.lit("e").alias("exp_id"), (F.col("id") % 3).cast("string").alias("layout_id"), breaks(F.col("id").cast("int")).alias("n"))
    atomic.commit(whole.where("id < 10"), at, ["exp_id", "layout_id"])
    before = seen(spark, at)
    with pytest.raises(Exception, match="lost"):
        atomic.commit(whole, at, ["exp_id", "layout_id"])
    assert seen(spark, at) == before and atomic.log(spark, at).count() == 1
    marker.touch()
    atomic.commit(whole, at, ["exp_id", "layout_id"])
    assert seen(spark, at) == sorted((("e", str(k % 3), k) for k in range(100)), key=str)
    assert len(atomic.vacuum(spark, at)) == 1 and atomic.vacuum(spark, at) == [] and len(seen(spark, at)) == 100


def test_two_writers_take_two_versions_and_added_rows_stay(spark, tmp_path, monkeypatch):
    at, rows = str(tmp_path), spark.range(3)
    atomic.commit(rows, at)
    real = atomic.Folder.names
    monkeypatch.setattr(atomic.Folder, "names", lambda self, name: [] if name == "log" else real(self, name))  # both have seen an empty log
    assert atomic.commit(rows, at) == 1
    monkeypatch.undo()
    assert atomic.committed(spark, at).count() == 6 and [r.version for r in atomic.log(spark, at).orderBy("version").collect()] == [0, 1]


def test_damage_is_found(spark, tmp_path):
    at = str(tmp_path)
    atomic.commit(table(spark, [("a", "1", 1, {"k": "v"}), ("a", "2", 2, {})]), at, ["exp_id", "layout_id"])
    assert atomic.damaged(spark, at).count() == 0
    batch = next((tmp_path / "data").iterdir())
    table(spark, [("a", "3", 3, {})]).coalesce(1).write.mode("append").partitionBy("exp_id", "layout_id").parquet(str(batch))
    next((batch / "exp_id=a" / "layout_id=1").glob("*.parquet")).unlink()
    found = atomic.damaged(spark, at).collect()
    assert sorted((r.was is None, r.now is None) for r in found) == [(False, True), (True, False)]


def test_results_are_computed_again_for_changed_files_alone(spark, tmp_path):
    folder, at, computed = tmp_path / "pages", str(tmp_path / "kept"), []
    for x in "abc":
        (folder / x).mkdir(parents=True)
        for k in range(3):
            (folder / x / f"{k}.html").write_text(f"<h1>{x}{k}</h1>")

    def files():
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
        rows = raw.select("*", F.col("path").alias("file"), F.col("modificationTime").alias("changed_at"), F.col("length").alias("size"))
        return rows.withColumn("layout_id", F.element_at(F.split("path", "/"), -2))

    def compute(rows):
        computed.append(sorted({r.layout_id for r in rows.select("layout_id").collect()}))
        return rows.where("size > 0").select("layout_id", F.element_at(F.split("path", "/"), -1).alias("page"), F.regexp_extract(F.col("content").cast("string"), "<h1>(.*)</h1>", 1).alias("title"))

    def titles():
        computed.clear()
        out = sorted((r.layout_id, r.title) for r in kept.refreshed(files(), ["layout_id"], compute, at).collect())
        return out, computed[1:]  # the first call asks for the schema alone

    every = [(x, f"{x}{k}") for x in "abc" for k in range(3)]
    assert titles() == (every, [["a", "b", "c"]])
    assert titles() == (every, [])
    (folder / "b" / "1.html").write_text("<h1>other</h1>")
    assert titles() == (sorted([r for r in every if r != ("b", "b1")] + [("b", "other")]), [["b"]])
    (folder / "c" / "2.html").unlink()
    (folder / "a" / "9.html").write_text("<h1>a9</h1>")
    out, again = titles()
    assert again == [["a", "c"]] and ("a", "a9") in out and ("c", "c2") not in out
    for k in range(3):
        (folder / "b" / f"{k}.html").write_text("")  # files without results
    assert [r for r in titles()[0] if r[0] == "b"] == [] and titles()[1] == []
    for f in (folder / "c").iterdir():
        f.unlink()
    out, again = titles()
    assert {x for x, _ in out} == {"a"} and again == []
