"""Exact ranks in groups of any size, by counts per range of values: no group is gathered, sorted whole or held by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

RANGES = 1024
FEW = 10_000


def nth(df: DataFrame, by: list[str], value: str, place: Column, few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """by, n and nth: of each group's values in ascending order the one with that place from 0, place being an expression over n (such as floor(n / 2), the upper median).

    Each round counts the values per range between a group's lowest and highest candidate and goes on with the range that holds the place, until it has few
    values or one; only those are numbered. Nulls and NaN aren't counted; groups without a value, or without that place, have no row.
    """
    keys = [f"_{k}" for k in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    if not by:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = kept(first.withColumns({"left": place.cast("long"), "inside": F.col("n")}).where("left >= 0 and left < n"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    while not (wide := state.where((F.col("inside") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        open_ = wide.select(*keys, "n", "lo", "hi", "left")
        pair = rows.alias("r").join(open_.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]).where("v between lo and hi")
        # the quotients grow with the values, whatever is rounded, so ranges are in order
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (ranges - 1))
        sums = pair.select(*[F.col(f"r.{k}").alias(k) for k in keys], "n", "left", "v", part.alias("part")).groupBy(*keys, "part", "n", "left").agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy(*keys).orderBy("part"))
        found = sums.withColumn("upto", upto).where("upto > left and upto - inside <= left").select(*keys, "n", "lo", "hi", (F.col("left") - F.col("upto") + F.col("inside")).alias("left"), "inside")
        state = kept(state.where((F.col("inside") <= few) | (F.col("lo") >= F.col("hi"))).select(*keys, "n", "lo", "hi", "left", "inside").unionByName(found))
    names = [F.col(k).alias(b) for k, b in zip(keys, by, strict=False)]
    known = state.where("lo = hi").select(*names, "n", F.col("lo").alias("nth"))
    rest = state.where("lo < hi")
    pair = rows.alias("r").join(rest.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]).where("v between lo and hi").select(*[F.col(f"r.{k}").alias(k) for k in keys], "n", "left", "v")
    ranked = pair.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1).where("k = left")
    return known.unionByName(ranked.select(*names, "n", F.col("v").alias("nth")))


def upper_median(df: DataFrame, by: list[str], value: str, **options) -> DataFrame:
    """by, n and median: the middle value, of an even number the upper one."""
    return nth(df, by, value, F.floor(F.col("n") / 2), **options).withColumnRenamed("nth", "median")
