"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the training tokens (its target) and a schedule that shifts the share over
training time. The schedule's integral is the source's cumulative demand; the position of a document
is the time at which the demand reaches the tokens of its source that come before it. Documents of a
source follow one another in the order of a hash of their id and text, in as many passes as the target needs.

Running sums don't gather a source in one task: tokens are first summed per source and hash prefix
(4,096 prefixes), those sums are accumulated, and only the documents of one prefix are then windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut, named, quoted

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: How a source's weight changes from the start to the end of training, in the same turn as the weights: half of slope below its mean first, half above it last, and so on.
SLOPES = (0.5, 0.0, -0.5)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: size, weight and target. sizes: source, source_size.

    Targets are the level times the weight, but never above max_repeat times the size; the level is
    where they add up to all sizes. Sources are capped in the order of cap over weight, so the level
    follows from running sums over that order. There is a row per source here, not per document.
    """
    by_name, by_ratio, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank"), Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("rank", F.row_number().over(by_name))
    df = df.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights)))
    df = df.withColumns({"cap": max_repeat * F.col("source_size")}).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    df = df.withColumns({"c": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w": F.coalesce(F.sum("weight").over(before), F.lit(0)), "all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    level = (F.col("all_size") - F.col("c")).cast("double") / (F.col("all_weight") - F.col("w")).cast("double")
    df = df.withColumn("capped", F.col("ratio") <= level)
    df = df.withColumns({"c": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)), "w": F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0))})
    free = (F.col("all_size") - F.col("c")).cast("double") * F.col("weight") / (F.col("all_weight") - F.col("w")).cast("double")
    return df.select("source", "source_size", "rank", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free).alias("target"))


def position(f: Column, slope: Column) -> Column:
    """The time in [0, 1] at which a source has had the fraction f of its tokens.

    Its weight at time t is in proportion to 1 + slope (2t - 1), so the fraction is t + slope (t^2 - t).
    """
    b = 1 - slope
    return F.when(slope == 0, f).otherwise((F.sqrt(b * b + 4 * slope * f) - b) / (2 * slope))


def mix(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, slopes=SLOPES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row per row of docs: the struct ``row`` of the columns to carry, size, source_size, target, copies, taken, positions.

    A null text has size 0, a null source is a source of its own, the last. A document is taken in
    a pass over its source if its middle comes before the target does, so each source's tokens are
    within half a document of the target and no document is taken more than max_repeat times.
    Sources without a word take nothing. Repeated rows count each; reruns agree, since the order
    depends on ids and texts only. Rows with one id, or none, are spread by their texts; only rows
    equal in both are numbered by one task. An empty table gives no rows.
    """
    key = F.md5(F.concat(F.coalesce(named(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(named(text), F.lit("")))))
    base = docs.select(F.struct(*[named(c) for c in carry]).alias("row"), named(doc_id).alias("id"), named(source).alias("source"), key.alias("key"), n_words(named(text)).alias("size"))
    base = base.withColumn("prefix", F.substring("key", 1, 3))
    sums = cut(base.groupBy("source", "prefix").agg(F.sum("size").alias("prefix_size")))
    runs = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    plan = targets(sums.groupBy("source").agg(F.sum("prefix_size").alias("source_size")), weights, max_repeat)
    starts = sums.withColumn("start", F.coalesce(F.sum("prefix_size").over(runs), F.lit(0))).select(F.col("source").alias("s"), F.col("prefix").alias("p"), "start")
    starts = starts.join(plan, starts.s.eqNullSafe(plan.source)).drop("source")
    inside = Window.partitionBy("source", "prefix").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    df = base.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(starts, df.source.eqNullSafe(F.col("s")) & (df.prefix == F.col("p")))
    middle = F.col("start") + F.col("before") + F.col("size") / 2.0
    passes = F.ceil((F.col("target") - middle) / F.col("source_size"))
    df = df.withColumns({"middle": middle, "copies": F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat), F.greatest(F.lit(0), passes))).otherwise(0).cast("int")})
    slope = F.get(F.array(*map(F.lit, slopes)), (F.col("rank") - 1) % len(slopes))
    at = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: position(F.least(F.lit(1.0), (p * F.col("source_size") + F.col("middle")) / F.col("target")), slope))
    return df.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>")).alias("positions"))


def curriculum(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs as training takes them: a row per copy, range-sorted by position; the columns stay those of docs.

    Rows that mix() takes no copy of go. Rows at equal positions follow in the order of a hash of id and text. Null ids, texts and sources
    are treated as in mix(); an empty table gives no rows.
    """
    df = mix(docs, docs.columns, text, doc_id, **options).select("row", F.explode("positions").alias("position"))
    return df.orderBy("position", F.xxhash64(*(f"row.{quoted(c)}" for c in (doc_id, text)))).select("row.*")
