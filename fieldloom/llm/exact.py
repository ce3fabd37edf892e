"""Exact deduplication behind a two-pass Bloom filter, in DataFrame functions only.

Pass 1 sets one bit of each of two filters per text hash and counts the rows per 64-bit filter word;
a word with more rows than set bits holds a bit that was hit twice. Tasks combine their rows by word
first, so what moves is compact filter words. Pass 2 probes: a row whose words were hit twice in
both filters may have a copy; only such rows shuffle, keyed by the SHA-256 of the normalised text.
All others are proven unique and pass straight through. Hash collisions merely send a unique row
the longer way.

The broadcast side has at most ``FILTER_WORDS`` long words per filter (8 MB of keys), whatever the
corpus; beyond some 10^8 documents the filters fill up and more rows take the second way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut, named

FILTER_WORDS = 1 << 20
SPACE_CHARS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without its white space; null is the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def cells(h: Column, words: int) -> Column:
    """The word and the bit of a hash in the first and in the second filter, from disjoint bits of the hash."""
    bits = words.bit_length() - 1
    cell = lambda i, at: F.struct(F.lit(i).alias("f"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(words - 1)).alias("word"), F.shiftrightunsigned(h, at + bits).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    return F.array(cell(1, 0), cell(2, 32))


def twice_hit(hashes: DataFrame, words: int) -> DataFrame:
    """Pass 1: (f, word) of the filter words some bit of which was set by two rows or more."""
    one = hashes.select(F.explode(cells(F.col("h"), words)).alias("c")).select("c.f", "c.word", F.expr("shiftleft(1L, c.bit)").alias("mask"))
    filled = one.groupBy("f", "word").agg(F.bit_or("mask").alias("seen"), F.count(F.lit(1)).alias("n"))
    return filled.where(F.col("n") > F.bit_count("seen")).select("f", "word")


def exact_dedup(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", filter_words: int = FILTER_WORDS) -> DataFrame:
    """A row per row of docs: the struct ``row`` of the columns to carry, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts one is kept: most characters in the original text, then
    smallest id, a null id last; of rows equal in that too, any one. Null and blank texts are equal
    to each other. An empty table gives no rows. Names inside ``row`` can't clash with the others.
    """
    base = docs.select(F.struct(*[named(c) for c in carry]).alias("row"), named(doc_id).cast("long").alias("id"), F.length(F.coalesce(named(text), F.lit(""))).alias("n"), normalised(named(text)).alias("norm"))
    base = base.withColumn("h", F.xxhash64("norm"))
    found = cut(twice_hit(base.select("h"), filter_words))
    word = F.transform(cells(F.col("h"), filter_words), lambda c: c["word"])
    probed = base.withColumns({"w1": F.get(word, F.lit(0)), "w2": F.get(word, F.lit(1))})
    for f in (1, 2):
        probed = probed.join(F.broadcast(found.where(F.col("f") == f).select(F.col("word").alias(f"w{f}"), F.lit(True).alias(f"hit{f}"))), f"w{f}", "left")
    maybe = F.col("hit1").isNotNull() & F.col("hit2").isNotNull()
    probed = probed.select("row", "id", "n", F.sha2("norm", 256).alias("text_sha256"), maybe.alias("maybe"))
    suspects = cut(probed.where("maybe").drop("maybe").withColumn("no", F.monotonically_increasing_id()))
    rank = F.struct(F.col("n"), F.col("id").isNotNull().alias("known"), F.bitwise_not("id").alias("id"), F.bitwise_not("no").alias("no"))
    # a table of its own: the join's two sides are then plain exchanges, and the planner can split a large group
    groups = cut(suspects.groupBy("text_sha256").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size")))
    copies = suspects.join(groups, "text_sha256").select("row", F.bitwise_not("best.id").alias("keep_id"), "group_size", (F.col("no") == F.bitwise_not("best.no")).alias("kept"), "text_sha256")
    alone = probed.where("not maybe").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(copies)
