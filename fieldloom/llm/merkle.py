"""A Merkle manifest of a data set, over contiguous matrices of hex digests.

Every row is a leaf. The leaves of a language form a sequence, ordered by id, and so do the languages'
subroots, ordered by language. A sequence's nodes get their positions from a range sort and running
sums over its partitions. Aligned blocks of 8^4 nodes are one matrix of 64-byte digests each, reshaped
by the fanout and hashed level by level; the block's last node goes on to the next round, a table 4,096 times
smaller, until each sequence has one node. On the way back each block hands its nodes the siblings
above it, and picks those inside by index arithmetic.

No block holds more than 4,096 nodes, whatever share of the rows a language has, and each round's tables
go to shared storage. A proof is the siblings' digests, level by level and left to right; the place
of a leaf (its position, the length of its sequence, and the same for the language) says where its own digest goes between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesk
from .cut import cut, named, small_batches

FANOUT = 8
LEVELS = 4
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sized(value: Column) -> Column:
    """A value with its number of bytes before it; null is a dash."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def lowered(text: Column) -> Column:
    return F.translate(text, LETTERS, LETTERS.lower())


def levels_of(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // FANOUT), n + 1
    return n


def hashed(nodes: np.ndarray) -> np.ndarray:
    """The parents of a matrix of digests."""
    whole = len(nodes) // FANOUT
    runs = [*nodes[: whole * FANOUT].reshape(whole, FANOUT * HEX), *([nodes[whole * FANOUT :].ravel()] if len(nodes) % FANOUT else [])]
    return np.frombuffer("".join(hashlib.sha256(r.data).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, HEX)


def lift(digests: bytes, size: int, most: int) -> list[np.ndarray]:
    """The levels of a block of a sequence of that size, from its nodes up to one, or by most levels."""
    levels = [np.frombuffer(digests, np.uint8).reshape(-1, HEX)]
    for _ in range(min(most, levels_of(size))):
        levels.append(hashed(levels[-1]))
    return levels


def siblings(levels: list[np.ndarray], at: int) -> bytes:
    """The other digests of the node's runs inside its block, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % FANOUT
        out += [nodes[run:at].tobytes(), nodes[at + 1 : run + FANOUT].tobytes()]
        at //= FANOUT
    return b"".join(out)


def fold(digest: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a digest and its siblings give. places: (position, size) in each sequence on the way."""
    used = 0
    for at, size in places:
        while size > 1:
            run = at - at % FANOUT
            left, others = HEX * (at - run), HEX * (min(FANOUT, size - run) - 1)
            mine = proof[used : used + others]
            digest = hashlib.sha256(mine[:left] + digest + mine[left:]).hexdigest().encode()
            used, at, size = used + others, at // FANOUT, -(-size // FANOUT)
    return digest


def in_order(df: DataFrame, by: list) -> DataFrame:
    """df (with a column key) with each row's position in its key's order and the key's size."""
    rows = cut(cut(df).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33).alias("part")
    first = rows.groupBy("key", part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    runs, every = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    first = cut(first.select("key", "part", "first", F.coalesce(F.sum("n").over(runs), F.lit(0)).alias("start"), F.sum("n").over(every).alias("size")))
    return rows.withColumn("part", part).join(first, ["key", "part"]).withColumn("pos", F.col("start") + F.col("place") - F.col("first")).drop("place", "part", "first", "start")


def blocks_of(nodes: DataFrame, most: int) -> DataFrame:
    """nodes: key, size, pos, digest, and perhaps label and claimed. A row per block: key, size, block, digests, and the labels and claimed digests by node."""
    more = [c for c in ("label", "claimed") if c in nodes.columns]
    kinds = {"label": f"array<{nodes.schema['label'].dataType.simpleString()}>" if "label" in more else "", "claimed": "array<string>"}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        data, _ = bytesk.column(table.column("digest"))
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(c).combine_chunks() if len(table.column(c).chunks) != 1 else table.column(c).chunk(0))
        return pa.table({"key": table.column("key")[:1], "size": table.column("size")[:1], "block": table.column("block")[:1], "digests": pa.array([data.tobytes()], pa.binary()), **{f"{c}s": whole(c) for c in more}})

    dealt = nodes.withColumn("block", F.expr(f"pos div {FANOUT**most}")).select("key", "size", "block", "pos", "digest", *more)
    return cut(dealt.groupBy("key", "block").applyInArrow(run, "key string, size long, block long, digests binary" + "".join(f", {c}s {kinds[c]}" for c in more)))


def raised(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and (key, digest, size) of each sequence's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            tops = [lift(d.as_py(), n, most)[-1].tobytes() for n, d in zip(sizes, batch.column(3), strict=True)]
            left = [-(-n // FANOUT**most) for n in sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.int64()), batch.column(2), pa.array(tops, pa.binary()).cast(pa.string())], names=["key", "size", "pos", "digest"])

    rounds, roots = [], None
    while roots is None or not nodes.isEmpty():
        rounds.append(blocks_of(nodes, most))
        tops = cut(rounds[-1].select("key", "size", "block", "digests").mapInArrow(run, "key string, size long, pos long, digest string"))
        done = tops.where("size = 1").select("key", "digest")
        roots = done if roots is None else roots.unionByName(done)
        nodes = tops.where("size > 1")
    return rounds, roots


def with_above(rounds: list[DataFrame], paths: DataFrame, most: int) -> DataFrame:
    """The blocks of the first round with the siblings above them. paths: key, above (the siblings above a sequence's root) and top (a text all its nodes get)."""

    whole = FANOUT**most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, size, block, digests, above, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = lift(digests, size, most)
                for nodes in some(len(levels[0])):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(nodes)), pa.array([block * whole + k for k in nodes]), pa.array([siblings(levels, k) + above for k in nodes], pa.binary()), pa.array([top] * len(nodes), pa.string())], names=["key", "block", "above", "top"])

    below = None
    for k in reversed(range(len(rounds))):
        mine = rounds[k].where(F.col("size") <= whole).join(paths, "key")
        if below is not None:
            mine = mine.unionByName(rounds[k].where(F.col("size") > whole).join(below, ["key", "block"]))
        if k:
            below = cut(mine.select("key", "size", "block", "digests", "above", "top").mapInArrow(run, "key string, block long, above binary, top string"))
    return mine


def some(n: int) -> list[range]:
    """The nodes of a block, a few hundred at a time: a proof may have some thousand bytes."""
    return [range(at, min(at + 512, n)) for at in range(0, n, 512)]


def text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def manifest(docs: DataFrame, fields=FIELDS, doc_id: str = "doc_id", group: str = "lang", tampered: Column | None = None, changes: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """A row per row of docs: doc_id, leaf, subroot, root, proof, place (position and size in its group, and the group's), folded_root, verified.

    A leaf is the SHA-256 (hex) of the fields, each null as a dash and otherwise with its bytes counted before it. Eight
    nodes in a row make their parent, the last of a sequence perhaps fewer. Where tampered holds, the leaf claimed is that of the fields
    after changes, and folded_root is what it gives with the true proof; elsewhere the true leaf is folded.

    Within a group null ids come first, rows equal in id follow by their leaf, and rows equal in all are leaves of their own. Null is a group too, the first. A single leaf is its group's subroot; a single
    subroot is the root. Texts may be of any length. An empty table gives no rows. Columns that aren't fields aren't read.
    """
    small_batches(docs.sparkSession)
    fixed = tampered if tampered is not None else F.lit(False)
    swapped = [(changes or {}).get(f, named(f)) for f in fields]
    leaf, other = (F.sha2(F.concat(*map(sized, x)), 256) for x in (map(named, fields), swapped))
    base = docs.select(sized(named(group)).alias("key"), named(group).cast("string").alias("group"), named(doc_id).alias("label"), leaf.alias("digest"), F.when(fixed, other).alias("claimed"))
    placed = in_order(base.withColumn("no", F.monotonically_increasing_id()), ["key", "label", "digest", "no"])
    rounds, roots = raised(placed.select("key", "size", "pos", "digest", "label", "claimed"), levels)
    groups = cut(placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).join(roots, "key"))
    tops = in_order(groups.select(F.lit("").alias("key"), "group", F.col("key").alias("label"), "digest"), [F.col("group").asc_nulls_first()])
    above, root = raised(tops.select("key", "size", "pos", "digest", "label"), levels)
    held = with_above(above, root.select("key", F.lit(b"").alias("above"), F.lit("").alias("top")), levels)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, block, digests, labels, up in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes_ = lift(digests, size, levels)
                for nodes in some(len(labels)):
                    tops = [f"{nodes_[0][k].tobytes().decode()} {block * FANOUT**levels + k} {size}" for k in nodes]
                    yield pa.RecordBatch.from_arrays([pa.array([labels[k] for k in nodes]), pa.array([siblings(nodes_, k) + up for k in nodes], pa.binary()), pa.array(tops)], names=["key", "above", "top"])

    tree = cut(held.select("size", "block", "digests", "labels", "above").mapInArrow(paths, "key string, above binary, top string"))
    found, kind = root.first(), docs.schema[doc_id].dataType.simpleString()

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = found["digest"].encode()
        for batch in batches:
            for b in range(len(batch)):
                size, block, digests, claims, up, top = (batch.column(c)[b].as_py() for c in ("size", "block", "digests", "claimeds", "above", "top"))
                labels, tree_, (subroot, at, groups) = batch.column("labels")[b].values, lift(digests, size, levels), top.split(" ")
                for nodes in some(len(claims)):
                    own = [tree_[0][k].tobytes() for k in nodes]
                    proofs = [siblings(tree_, k) + up for k in nodes]
                    places = [[block * FANOUT**levels + k, size, int(at), int(groups)] for k in nodes]
                    folded = [fold(claims[k].encode() if claims[k] else d, p, [(x[0], x[1]), (x[2], x[3])]) for k, d, p, x in zip(nodes, own, proofs, places, strict=True)]
                    yield pa.RecordBatch.from_arrays([labels.slice(nodes[0], len(nodes)), text(own), pa.array([subroot] * len(nodes)), text([end] * len(nodes)), text(proofs), pa.array(places, pa.list_(pa.int64())), text(folded), pa.array([f == end for f in folded])], names=["doc_id", "leaf", "subroot", "root", "proof", "place", "folded_root", "verified"])

    blocks = with_above(rounds, tree, levels).select("size", "block", "digests", "labels", "claimeds", "above", "top")
    return blocks.mapInArrow(leaves, f"doc_id {kind}, leaf string, subroot string, root string, proof string, place array<long>, folded_root string, verified boolean")
