"""Line deduplication against a sharded minimal perfect hash of the frequent lines.

Lines become 128-bit hashes of their keys. Documents per hash are counted (each batch sends a hash
once), and the hashes found often enough are dealt into shards. A shard is a minimal perfect hash: a
few levels of bit arrays in which each hash owns one bit, whose rank is its slot, and beside it
arrays by slot with a fingerprint, the number of documents and the largest id. Documents probe these
arrays where they lie; neither lines nor texts move.

Shards are broadcast in packs of at most ``PACK_BYTES``. One pack holds over a million frequent
lines; where there are more, documents pass the packs one after the other, with their findings kept
in reliable storage between, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesk
from .cut import cut, small_batches

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_LINES = 1 << 16
PACK_BYTES = 32 << 20
NO_ID = np.iinfo(np.int64).min
_loaded: dict[int, list] = {}


def split_lines(data: np.ndarray, off: np.ndarray, min_chars: int):
    """Lines of a slice of rows: starts, ends, first line of each row, and of the lines whose key is long enough their numbers and two hashes."""
    breaks = np.flatnonzero(data == 10)
    per_row = np.diff(np.searchsorted(breaks, off)) + 1
    first = np.append(0, np.cumsum(per_row))
    starts = np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[first[:-1]], starts[inner] = off[:-1], breaks + 1
    ends = np.empty(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    ends[last], ends[~last] = off[1:], breaks
    solid = np.flatnonzero(~bytesk.SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(b > a)
    ks, ke = solid[a[some]], solid[b[some] - 1] + 1
    chars = bytesk.code_points(data)
    long = chars[ke] - chars[ks] >= min_chars
    some, ks, ke, low = some[long], ks[long], ke[long], bytesk.LOWER[data]
    return starts, ends, first, some, *[bytesk.span_hashes(low, ks, ke, base) for base in bytesk.BASES]


def index_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return bytesk.mix(h1 + bytesk.mix(h2))


def salt(level: int) -> np.uint64:
    return np.uint64((level + 1) * int(bytesk.BASES[0]) % (1 << 64))


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of a minimal perfect hash of distinct keys, as arrays of 64-bit words, and the slot of each key.

    In a level of two bits per key left, keys alone at their bit own it; the others go on to the next level.
    """
    levels, slots, left, made = [], np.empty(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        words = -(-2 * len(left) // 64)
        at = (bytesk.mix(keys[left] + salt(len(levels))) % np.uint64(64 * words)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * words) == 1
        bits = np.packbits(alone, bitorder="little").view(np.uint64)
        own = alone[at]
        slots[left[own]] = made + (np.cumsum(alone) - 1)[at[own]]
        made += int(own.sum())
        left = left[~own]
        levels.append(bits)
    return levels, slots


def find(levels: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 or anyone's slot for keys that are not in. levels: bit words, and ranks before each of them."""
    slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for k, (bits, ranks) in enumerate(levels):
        at = bytesk.mix(keys[left] + salt(k)) % np.uint64(64 * len(bits))
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        own = (bits[word] >> bit) & np.uint64(1) == 1
        below = bits[word[own]] & ((np.uint64(1) << bit[own]) - np.uint64(1))
        slots[left[own]] = ranks[word[own]] + np.bitwise_count(below).astype(np.int64)
        left = left[~own]
    return slots


def load(shards: list) -> list[tuple]:
    """Shards as find() wants them."""
    out = []
    for row in shards:
        sizes, bits = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint64)
        ranks = np.append(0, np.cumsum(np.bitwise_count(bits).astype(np.int64)))[:-1]
        cuts = np.cumsum(sizes)[:-1]
        out.append((int(row["shard"]), list(zip(np.split(bits, cuts), np.split(ranks, cuts), strict=True)), np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["largest"], np.int64)))
    return out


def frequent_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, n, largest) of the keys found in at least min_docs rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            data, off = bytesk.column(batch.column(1))
            for i, j in bytesk.slices(off):
                _, _, first, some, h1, h2 = split_lines(data[off[i] : off[j]], off[i : j + 1] - off[i], min_chars)
                if not len(some):
                    continue
                row = np.searchsorted(first, some, "right") - 1
                order = np.lexsort((row, h2, h1))
                h1, h2, row = h1[order], h2[order], row[order]
                new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
                fresh = new | np.append(True, row[1:] != row[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(np.add.reduceat(fresh.astype(np.int64), at)), pa.array(np.maximum.reduceat(ids[i + row], at))], names=["h1", "h2", "n", "largest"])

    found = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(count, "h1 long, h2 long, n long, largest long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).where(F.col("n") >= min_docs)


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """A row per shard: its bit arrays, and by slot the fingerprints, counts and largest ids."""

    def run(table: pa.Table) -> pa.Table:
        h1, h2, n, largest = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "largest"))
        keys, at = np.unique(index_key(h1.view(np.uint64), h2.view(np.uint64)), return_index=True)
        levels, slots = build(keys)
        by_slot = at[np.argsort(slots)]
        cells = [np.array([len(x) for x in levels], np.int64), np.concatenate(levels), h2[by_slot], n[by_slot], largest[by_slot]]
        return pa.table({"shard": table.column("shard")[:1], **{k: pa.array([c.tobytes()], pa.binary()) for k, c in zip(("sizes", "bits", "prints", "counts", "largest"), cells, strict=True)}})

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "shard long, sizes binary, bits binary, prints binary, counts binary, largest binary")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, pack_bytes: int = PACK_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """A row per row of docs: doc_id, n_lines, n_dropped, kept (the text without the dropped lines).

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of min_chars
    characters or more in min_docs rows or more keep their lines in the largest id only, all of
    them there. A null or empty text is one empty line. Each row counts as a document; rows with
    the largest id keep the line alike, and null ids are smaller than all others. An empty table
    gives no rows. No other column of docs is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lines = cut(frequent_lines(docs, text, doc_id, min_chars, min_docs))
    shards = max(1, -(-lines.count() // shard_lines))
    index = cut(build_index(lines, shards))
    size = F.length("bits") + F.length("prints") + F.length("largest")
    sizes = {r[0]: r[1] for r in index.select("shard", size).collect()}
    packs: list[list[int]] = [[]]
    for k in sorted(sizes):
        if packs[-1] and sum(sizes[x] for x in packs[-1]) + sizes[k] > pack_bytes:
            packs.append([])
        packs[-1].append(k)

    def probe(df: DataFrame, pack: list[int], last: bool) -> DataFrame:
        held = spark.sparkContext.broadcast([r.asDict() for r in index.where(F.col("shard").isin(pack)).select("shard", "sizes", "bits", "prints", "largest").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = load(held.value)
            for batch in batches:
                ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                data, off = bytesk.column(batch.column(1))
                for i, j in bytesk.slices(off):
                    part, ids_ = data[off[i] : off[j]], ids[i:j]
                    starts, ends, first, some, h1, h2 = split_lines(part, off[i : j + 1] - off[i], min_chars)
                    drop = np.zeros(len(starts), bool)
                    before = batch.column(2).slice(i, j - i)
                    drop[before.flatten().to_numpy() + np.repeat(first[:-1], before.value_lengths().to_numpy())] = True
                    row, keys, to = np.searchsorted(first, some, "right") - 1, index_key(h1, h2), h1.view(np.int64) % shards
                    for shard, levels, prints, largest in loaded:
                        at = np.flatnonzero(to == shard)
                        slot = find(levels, keys[at])
                        hit = (slot >= 0) & (prints[slot] == h2[at]) & (ids_[row[at]] < largest[slot])
                        drop[some[at[hit]]] = True
                    if last:
                        yield finish(batch.column(0).slice(i, j - i), part, starts, ends, first, drop)
                    else:
                        at = np.flatnonzero(drop)
                        of = np.searchsorted(first, at, "right") - 1
                        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(j - i + 1)), pa.int32()), pa.array(at - first[of], pa.int64()))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), found], names=["doc_id", "text", "found"])

        return df.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string" if last else "doc_id long, text string, found array<long>")

    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<long>").alias("found"))
    for k, pack in enumerate(packs):
        df = probe(df, pack, k == len(packs) - 1)
        if k < len(packs) - 1:
            df = cut(df)
    return df


def finish(ids: pa.Array, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, drop: np.ndarray) -> pa.RecordBatch:
    raw, kept = part.tobytes(), []
    dropped = np.add.reduceat(drop.astype(np.int64), first[:-1])
    for k, n in enumerate(dropped.tolist()):
        a, b = first[k], first[k + 1]
        if n:
            stay = np.flatnonzero(~drop[a:b]) + a
            kept.append(b"\n".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
        else:
            kept.append(raw[starts[a] : ends[b - 1]])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first), pa.int64()), pa.array(dropped), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])
