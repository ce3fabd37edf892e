"""Exact n-gram Jaccard join of whole texts with a count-vector R-tree.

A document is its set of word shingles, each a 64-bit hash. Shingles are hashed into groups; the
numbers per group make a point, and two sets share at most the summed minima of their coordinates.
Points are packed into an R-tree, node pairs whose bound is below what the threshold needs are
pruned, and the pairs that survive are verified on the sets themselves.

Sets meet before that by the groups' contents. Linked sets of at most S shingles differ in at most
D = floor(2 S (100 - p) / (100 + p)) of them, so of more than D groups one at least is the same in
both. Each document sends a hash of every non-empty group, with one grouping per band of sizes; a
document that leaves so many groups empty that only empty ones might agree sends those as well.
Documents that share a hash are joined in a star, the stars' components are blocks, and no linked
pair lies outside a block. Copies send equal rows and are one node.

Passages that many short documents share make blocks larger than their near copies. A block of some
size is therefore met again by prefixes: shingles are counted over all such blocks, and a document's
rarest ones, as many as a linked document can't lack altogether, make the new edges.

A class of equal sets has a number, which stands for it to the end, and one of its rows, known by id and a hash of its text,
lends the text. Texts are fetched for members of blocks only; a bit array of fixed size over those rows keeps most
others from being shuffled for that.

A block is cut into chunks of bounded bytes, each with the block's smallest document as a hub. Near
copies of the hub are settled there, in time linear in the block. Only what no chunk could link to
the hub is compared with the block's other chunks; no pairs are written out, just the members' roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesk
from .components import components
from .cut import cut, drop, named, small_batches

CHUNK_BYTES = 4 << 20
LARGE_BYTES = 1 << 17
FILTER_WORDS = 1 << 20  # 64 bits each
FANOUT = 8
HOT, SALTS = 1 << 12, 64
ONE = np.uint64(1)


def shingle_sets(values: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text; texts with fewer words are one shingle, without words none."""
    data, off = bytesk.column(values)
    for i, j in bytesk.slices(off):
        part, o = bytesk.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = bytesk.words(part, o)
        hashes = bytesk.span_hashes(part, starts, ends)
        runs = bytesk.rolling(hashes, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = np.sort(runs[a : b - words + 1] if b - a >= words else bytesk.rolling(hashes[a:b], b - a) if b > a else runs[:0])
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    n = np.uint64(len(s))
    both = bytesk.mix(np.array([s.sum(dtype=np.uint64) + n, bytesk.mix(s).sum(dtype=np.uint64) ^ n], np.uint64))
    return tuple(both.view(np.int64).tolist())


def spread(percent: int) -> tuple[float, float]:
    """Ratio of a band's largest to its smallest size, and shingles per group for the smallest: as many as leave more than D groups of two and more."""
    share = 2 * (100 - percent) / (100 + percent)
    ratio = 1.3 if share < 0.2 else 1.15
    for per_group in np.arange(6, 1.5, -0.1):
        if (1 - np.exp(-per_group) * (1 + per_group)) / per_group >= 1.06 * share * ratio:
            break
    return ratio, float(per_group)


def bands(percent: int, up_to: int) -> list[tuple[int, int, int]]:
    """(largest size, D, groups) of each band of set sizes, to the band that holds up_to."""
    ratio, per_group = spread(percent)
    out, below, top = [], 0, (100 + percent - 1) // (2 * (100 - percent))
    while True:
        d = 2 * top * (100 - percent) // (100 + percent)
        out.append((top, d, max(d + 1, round((below + 1) / per_group))))
        if top >= up_to:
            return out
        below, top = top, max(top + 1, int(top * ratio))


def group_hashes(s: np.ndarray, percent: int, known: list[tuple[int, int, int]]) -> np.ndarray:
    """What a set sends to meet every set that it might be linked with.

    Groups of one shingle are mostly shared by accident, so a set with more than D larger groups sends
    only those: a linked set has one of them unchanged, and sends it too. Other sets send all groups, and
    if those are no more than D, the empty ones as well; of two such sets the unchanged group may be any.
    """
    out, n, mixed, high = [], len(s), bytesk.mix(s ^ bytesk.BASES[1]), s >> np.uint64(32)
    for band, (top, d, groups) in enumerate(known):
        if n > top:
            continue
        if band and percent * (known[band - 1][0] + 1) > 100 * n and n <= known[band - 1][0]:
            break
        g = (high * np.uint64(groups)) >> np.uint64(32)
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        salt = bytesk.mix((g[at] + ONE) * bytesk.BASES[0] + np.uint64(band))
        sent = bytesk.mix(np.add.reduceat(mixed, at) + salt)
        larger = np.diff(np.append(at, n)) > 1
        if larger.sum() > d:
            out.append(sent[larger])
            continue
        out.append(sent)
        if len(at) <= d:
            empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), g[at])
            out.append(bytesk.mix(bytesk.mix((empty + ONE) * bytesk.BASES[1] + np.uint64(band)) + ONE))
    return np.concatenate(out)


def stars(keys: np.ndarray, values: np.ndarray, hub_key=None, hub=None):
    """For ascending (key, value) rows, the first value of each key paired with its other values; the hub of the last key goes on to the next call."""
    new = np.append(keys[0] != hub_key, keys[1:] != keys[:-1])
    at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
    hubs = np.where(at >= 0, values[at], 0 if hub is None else hub)
    pairs = np.unique(np.stack([hubs, values])[:, hubs != values], axis=1) if (hubs != values).any() else np.zeros((2, 0), np.int64)
    return pairs, keys[-1], hubs[-1]


def meeting_edges(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Edges between the first identity words of sets that share a group."""
    schema = "met boolean, a long, b long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bands(percent, 1024)
        for batch in batches:
            hashes, keys = [], []
            for s in shingle_sets(batch.column(0), words):
                if len(s):
                    if len(s) > known[-1][0] * percent // 100:
                        known = bands(percent, 2 * len(s))
                    hashes.append(group_hashes(s, percent, known))
                    keys.append(np.full(len(hashes[-1]), identity(s)[0]))
            if hashes:  # what meets within a batch is joined here, and one of them goes on
                h, k = np.concatenate(hashes).view(np.int64), np.concatenate(keys)
                order = np.lexsort((k, h))
                h, k = h[order], k[order]
                pairs, _, _ = stars(h, k)
                first = np.append(True, h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pairs.shape[1] + first.sum()) < pairs.shape[1]), pa.array(np.append(pairs[0], h[first])), pa.array(np.append(pairs[1], k[first]))], names=["met", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hub = None
        for batch in batches:
            met, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            found = [np.stack([a[met], b[met]])]
            if not met.all():
                pairs, key, hub = stars(a[~met], b[~met], key, hub)
                found.append(pairs)
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sent = docs.select(named(text).alias("text")).mapInArrow(send, schema)
    return sent.repartition("a").sortWithinPartitions("met", "a", "b").mapInArrow(meet, "a long, b long").distinct()


class CountTree:
    """An R-tree over group counts, packed once; children of a node are consecutive."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        slab = np.argsort(np.argsort(sizes, kind="stable")) // max(1, int(np.sqrt(len(sizes) * FANOUT)))
        self.order = np.lexsort((counts[:, int(np.argmax(counts.var(axis=0)))], slab))
        level = (counts[self.order], sizes[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[0]) > FANOUT:
            at = np.arange(0, len(level[0]), FANOUT)
            level = (np.maximum.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at))
            self.levels.append(level)

    def candidates(self, percent: int, settled: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of points, 2 x n, whose bounds allow a link, except where both are settled."""
        done = [settled[self.order]]
        for top, _, _ in self.levels[1:]:
            done.append(np.logical_and.reduceat(done[-1], np.arange(0, len(done[-1]), FANOUT)))
        at = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[at][0]))
        work = [(at, a, b)]
        while work:
            at, a, b = work.pop()
            if len(a) > 4096:
                work += [(at, a[4096:], b[4096:])]
                a, b = a[:4096], b[:4096]
            most, low, high = self.levels[at]
            ok = ~(done[at][a] & done[at][b]) & (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            a, b = a[ok], b[ok]
            shared = np.minimum(most[a], most[b]).sum(axis=1)
            ok = (100 + percent) * shared >= percent * (low[a] + low[b])
            a, b = a[ok], b[ok]
            if not at:
                yield np.stack([self.order[a], self.order[b]])[:, a != b]
            elif len(a):
                i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
                x, y = (a[:, None] * FANOUT + i).ravel(), (b[:, None] * FANOUT + j).ravel()
                ok = (x <= y) & (y < len(self.levels[at - 1][0])) & (x < len(self.levels[at - 1][0]))
                work.append((at - 1, x[ok], y[ok]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def local_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first set of its component; the first set is the hub."""
    n = len(sets)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    groups = 1 << min(10, max(4, int(sizes.max() // 8).bit_length()))
    counts = np.array([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets], np.int32)
    shared = np.minimum(counts, counts[0]).sum(axis=1)
    for i in np.flatnonzero((100 + percent) * shared >= percent * (sizes + sizes[0]))[1:].tolist():
        if linked(sets[0], sets[i], percent):
            parent[i] = 0
    settled = np.array(parent) == 0
    if not settled.all():
        for pairs in CountTree(counts, sizes).candidates(percent, settled):
            for i, j in pairs.T.tolist():
                a, b = find(i), find(j)
                if a != b and linked(sets[i], sets[j], percent):
                    parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def chunk_roots(tasks: DataFrame, words: int, percent: int) -> DataFrame:
    """tasks: block, chunk, part, node, h1, text. (block, node, root) within each group of the first three, root being the smallest member linked."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, expected, sets = [], table.column("h1").to_pylist(), []
        for node, h, s in zip(table.column("node").to_pylist(), expected, shingle_sets(table.column("text"), words), strict=True):
            if nodes[-1:] != [node] and len(s) and identity(s)[0] == h:  # a hub is in its own chunk twice
                nodes.append(node)
                sets.append(s)
        ids = np.array(nodes, np.int64)
        return pa.table({"block": np.full(len(ids), table.column("block")[0].as_py()), "node": ids, "root": ids[local_roots(sets, percent)] if len(ids) else ids})

    return tasks.groupBy("block", "chunk", "part").applyInArrow(run, "block long, node long, root long")


def row_key(doc_id: str, text: str) -> list:
    """What tells rows apart but for rows equal in id and text: a hash of the text, the id, and whether it is missing."""
    own = named(doc_id).cast("long")
    return [F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("t"), F.coalesce(own, F.lit(0)).alias("i"), own.isNull().alias("lost")]


KEY = ["t", "i", "lost"]
FULL = [*KEY, "single"]


def features(docs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """(t, i, lost, n, h1, h2) of each row: its key, and the size and identity of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *identity(s)) for s in shingle_sets(batch.column(3), words)]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], names=[*KEY, "n", "h1", "h2"])

    return docs.select(*row_key(doc_id, text), named(text).alias("text")).mapInArrow(run, "t long, i long, lost boolean, n long, h1 long, h2 long")


def texts_of(docs: DataFrame, text: str, doc_id: str, reps: DataFrame) -> DataFrame:
    """The rows that lend texts, and few others: their key (FULL) and text. Rows equal in id and text become one before they move. reps: a row's key, and whether it is the only row with it."""
    rows = docs.select(*row_key(doc_id, text), named(text).alias("text"))
    one = with_keys(rows, reps.where("single")).select(*KEY, F.lit(True).alias("single"), "text")
    several = reps.where("not single")
    if several.isEmpty():
        return one
    return one.unionByName(with_keys(rows, several).groupBy(*KEY).agg(F.first("text").alias("text")).withColumn("single", F.lit(False)))


def with_value(rows: DataFrame, values: DataFrame, value: str, times: str, scratch: list[DataFrame]) -> DataFrame:
    """rows (node, shingle) with the value of their shingle; values: a row per shingle, times being its number of rows.

    A shingle with more than 1/HOT of all rows is joined in SALTS parts; there are fewer than HOT of them, so they are broadcast to mark their rows.
    """
    values = cut(values.select("shingle", *dict.fromkeys((value, times))))
    scratch.append(values)
    hot = values.where(F.col(times) > rows.count() // HOT).select("shingle", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), "shingle", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread_ = values.join(F.broadcast(hot), "shingle", "left").select("shingle", value, F.explode(every).alias("salt"))
    return marked.join(spread_, ["shingle", "salt"]).select("node", "shingle", value)


def prefix_edges(members: DataFrame, texts: DataFrame, words: int, percent: int, scratch: list[DataFrame]) -> DataFrame:
    """members: block, node, h1, n and the key of a row of texts. Edges (a, b) between members that share a shingle of both their prefixes, in the order of frequency among all members. scratch gets the tables behind them."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, held = [], [], 0
            for i, (s, h) in enumerate(zip(shingle_sets(batch.column(3), words), batch.column(2).to_pylist(), strict=True)):
                if len(s) and identity(s)[0] == h:
                    rows.append(np.full(len(s), batch.column(1)[i].as_py()))
                    hashes.append(s.view(np.int64))
                    held += len(s)
                if rows and (held > 1 << 18 or i == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(hashes))], names=["node", "shingle"])
                    rows, hashes, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(hashes))], names=["node", "shingle"])

    rows = members.join(texts, FULL).select("block", "node", "h1", "text").mapInArrow(spell, "node long, shingle long")
    rows = cut(rows)
    scratch.append(rows)
    shared = with_value(rows, rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "times", "times", scratch)
    # a set: a row that is there twice counts twice above, which leaves the order the same for all, but is one member
    known = shared.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("times", "shingle"))).alias("common")).join(members.select("node", "n"), "node")
    # shingles of this document alone come first in its prefix
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("common"))
    prefix = cut(known.where(length > 0).select("node", F.explode(F.slice("common", F.lit(1), length.cast("int"))["shingle"]).alias("shingle")))
    hubs = prefix.groupBy("shingle").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("times"))
    scratch.append(prefix)
    return with_value(prefix, hubs, "hub", "times", scratch).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def with_keys(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key isn't in wanted; a join is still to follow."""
    bits = FILTER_WORDS.bit_length() - 1
    h = F.xxhash64(*KEY)
    word, bit = h.bitwiseAND(F.lit(FILTER_WORDS - 1)), F.shiftrightunsigned(h, bits).bitwiseAND(F.lit(63))
    mask = F.expr("shiftleft(1L, cast(bit as int))")
    held = cut(wanted.select(word.alias("word"), bit.alias("bit")).select("word", mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")))
    return rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(held), "word").where(F.col("mask").bitwiseAND(mask) != 0).drop("word", "bit", "mask")


def classes_of(docs: DataFrame, words: int, percent: int, text: str, doc_id: str, chunk_bytes: int, large_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The features of each row, and for each class of equal sets (h1, h2, n) the first row key of its component: lost, i, t."""
    small_batches(docs.sparkSession)
    known = cut(features(docs, text, doc_id, words))
    blocks = components(meeting_edges(docs, text, words, percent))
    first = F.min(F.struct("lost", "i", "t", "rows")).alias("first")  # ids before missing ones
    equal = known.where("n > 0").groupBy(*SAME, *KEY).agg(F.count(F.lit(1)).alias("rows"))
    classes = cut(equal.groupBy(*SAME).agg(first).withColumn("node", F.monotonically_increasing_id()))
    lends = [*(F.col(f"first.{k}").alias(k) for k in KEY), (F.col("first.rows") == 1).alias("single")]
    reps = cut(classes.join(blocks.withColumnsRenamed({"node": "h1", "root": "block"}), "h1").select("block", "node", "h1", "n", *lends))
    texts = texts_of(docs, text, doc_id, reps)
    chunks = F.ceil(F.sum("n") * 8 / chunk_bytes).alias("chunks")
    large = reps.groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") * 8 > large_bytes).select("block")
    if not large.isEmpty():
        members = reps.join(large, "block", "left_semi")
        scratch: list[DataFrame] = []
        again = components(prefix_edges(members, texts, words, percent, scratch)).withColumnsRenamed({"root": "again"})
        for table in scratch:  # components has its own tables
            drop(table)
        inside = members.join(again, "node").select(F.col("again").alias("block"), "node", "h1", "n", *FULL)
        reps = cut(reps.join(large, "block", "left_anti").select("block", "node", "h1", "n", *FULL).union(inside))
    of = cut(reps.groupBy("block").agg(F.min(F.struct("node", "h1", "n", *FULL)).alias("hub"), chunks))
    dealt = reps.join(of.select("block", "chunks"), "block").select("block", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.lit(0).alias("part"), "node", "h1", *FULL)
    hubs = of.where("chunks > 1").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("part"), "hub.node", "hub.h1", *(f"hub.{k}" for k in FULL))
    roots = cut(chunk_roots(dealt.union(hubs).join(texts, FULL), words, percent))
    left = roots.join(of.where("chunks > 1"), "block").where(F.col("root") != F.col("hub.node")).select("block", "node")
    if not left.isEmpty():  # what its own chunk could not link to the hub meets the block's other chunks
        rest = reps.join(left, ["block", "node"], "left_semi")
        parts = rest.groupBy("block").agg(F.ceil(F.sum("n") * 8 / chunk_bytes).alias("parts"))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        sizes = of.join(parts, "block").select("block", "chunks", "parts")
        whole = dealt.drop("part").join(sizes, "block").select("block", "chunk", every("parts").alias("part"), "node", "h1", *FULL)
        odd = rest.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).select("block", every("chunks").alias("chunk"), "part", "node", "h1", *FULL)
        more = chunk_roots(whole.union(odd).join(texts, FULL), words, percent)
        edges = roots.union(more).select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = components(edges)
    else:
        found = roots.select("node", "root").distinct()
    rooted = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("start"))
    # a table of its own: a join with it has plain exchanges on both sides, and the planner can split the rows of a text with many copies
    return known, cut(rooted.select(*SAME, "root").join(firsts, "root").select(*SAME, *(f"start.{k}" for k in KEY)))


SAME = ["h1", "h2", "n"]


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Words are runs without ASCII white space, A-Z lower-cased. Null, empty and blank texts have no
    shingle and are linked with nothing; their component is their own id. Every other row takes part, whatever its
    id: rows without an id link others and have the component of those, null if nothing reachable has an id; where an
    id repeats with different texts, links are those of each text, and each row has its own component. An empty table gives no rows.
    """
    known, named_ = classes_of(docs, words, percent, text, doc_id, chunk_bytes, large_bytes)
    own, start = (F.when(~F.col(f"{p}lost"), F.col(f"{p}i")) for p in ("", "start_"))
    named_ = named_.select(*SAME, F.col("i").alias("start_i"), F.col("lost").alias("start_lost"))
    return known.join(named_, SAME, "left").select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, start).otherwise(own).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """One row of each group of linked rows of docs, and all rows without a shingle: the columns of docs.

    The row with the smallest id stays, one without an id only if none has one, and of several with that id the one with the smallest hash of its text;
    of rows equal in id and text any one. Rows that share an id are judged by their own texts. Null, empty and blank texts
    are linked with nothing and stay. An empty table gives no rows.
    """
    known, named_ = classes_of(docs, words, percent, text, doc_id, chunk_bytes, large_bytes)
    start = named_.select(*SAME, *(F.col(k).alias(f"start_{k}") for k in KEY))
    every = known.where("n > 0").groupBy(*KEY, *SAME).agg(F.count(F.lit(1)).alias("rows")).join(start, SAME)
    stays = (F.col("t") == F.col("start_t")) & (F.col("i") == F.col("start_i")) & (F.col("lost") == F.col("start_lost"))
    judged = cut(every.where(~stays | (F.col("rows") > 1)).select(*KEY, stays.alias("stays")))
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), *row_key(doc_id, text))
    kept = rows.join(judged, KEY, "left_anti").select("row.*")
    again = judged.where("stays")
    if again.isEmpty():
        return kept
    once = with_keys(rows, again).join(again, KEY, "left_semi").groupBy(*KEY).agg(F.first("row").alias("row"))
    return kept.unionByName(once.select("row.*"))
