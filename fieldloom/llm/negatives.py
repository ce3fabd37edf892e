"""Hard-negative mining by distributed radix selection.

Each anchor asks for its best rows of the same label, and each of its positives for the best rows of other labels
inside a window of scores. Such a request is a range of keys, the score first, then the id, then the row's number, and
of all rows in the range the k smallest are wanted. Tasks count their rows per request and bucket of the range; the
summed counts tell which bucket holds the kth row, and the range shrinks to that bucket, digit by digit. Requests
whose bucket holds few rows are done. Rows up to the bucket's end are gathered at last: k and a few more per request, whatever
the number of rows that tie.

Vectors become whole numbers, stored once as binary rows. Anchors go to tasks in packs of bounded size and meet all
rows there, block by block, as matrix products; what tasks send are counts and the rows gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut, drop, named, small_batches

SCALE = 256
MOST = 1 << 24
ANCHORS = 8192
PACK_BYTES = 16 << 20
#: Rows that a request may gather beyond the k it asks for.
SLACK = 32
#: Counters that a task holds, and the products it holds at once.
COUNTERS = 1 << 23
PRODUCTS = 1 << 19
NO_ID = np.iinfo(np.int64).max


def prepared(vectors: DataFrame, vector: str, vec_id: str, label: str, anchors: Column, scale: int) -> DataFrame:
    """(id, label, anchor, norm, v, no) of the rows that take part; v: components as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            off = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            good = (bad[off[1:]] == bad[off[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(values * scale), -MOST, MOST)
            squares = np.append(0, np.cumsum(np.where(np.isfinite(whole), whole, 0) ** 2))
            norm = np.sqrt(squares[off[1:]] - squares[off[:-1]])
            data = whole[np.repeat(good, np.diff(off))].astype(np.int32)
            ends = np.append(0, np.cumsum(4 * np.diff(off)[good])).astype(np.int32)
            keep = pa.array(good)
            rows = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in range(3)), pa.array(norm[good]), rows], names=["id", "label", "anchor", "norm", "v"])

    known = vectors.where(named(label).isNotNull() & named(vector).isNotNull())
    rows = known.select(named(vec_id).cast("long").alias("id"), named(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), named(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, label long, anchor boolean, norm double, v binary").withColumn("no", F.monotonically_increasing_id())


def matrix(column: pa.Array) -> np.ndarray:
    """Binary rows as a matrix of whole numbers; shorter rows end in zeros."""
    rows = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int32)
    for to, x in zip(out, rows, strict=True):
        to[: len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; vectors of unequal length are compared as far as both go."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * d
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Requests:
    """What a pack's anchors ask for; one entry per request in each array. Keys are (-score, id, number of the row)."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        n = len(anchor)
        self.anchor, self.floor = anchor, -high
        self.lo, self.hi = -high, -low
        self.need = np.full(n, k)
        self.stage = np.zeros(n, np.int8)
        #: rows up to this key are gathered
        self.end = np.full((n, 3), NO_ID)
        self.end[:, 0] = self.hi

    def shifts(self, bits: int) -> np.ndarray:
        width = self.hi.astype(np.uint64) - self.lo.astype(np.uint64)
        return np.array([max(0, int(w).bit_length() - bits) for w in width.tolist()], np.uint64)


class Block:
    """A batch of rows against a pack of anchors."""

    def __init__(self, batch: pa.RecordBatch):
        self.id, self.label, self.no = batch.column(0).fill_null(int(NO_ID)).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        self.ids, self.x = batch.column(0), matrix(batch.column(3))

    def parts(self, pack: dict, asked: Requests, which: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some requests at a time: their numbers, the rows' first keys, and the rows that may count."""
        step = max(1, PRODUCTS // max(1, len(self.no)))
        for at in range(0, len(which), step):
            w = which[at : at + step]
            of, back = np.unique(asked.anchor[w], return_inverse=True)
            fits = ((self.label == pack["label"][of][:, None]) == same) & (self.no != pack["no"][of][:, None])
            yield w, -products(pack["v"][of], self.x)[back], fits[back]


def counted(rows: DataFrame, sent, asked, which: np.ndarray, shift: np.ndarray, bits: int, same: bool) -> DataFrame:
    """(request, bucket, need, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held = sent.value, asked.value
        counts = np.zeros((len(which), 1 << bits), np.int32)
        place = np.zeros(len(held.anchor), np.int64)
        place[which] = np.arange(len(which))
        for batch in batches:
            block = Block(batch)
            for stage in np.unique(held.stage[which]).tolist():
                for w, first, fits in block.parts(pack, held, which[held.stage[which] == stage], same):
                    keys = first if stage == 0 else block.id if stage == 1 else block.no
                    if stage:
                        fits = fits & (first == held.end[w, 0][:, None])
                    if stage == 2:
                        fits = fits & (block.id == held.end[w, 1][:, None])
                    off = np.broadcast_to(keys, fits.shape).astype(np.uint64) - held.lo[w].astype(np.uint64)[:, None]
                    width = held.hi[w].astype(np.uint64) - held.lo[w].astype(np.uint64)
                    i, j = np.nonzero(fits & (off <= width[:, None]))
                    cells = (place[w[i]] << bits) + (off[i, j] >> shift[place[w[i]]]).astype(np.int64)
                    np.add.at(counts.reshape(-1), cells, 1)
        i, j = np.nonzero(counts)
        for at in range(0, len(i), 1 << 18):
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(which[a]), pa.array(b), pa.array(held.need[which[a]]), pa.array(counts[a, b].astype(np.int64))], names=["request", "bucket", "need", "n"])

    found = rows.select("id", "label", "no", "v").mapInArrow(run, "request long, bucket long, need long, n long")
    return found.groupBy("request", "bucket", "need").agg(F.sum("n").alias("n"))


def gathered(rows: DataFrame, sent, asked, same: bool) -> DataFrame:
    """(request, id, score) of the rows up to each request's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held = sent.value, asked.value
        every = np.flatnonzero(held.hi >= held.lo)
        for batch in batches:
            block = Block(batch)
            for w, first, fits in block.parts(pack, held, every, same):
                a, b, c = (held.end[w, k][:, None] for k in range(3))
                inside = fits & (first >= held.floor[w][:, None]) & (first <= a)
                inside &= (first < a) | (block.id < b) | ((block.id == b) & (block.no <= c))
                i, j = np.nonzero(inside)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(w[i]), block.ids.take(pa.array(j)), pa.array(-first[i, j])], names=["request", "id", "score"])

    return rows.select("id", "label", "no", "v").mapInArrow(run, "request long, id long, score long")


def selected(rows: DataFrame, pack: dict, asked: Requests, k: int, same: bool, slack: int) -> DataFrame:
    """(request, rank, id, score): the first k rows of each request, by score descending, then id."""
    sc, sent, held = rows.sparkSession.sparkContext, pack["sent"], None
    ids, numbers = pack["ids"], pack["numbers"]
    left = np.flatnonzero(asked.hi >= asked.lo)
    while len(left):
        bits = int(np.clip((COUNTERS // len(left)).bit_length() - 1, 1, 7))
        shift = asked.shifts(bits)[left]
        if held is not None:
            held.unpersist()
        held = sc.broadcast(asked)
        running = F.sum("n").over(Window.partitionBy("request").orderBy("bucket"))
        sums = counted(rows, sent, held, left, shift, bits, same).withColumn("upto", running)
        # a row per request of this pack
        found = sums.where("upto >= need and upto - n < need").select("request", "bucket", "n", (F.col("upto") - F.col("n")).alias("above")).toArrow()
        r, bucket, n, above = (found.column(c).to_numpy() for c in ("request", "bucket", "n", "above"))
        place = np.searchsorted(left, r)
        asked.need[r] -= above
        start = asked.lo[r].astype(np.uint64) + (bucket.astype(np.uint64) << shift[place])
        room = asked.hi[r].astype(np.uint64) - start
        size = (np.uint64(1) << shift[place]) - np.uint64(1)
        asked.lo[r], asked.hi[r] = start.astype(np.int64), (start + np.minimum(size, room)).astype(np.int64)
        asked.end[r, asked.stage[r]] = asked.hi[r]
        open_ = n > asked.need[r] + slack
        left, exact = np.sort(r[open_]), np.sort(r[open_ & (shift[place] == 0)])
        # one value of a key that too many rows share: the next key tells them apart
        asked.stage[exact] += 1
        asked.lo[exact] = np.where(asked.stage[exact] == 1, ids[0], numbers[0])
        asked.hi[exact] = np.where(asked.stage[exact] == 1, ids[1], numbers[1])
    if held is not None:
        held.unpersist()
    best = Window.partitionBy("request").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return gathered(rows, sent, sc.broadcast(asked), same).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = SCALE, pack: int = ANCHORS, slack: int = SLACK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where anchors holds and each of its positives, the best negatives.

    A component x counts as floor(scale * x), between -2^24 and 2^24, and a score is the inner product. Positives are the best other rows of the anchor's label; negatives
    are the best rows of other labels whose score lies between window[0] and window[1] per cent of the positive's. Higher
    scores come first, then smaller ids, null ids last. Rows with a null label, a null vector or a component that is
    null or not finite take no part; vectors of unequal length are compared as far as both go. Rows that repeat are rows of their own, an
    anchor's copy too. Requests with no row, like those of a negative positive_score, give no row; neither does an empty table. Other columns aren't read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = cut(prepared(vectors, vector, vec_id, label, anchors, scale))
    known = F.coalesce("id", F.lit(int(NO_ID)))
    facts = rows.agg(F.count_if("anchor").alias("n"), F.max("norm").alias("norm"), F.max(F.length("v")).alias("bytes"), F.min(known).alias("a"), F.max(known).alias("b"), F.min("no").alias("c"), F.max("no").alias("d")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    packs = -(-facts["n"] // max(1, min(pack, PACK_BYTES // max(4, facts["bytes"]))))
    out = None
    for k in range(packs):
        mine = rows.where("anchor").where(F.pmod(F.xxhash64("no"), F.lit(packs)) == k).select("id", "label", "no", "v", "norm").toArrow().combine_chunks()
        held = {"label": mine.column("label").to_numpy(), "no": mine.column("no").to_numpy(), "v": matrix(mine.column("v"))}
        given = {"sent": spark.sparkContext.broadcast(held), "ids": (facts["a"], facts["b"]), "numbers": (facts["c"], facts["d"])}
        most = (mine.column("norm").to_numpy() * facts["norm"] * (1 + 1e-9)).astype(np.int64) + 2  # no inner product is larger than that of the lengths
        near = cut(selected(rows, given, Requests(np.arange(len(mine)), -most, most, positives), positives, True, slack))
        found = near.select("request", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).toArrow().combine_chunks()
        drop(near)
        of, score = found.column("request").to_numpy(), found.column("positive_score").to_numpy()
        asked = Requests(of, -(-window[0] * score // 100), window[1] * score // 100, negatives)
        names = pa.table({"request": pa.array(np.arange(len(of))), "anchor_id": mine.column("id").take(pa.array(of)), "positive_id": found.column("positive_id"), "positive_score": found.column("positive_score")})
        far = selected(rows, given, asked, negatives, False, slack).join(F.broadcast(spark.createDataFrame(names)), "request")
        done = cut(far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        given["sent"].unpersist()
        out = done if out is None else out.unionByName(done)
    return out
