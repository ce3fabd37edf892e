"""Sum-of-squares packing of documents into sequences of a fixed length.

Documents are encoded where they lie; only (id, piece, length) rows move. Longer documents are cut,
the shorter piece first. Rows are dealt into shards by hash, so that a shard's rows are bounded
whatever the corpus, and each shard is packed by itself: a piece goes where the sum over all
residual gaps of the squared number of open sequences with that gap becomes smallest, over all open
gaps and over opening a new sequence. Among equals it goes to the smallest gap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, small_batches
from .tokens import encoder, vocabulary

LENGTH = 2048
SHARD_ROWS = 20_000


def cut_pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole ones, the first one may be shorter."""
    first = n % length or length
    return [(0, first), *[(at, length) for at in range(first, n, length)]]


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in descending order of length."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        rest = 2 * n[: capacity + 1 - size] + 1
        rest[0] = 0
        gain = np.where(n[size:] > 0, rest - 2 * n[size:] + 1, np.iinfo(np.int64).max)
        gain[-1] = rest[-1]  # a sequence not yet open
        left = int(np.argmin(gain))
        gap = left + size
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = open_at[gap].pop()
            n[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if left:
            open_at[left].append(at)
            n[left] += 1
    return sequence, offset


def encoded_pieces(docs: DataFrame, text: str, doc_id: str, length: int, end: int, path: str) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(path)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.asarray([*encode(value.as_py() or ""), end], "<u4")
                rows += [(key, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())) for piece, (at, n) in enumerate(cut_pieces(len(ids), length))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end: int = 0, path: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone; a text of any length is encoded whole. Ids are whole
    numbers, and may be null or repeat; each row of docs is packed by itself. An empty table gives no
    rows. Other columns aren't read. A shard holds about shard_rows pieces, whatever their ids, and
    leaves at most a few sequences with room, so shards cost well under a thousandth of all sequences.
    """
    pieces = cut(encoded_pieces(docs, text, doc_id, length, end, path or vocabulary()))
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        sequence, offset = pack(table.column("length").to_numpy(), length)
        first = table.column("shard")[0].as_py() << 32
        return table.drop(["shard"]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    # rows are read from a table, so their numbers are the same when a task runs again; they part rows that are equal otherwise
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
