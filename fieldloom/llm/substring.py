"""Substring deduplication: seeds from winnowed anchors, extended to maximal repeats.

A window is ``length`` consecutive words of a document. Of the word grams in a window, the one with
the smallest hash (the first, if several) is its anchor. That choice depends on the window's words
only, so equal windows have equal anchors at equal places. Consecutive windows with one anchor are a
run, and a run's range is all words of its windows: the anchor extended both ways as far as it
serves.

Occurrences are joined on the anchor's hash, one row per run. Runs with equal ranges repeat as a
whole: all but the smallest document's are repeats. Of each range that document stays behind as its
representative; where an anchor has several ranges, their representatives are compared window by
window, which extends matches over the part that two ranges share. Windows that touch or overlap are
the maximal repeats. Rows grow with the text, never with pairs of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesk
from .cut import cut, small_batches

LENGTH = 50
GRAM = 20


class Runs:
    """The runs of a slice of rows: row, first window, number of windows, and hashes of anchor and range."""

    def __init__(self, part: np.ndarray, off: np.ndarray, length: int, gram: int):
        self.starts, self.ends, self.first = bytesk.words(part, off)
        self.length = length
        self.hashes, self.second = (bytesk.span_hashes(part, self.starts, self.ends, base) for base in bytesk.BASES)
        n, wide = np.diff(self.first), length - gram + 1
        at = np.repeat(self.first[:-1], np.maximum(n - length + 1, 0))
        inside = np.maximum(n - length + 1, 0)
        self.window = at + np.arange(len(at)) - np.repeat(np.cumsum(inside) - inside, inside)
        row = np.repeat(np.arange(len(n)), inside)
        if not len(at):
            self.row = self.begin = self.count = np.zeros(0, np.int64)
            self.anchor = self.r1 = self.r2 = np.zeros(0, np.uint64)
            return
        grams = bytesk.rolling(self.hashes, gram)
        anchors = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1)[self.window] + self.window
        new = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])))
        self.row, self.begin, self.count, self.anchor = row[new], self.window[new], np.diff(np.append(new, len(at))), grams[anchors[new]]
        place = bytesk.mix((anchors[new] - self.begin).astype(np.uint64))
        self.r1, self.r2 = (h ^ place for h in self.ranges(self.begin, self.begin + self.count + length - 1))

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of word ranges, from two independent hashes of each word."""
        return tuple(bytesk.range_hashes(h, starts, ends, base) for h, base in zip((self.hashes, self.second), bytesk.BASES, strict=True))


def runs_of(batch: pa.RecordBatch, column: int, length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, Runs]]:
    data, off = bytesk.column(batch.column(column))
    for i, j in bytesk.slices(off):
        part = data[off[i] : off[j]]
        yield i, j, part, Runs(part, off[i : j + 1] - off[i], length, gram)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    differs = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        differs |= k[1:] != k[:-1]
    return np.append(True, differs)


def dealt(sent: DataFrame, key: str) -> DataFrame:
    """Rows of one key together, but for those that a smaller document in their own batch has settled: they ask nothing, and go anywhere.

    A passage that every document has thus sends one row a batch to one task, not one a document.
    """
    return sent.repartition(F.when(F.col("known"), F.xxhash64("id", key)).otherwise(F.col(key)))


def repeated_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, r1, whole): runs of a document that a smaller one has whole, and runs to be compared window by window."""
    schema = "known boolean, a long, r1 long, r2 long, id long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for i, _, _, r in runs_of(batch, 1, length, gram):
                parts.append(np.stack([r.anchor.view(np.int64), r.r1.view(np.int64), r.r2.view(np.int64), ids[i + r.row]]))
            a, r1, r2, own = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
            if not len(a):
                continue
            order = np.lexsort((own, r2, r1, a))
            a, r1, r2, own = a[order], r1[order], r2[order], own[order]
            new = firsts(a, r1, r2)
            smallest = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
            known = own > smallest  # a smaller document in this batch has the range: no need to ask further
            out = firsts(a, r1, r2, own)
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (known, a, r1, r2, own)], names=["known", "a", "r1", "r2", "id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor, range and smallest id of the last row; whether its anchor has had two ranges
        waiting = None
        for batch in batches:
            known, a, r1, r2, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = [np.stack([own[known], r1[known], np.ones(known.sum(), np.int64)])]
            a, r1, r2, own = a[~known], r1[~known], r2[~known], own[~known]
            if len(a):
                if last:
                    a, r1, r2, own = (np.append(x, y) for x, y in zip(last, (a, r1, r2, own), strict=True))
                new_range, new_anchor = firsts(a, r1, r2), firsts(a)
                at = np.maximum.accumulate(np.where(new_range, np.arange(len(a)), 0))
                whole = own > own[at]
                ranges = np.flatnonzero(new_range)
                group = np.cumsum(new_anchor[ranges])
                several = np.bincount(group)[group] > 1
                fresh = np.ones(len(ranges), bool)
                if last:  # the first row stands for the rows before this batch
                    fresh[0] = waiting
                    if not waiting:
                        several |= group == 1
                    whole[0] = False
                probe = ranges[several & fresh]
                rows += [np.stack([own[whole], r1[whole], np.ones(whole.sum(), np.int64)]), np.stack([own[probe], r1[probe], np.zeros(len(probe), np.int64)])]
                end = ranges[-1]
                last = (a[end], r1[end], r2[end], own[end])
                waiting = not several[-1]
            own, r1, flag = np.concatenate(rows, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(r1), pa.array(flag.astype(bool))], names=["id", "r1", "whole"])

    sent = dealt(docs.mapInArrow(send, schema), "a").sortWithinPartitions("known", "a", "r1", "r2", "id")
    return sent.mapInArrow(meet, "id long, r1 long, whole boolean")


def repeated_windows(docs: DataFrame, probes: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, r1, at): windows of the runs in probes, by their place in the run, that a smaller document has too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            asked = batch.column(2)
            for i, _, _, r in runs_of(batch, 1, length, gram):
                take = chosen(r, asked, i)
                n = r.count[take]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(r.begin[take], n) + inside
                own, range_ = np.repeat(ids[i + r.row[take]], n), np.repeat(r.r1.view(np.int64)[take], n)
                if len(at):
                    w1, w2 = (w.view(np.int64) for w in r.ranges(at, at + length))
                    order = np.lexsort((own, w2, w1))
                    w1, w2, own, range_, inside = (c[order] for c in (w1, w2, own, range_, inside))
                    head = np.maximum.accumulate(np.where(firsts(w1, w2), np.arange(len(w1)), 0))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own > own[head], w1, w2, own, range_, inside)], names=["known", "w1", "w2", "id", "r1", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            known, w1, w2, own, r1, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in (own, r1, at)], names=["id", "r1", "at"])
                w1, w2, own, r1, at = (c[~known] for c in (w1, w2, own, r1, at))
            if len(w1):
                if last:
                    w1, w2, own, r1, at = (np.append(x, y) for x, y in zip((*last, 0, 0), (w1, w2, own, r1, at), strict=True))
                head = np.maximum.accumulate(np.where(firsts(w1, w2), np.arange(len(w1)), 0))
                later = own > own[head]
                last = (w1[-1], w2[-1], own[head[-1]])
                yield pa.RecordBatch.from_arrays([pa.array(own[later]), pa.array(r1[later]), pa.array(at[later])], names=["id", "r1", "at"])

    asked = probes.groupBy("id").agg(F.collect_set("r1").alias("asked"))
    sent = docs.join(asked, "id").select("id", "text", "asked").mapInArrow(send, "known boolean, w1 long, w2 long, id long, r1 long, at long")
    return dealt(sent, "w1").sortWithinPartitions("known", "w1", "w2", "id").mapInArrow(meet, "id long, r1 long, at long")


def chosen(r: Runs, lists: pa.Array, i: int) -> np.ndarray:
    """Numbers of the runs whose range is in their row's list."""
    if not len(r.row):
        return np.zeros(0, np.int64)
    mine = lists.slice(i, int(r.row[-1]) + 1)
    of, values = np.repeat(np.arange(len(mine)), mine.value_lengths().fill_null(0).to_numpy()), mine.flatten().to_numpy()
    pairs = bytesk.mix(values.view(np.uint64) + bytesk.mix(of.astype(np.uint64)))
    return np.flatnonzero(np.isin(bytesk.mix(r.r1 + bytesk.mix(r.row.astype(np.uint64))), pairs))


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, repeats (first word and end of each maximal repeat), kept.

    Words are runs without ASCII white space, unchanged. A word goes if a window that covers it also
    starts in a document with a smaller id; windows are judged on the input. kept is what stays,
    joined by single spaces. Null, empty and short texts have no window and lose nothing; so do rows
    with a null id, which no other row is compared with. Rows that share an id are one document to
    each other: neither removes from the other, and each is judged against smaller ids only; a range
    one of them has is removed from both where both have it. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    named = base.where("id is not null")
    found = cut(repeated_runs(named, length, gram))
    windows = repeated_windows(named, found.where("not whole"), length, gram)
    whole = found.where("whole").select("id", "r1", F.lit(-1).cast("long").alias("at"))
    gone = whole.union(windows).groupBy("id").agg(F.collect_set(F.struct("r1", "at")).alias("gone"))
    df = base.join(gone, "id", "left").select("id", "text", F.transform("gone", lambda g: g["r1"]).alias("r1"), F.transform("gone", lambda g: g["at"]).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, r in runs_of(batch, 1, length, gram):
                cover = np.zeros(len(r.starts) + 1, np.int64)
                lists, places = batch.column(2), batch.column(3)
                runs = chosen(r, lists, i)
                row = r.row[runs]
                for k in np.unique(row).tolist():
                    r1, at = (np.array(c[i + k].as_py(), np.int64) for c in (lists, places))
                    for x in runs[row == k].tolist():
                        begin, hits = r.begin[x], at[r1 == r.r1.view(np.int64)[x]]
                        if (hits < 0).any():
                            cover[begin] += 1
                            cover[begin + r.count[x] + length - 1] -= 1
                        else:
                            np.add.at(cover, begin + hits, 1)
                            np.add.at(cover, begin + hits + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                yield finish(batch.column(0).slice(i, j - i), part, r, gone)

    return df.mapInArrow(run, "doc_id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept string")


def finish(ids: pa.Array, part: np.ndarray, r: Runs, gone: np.ndarray) -> pa.RecordBatch:
    raw, kept, repeats, removed = part.tobytes(), [], [], []
    starts, ends = r.starts.tolist(), r.ends.tolist()
    for a, b in zip(r.first[:-1].tolist(), r.first[1:].tolist(), strict=True):
        mine = gone[a:b]
        removed.append(int(mine.sum()))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        repeats.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
        kept.append(b" ".join([raw[starts[k] : ends[k]] for k in range(a, b) if not gone[k]]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(r.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "repeats", "kept"])
