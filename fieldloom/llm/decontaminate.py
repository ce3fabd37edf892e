"""Benchmark decontamination with an Aho-Corasick automaton over the windows of test items.

A test item (question and answer in one text) becomes its windows of ten words; a shorter item is one
window. The automaton holds each window once, as words between single spaces. Documents are normalised
the same way, many texts in one string with a wider gap between them, and scanned once; a match ends
at a known word, so hits are word ranges, and those map back to offsets in the original text.

Windows go to tasks in packs of bounded size, whose number grows with the benchmark and not with the corpus. There is one
pack up to some two million bytes of windows; beyond, documents pass the packs one after the other, with their
hits kept in shared storage between.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesk
from .cut import cut, drop, named, small_batches

WINDOW = 10
PACK_BYTES = 2 << 20

BETWEEN = np.zeros(256, bool)
BETWEEN[0x00:0x30] = BETWEEN[0x3A:0x61] = BETWEEN[0x7B:0x80] = True

_automata: dict[str, ahocorasick.Automaton] = {}


class Normalised:
    """The words of a slice of rows in one string: a space around each word, one more between rows."""

    def __init__(self, part: np.ndarray, off: np.ndarray):
        low = bytesk.LOWER[part]
        self.starts, self.ends, self.first = bytesk.words(low, off, BETWEEN)
        size = self.ends - self.starts
        row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        at = np.cumsum(size + 1) - size + row
        self.stops = at + size
        out = np.full(int(self.stops[-1]) + 1 if len(size) else 0, 32, np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + inside] = low[np.repeat(self.starts, size) + inside]
        self.at, self.bytes = at, out.tobytes()


def item_windows(items: DataFrame, text: str, item_id: str, window: int) -> DataFrame:
    """(window, n, items): each distinct window, its number of words, and the items that have it."""

    def send(batch: pa.RecordBatch, row: list[int], size: list[int], spans: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(spans, pa.binary()), pa.array(size, pa.int64()), batch.column(0).take(pa.array(row))], names=["window", "n", "item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bytesk.column(batch.column(1))
            for i, j in bytesk.slices(off, 1 << 16):
                words = Normalised(data[off[i] : off[j]], off[i : j + 1] - off[i])
                row, size, spans = [], [], []
                for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    n = min(window, b - a)
                    for w in range(a, b - n + 1 if n else a):
                        row.append(i + k)
                        size.append(n)
                        spans.append(words.bytes[words.at[w] - 1 : words.stops[w + n - 1] + 1])
                        if len(spans) == 1 << 14:
                            yield send(batch, row, size, spans)
                            row, size, spans = [], [], []
                if spans:
                    yield send(batch, row, size, spans)

    found = items.select(named(item_id).cast("string").alias("item"), named(text).alias("text")).mapInArrow(run, "window binary, n long, item string")
    return found.groupBy("window", "n").agg(F.collect_set("item").alias("items"))


def automaton(key: str, windows: list) -> ahocorasick.Automaton:
    """The automaton of a pack, built once per Python worker."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for k, row in enumerate(windows):
            made.add_word(bytes(row["window"]).decode("latin-1"), (k, row["n"]))  # a character per byte
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, items (ids as strings, ascending), spans (start and end in characters of the original text).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A word is hit if it lies in
    any occurrence of a window. spans are the longest runs of hit words, from the first character to behind the last one.
    Null and wordless texts have no word; items without words have no window; items with a null id hit words and are
    not named; rows that share an item_id are one item. Rows that repeat, or share a doc_id, are judged one by one.
    An empty benchmark hits nothing; an empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = cut(item_windows(items, item_text, item_id, window))
    held = F.length("window") + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0))
    packs = max(1, -(-(windows.select(F.sum(held)).first()[0] or 0) // pack_bytes))
    dealt = windows.withColumn("pack", F.pmod(F.xxhash64("window"), F.lit(packs)))

    def scan(df: DataFrame, pack: int, last: bool) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast([r.asDict() for r in dealt.where(F.col("pack") == pack).select("window", "n", "items").collect()])
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            find = automaton(key, known) if known else None
            for batch in batches:
                data, off = bytesk.column(batch.column(1))
                for i, j in bytesk.slices(off):
                    part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                    words = Normalised(part, o)
                    hit, found_ = np.zeros(len(words.starts) + 1, np.int64), [set(x) for x in batch.column(3).slice(i, j - i).to_pylist()]
                    for r, ranges in enumerate(batch.column(2).slice(i, j - i).to_pylist()):
                        for x in ranges:
                            hit[words.first[r] + x["a"]] += 1
                            hit[words.first[r] + x["b"]] -= 1
                    if find is not None and words.bytes:
                        matches = [(end, k, n) for end, (k, n) in find.iter(words.bytes.decode("latin-1"))]
                        if matches:
                            end, which, n = np.array(matches, np.int64).T
                            at = np.searchsorted(words.stops, end)
                            np.add.at(hit, at - n + 1, 1)
                            np.add.at(hit, at + 1, -1)
                            pairs = np.unique(np.stack([np.searchsorted(words.first, at, "right") - 1, which]), axis=1)
                            for r, k in pairs.T.tolist():
                                found_[r].update(known[k]["items"])
                    yield rows(batch.slice(i, j - i), part, o, words, np.cumsum(hit)[:-1] > 0, found_, last)

        return df.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>" if last else f"doc_id {kind}, text string, hits array<struct<a:long,b:long>>, items array<string>"), sent

    kind = docs.schema[doc_id].dataType.simpleString()
    none = F.array().cast("array<struct<a:long,b:long>>").alias("hits"), F.array().cast("array<string>").alias("items")
    df, before = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"), *none), None
    for pack in range(packs):
        df, sent = scan(df, pack, pack == packs - 1)
        if pack < packs - 1:
            df = cut(df)
            sent.unpersist()
            if before is not None:
                drop(before)
            before = df
    return df


def rows(batch: pa.RecordBatch, part: np.ndarray, off: np.ndarray, words: Normalised, hit: np.ndarray, items: list[set], last: bool) -> pa.RecordBatch:
    """The result rows, or those for the next pack."""
    n = np.diff(words.first)
    edge = np.zeros(len(hit) + 1, bool)
    edge[words.first] = True
    begin = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1]))) if len(hit) else np.zeros(0, np.int64)
    end = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1 if len(hit) else begin
    of = np.searchsorted(words.first, begin, "right") - 1
    offsets = pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32())
    listed = lambda a, b, names: pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names))
    ids = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
    if not last:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed(begin - words.first[of], end - words.first[of], ["a", "b"]), ids], names=["doc_id", "text", "hits", "items"])
    total = np.append(0, np.cumsum(hit))
    chars = bytesk.code_points(part)
    spans = listed(chars[words.starts[begin]] - chars[off[of]], chars[words.ends[end - 1]] - chars[off[of]], ["start", "end"])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total[words.first[1:]] - total[words.first[:-1]]), ids, spans], names=["doc_id", "n_words", "n_hit", "items", "spans"])
