"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = logistic(w x - b_k) with one weight vector w for all grades and ascending thresholds
b_k. Expected severity is the sum of these probabilities. Features are the words present in a text and
their beginnings of 5, 6 and 7 bytes (for languages that inflect and compound), hashed into ``BUCKETS``; only buckets that go with toxic labels or with clean ones beyond chance take
part, so long texts don't add up noise.

The model is fitted on a bounded sample of labelled rows (``MAX_LABELLED``, by a hash of the id);
everything is scored. Tasks count the sample's texts per bucket and class; the driver gets these counts
(``BUCKETS`` at most), chooses, and gets the sample's chosen buckets alone.

Labels above 1 are grades and taken as they are. Where labels say toxic or not only, grades among the
toxic texts come from how many marker words and beginnings (buckets many times as frequent in toxic
texts) they hold: below ``SEVERE``, or as many and more. So with such labels the second threshold tells
mild from dense toxicity; tests hold it against texts and labels left out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesk
from .cut import cut, small_batches

MAX_LABELLED = 8_000
BUCKETS = 1 << 18
MIN_DOCS = 5
MIN_Z = 4.5
SEVERE = 12
BEGINNINGS = (5, 6, 7)
#: Bytes between words: all ASCII characters but letters.
BETWEEN = np.arange(256) < 128
BETWEEN[65:91] = BETWEEN[97:123] = False


def text_buckets(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets, ascending, and how often each occurs."""
    data, off = bytesk.column(values)
    for i, j in bytesk.slices(off):
        part = bytesk.LOWER[data[off[i] : off[j]]]
        starts, ends, first = bytesk.words(part, off[i : j + 1] - off[i], BETWEEN)
        kinds = [bytesk.span_hashes(part, starts, np.minimum(ends, starts + n)) + np.uint64(n) for n in (*BEGINNINGS, 1 << 30)]
        found = (bytesk.mix(np.stack(kinds, axis=1)) % np.uint64(BUCKETS)).astype(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = np.sort(found[a:b].ravel())
            at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
            yield s[at], np.diff(np.append(at, len(s)))


def select(d1: np.ndarray, d0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose share of toxic texts is beyond chance, and those of them that mark toxic texts.

    d1, d0: toxic and clean texts per bucket; n1, n0: of each kind altogether.
    """
    p1, p0, p = d1 / max(n1, 1), d0 / max(n0, 1), (d1 + d0) / max(n1 + n0, 1)
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    chosen = np.flatnonzero((d1 + d0 >= MIN_DOCS) & (np.abs(z) >= MIN_Z)) if n1 and n0 else np.zeros(0, np.int64)
    ratio = (d1[chosen] + 0.5) / (n1 + 1) / ((d0[chosen] + 0.5) / (n0 + 1))
    return chosen, chosen[ratio >= 10]


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_columns: int, penalty: float = 1e-4, steps: int = 800, levels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by accelerated gradient descent on the mean negative log likelihood.

    rows, columns: which feature is in which text; levels: the highest grade, if none of the texts may have it. Thresholds are
    the first one and logs of the steps to the next.
    """
    n, top = len(grades), levels or int(grades.max())
    upper = np.clip((grades[None] > np.arange(top)[:, None]).mean(axis=1), 1e-3, 1 - 1e-3)
    start = np.log((1 - upper) / upper)
    t = np.append(start[:1], np.log(np.maximum(np.diff(start), 0.1)))
    x = np.concatenate([np.zeros(n_columns), t])
    squares = np.full(len(x), 1e-8)
    move = np.zeros(len(x))
    sigma = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for _ in range(steps):
        w, gaps = x[:n_columns], np.exp(x[n_columns + 1 :])
        b = x[n_columns] + np.append(0, np.cumsum(gaps))
        score = np.bincount(rows, w[columns], minlength=n)
        edges = np.concatenate([[np.inf], -b, [-np.inf]])  # P(grade > k) = sigma(score + edges[k + 1])
        above, below = sigma(score + edges[grades]), sigma(score + edges[grades + 1])
        above, below = np.where(grades == 0, 1.0, above), np.where(grades == top, 0.0, below)
        p = np.maximum(above - below, 1e-12)
        da, db = above * (1 - above) / p, below * (1 - below) / p
        g_score = -(da - db) / n
        g_b = np.bincount(grades[grades > 0] - 1, da[grades > 0], minlength=top) / n - np.bincount(grades[grades < top], db[grades < top], minlength=top) / n
        g_gaps = np.cumsum(g_b[::-1])[::-1]
        gradient = np.concatenate([np.bincount(columns, g_score[rows], minlength=n_columns) + penalty * w, [g_b.sum()], g_gaps[1:] * gaps])
        squares = 0.999 * squares + 0.001 * gradient**2
        move = 0.9 * move + 0.1 * gradient
        x = x - 0.05 * move / (np.sqrt(squares) + 1e-4)
    return x[:n_columns], x[n_columns] + np.append(0, np.cumsum(np.exp(x[n_columns + 1 :])))


def labelled_texts(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most: int) -> DataFrame:
    """(id, grade, text) of the sample: a row per labelled id, its highest label, and one text however often the id occurs."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.greatest(F.max(label), F.lit(0)).cast("int").alias("grade"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "id")
    return cut(found.groupBy("id").agg(F.max("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")))


def bucket_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean texts of the sample per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for grade, (found, _) in zip(batch.column(0).to_pylist(), text_buckets(batch.column(1)), strict=True):
                n[int(grade > 0), found] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], names=["bucket", "d1", "d0"])

    sums = sample.select("grade", "text").mapInArrow(run, "bucket long, d1 long, d0 long").groupBy("bucket").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0")).toArrow()
    out = np.zeros((2, BUCKETS), np.int64)
    for k, name in enumerate(("d1", "d0")):
        out[k, sums.column("bucket").to_numpy()] = sums.column(name).to_numpy()
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, max_labelled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen buckets, their weights, and the thresholds."""
    sample = labelled_texts(docs, labels, text, doc_id, label, max_labelled)
    n1, n0, top = sample.agg(F.count(F.when(F.col("grade") > 0, 1)), F.count(F.when(F.col("grade") == 0, 1)), F.max("grade")).first()
    chosen, markers = select(*bucket_counts(sample), n1, n0)
    if not len(chosen):
        return chosen, np.zeros(0), np.full(max(2, top or 0), 40.0)
    places = np.full(BUCKETS, -1, np.int32)
    places[chosen] = np.arange(len(chosen))
    is_marker = np.isin(chosen, markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, marks = [], []
            for found, times in text_buckets(batch.column(2)):
                place = places[found]
                at.append(place[place >= 0])
                marks.append(int(times[place >= 0][is_marker[at[-1]]].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(marks, pa.int64())], names=["id", "grade", "at", "marks"])

    rows = sample.select("id", "grade", "text").mapInArrow(run, "id long, grade int, at array<int>, marks long").toArrow().sort_by("id")
    at, grades, marks = rows.column("at").combine_chunks(), rows.column("grade").to_numpy().astype(np.int64), rows.column("marks").to_numpy()
    if top == 1:
        grades = grades + (grades > 0) * (marks >= SEVERE)
    w, b = fit(np.repeat(np.arange(len(grades)), at.value_lengths().to_numpy()), at.flatten().to_numpy(), grades, len(chosen), levels=max(2, top))
    return chosen, w, b


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A row per row of docs: doc_id, severity (expected grade), grade (the likeliest), p_toxic, toxic (p_toxic of 0.5 or more).

    Severity is from 0 to the highest label, 2 at least. Null and empty texts have no words and get
    the score of a text without features; long ones are read whole. Null labels and labels of no
    document are passed over, and those below 0 count as 0; where an id has several labels the highest holds, and where it has
    several texts one of them is learned from. Without labels of both kinds nothing is toxic. Ids are whole numbers, and may be null or
    repeat; repeated rows score alike; an empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, text, doc_id, label, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, b = model.value
        weights = np.zeros(BUCKETS)
        weights[chosen] = w
        for batch in batches:
            score = np.array([weights[f].sum() for f, _ in text_buckets(batch.column(1))])
            above = 1 / (1 + np.exp(-np.clip(score[:, None] - b[None], -40, 40)))
            p = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
            grade = np.argmax(p[:, :-1] - p[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
