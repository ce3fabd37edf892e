"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; the bits already decided make a node, and a context is up to ``depth``
bytes before it (true bytes, six at most: a context and its byte are one 64-bit key). Each node of each
context holds a Krichevsky-Trofimov estimator. From the longest context up, the weighted probability of
what was seen in a context is half its own block probability plus half the product over its longer
contexts; the posterior of its own half is its share when the depths are mixed. All of this depends on
counts alone: tasks count what they read, groups of contexts that share their last three bytes compute their subtrees,
and the depths above are summed up and go to all tasks: at most 65,536 contexts of two bytes with two numbers for each of
255 nodes, 134 MB if every pair of bytes occurs.

The table has a row for each context and byte that occurs in any text, and so grows with the corpus.
Those of texts held out count as seen 0 times: they change no weight, and get their probability from the
longest contexts seen. The commonest ``TOP_CONTEXTS`` are broadcast; all others of a document go to
their probabilities by a join.

The base score needs the count of every word. The commonest ``TOP_WORDS`` are broadcast; all other
words of a document go to their counts by the same join, so the vocabulary may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesk
from .cut import cut, named, small_batches

TOP_WORDS = 1 << 19
TOP_CONTEXTS = 1 << 21
FLUSH = 2_000_000
STOP = 255  # no byte of UTF-8; ends a text, and stands for what comes before one
END_WORD = np.int64(0x2545F4914F6CDD1D)
DEPTH, DEEPEST = 3, 6
RAW = 1 << 22
GROUP = 1 << 17


def coded(part: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of context and byte (the last byte of the context highest, the byte itself lowest) for every byte of each text and the stop that ends it, and where each text begins among them."""
    n = np.diff(off)
    stops = off[:-1] + n + (depth + 1) * np.arange(len(n))  # where texts end, ``depth`` stops and one before each but the first
    padded = np.full(7 + len(part) + (depth + 1) * len(n), STOP, np.uint8)
    inside = np.ones(len(padded) - 7, bool)
    for d in range(depth + 1):
        inside[stops + d] = False
    padded[7:][inside] = part
    inside[stops] = True
    # eight bytes up to each place, the last of them highest
    eight = np.ndarray((len(inside),), "<u8", padded, strides=(1,))[inside]
    context = (eight >> np.uint64(8 * (6 - depth))) & np.uint64((1 << 8 * (depth + 1)) - 256)
    return (context | eight >> np.uint64(56)).view(np.int64), off[:-1] + np.arange(len(n))


class Counter:
    """Counts of 64-bit keys: a block of keys as they come, and the distinct keys seen so far with their counts, in order; holds a few million at most between flushes."""

    def __init__(self):
        self.block, self.used = np.empty(RAW, np.int64), 0
        self.keys = self.n = np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.keys) > FLUSH

    def add(self, keys: np.ndarray) -> None:
        while len(keys):
            taken = keys[: RAW - self.used]
            self.block[self.used : self.used + len(taken)] = taken
            self.used += len(taken)
            keys = keys[len(taken) :]
            if self.used == RAW:
                self.merge()

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys among some in order, and their counts."""
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[at], np.diff(np.append(at, len(keys)))

    def merge(self) -> None:
        if not self.used:
            return
        block = self.block[: self.used]
        block.sort()
        keys, n = self.distinct(block)
        self.used = 0
        at = np.searchsorted(self.keys, keys)
        old = np.append(self.keys, keys[-1:])[at] == keys
        old[at == len(self.keys)] = False
        self.n[at[old]] += n[old]
        new = ~old
        if new.any():
            place = at[new] + np.arange(new.sum())
            kept = np.ones(len(self.keys) + len(place), bool)
            kept[place] = False
            for name, values in (("keys", keys[new]), ("n", n[new])):
                out = np.empty(len(kept), np.int64)
                out[place], out[kept] = values, getattr(self, name)
                setattr(self, name, out)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.n
        self.keys = self.n = np.zeros(0, np.int64)
        return out


class ContextCounter(Counter):
    """Counts of keys of 56 bits; those that come with a lowest bit of 1 below them are kept and count 0 times."""

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = keys >> 1
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        return both[at], np.add.reduceat(~keys & 1, at)


def word_keys(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = bytesk.LOWER[part]
    starts, ends, first = bytesk.words(low, off)
    return bytesk.span_hashes(low, starts, ends).view(np.int64), first


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(word, key, n): words of training texts by hash, and contexts with their byte by key; those in texts held out have n = 0 if nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {True: Counter(), False: ContextCounter()}

        def out(word: bool) -> pa.RecordBatch:
            keys, n = counters[word].flush()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), word)), pa.array(keys), pa.array(n)], names=["word", "key", "n"])

        for batch in batches:
            data, off = bytesk.column(batch.column(0))
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in bytesk.slices(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                learned = ~held[i:j]
                keys, first = word_keys(part, o)
                counters[True].add(np.append(keys[np.repeat(learned, np.diff(first))], np.full(learned.sum(), END_WORD)))
                keys, _ = coded(part, o, depth)
                counters[False].add(keys << 1 | np.repeat(held[i:j], np.diff(o) + 1))
                for word, counter in counters.items():
                    if counter.full:
                        yield out(word)
        yield out(True)
        yield out(False)

    seen = docs.select("text", "held_out").mapInArrow(run, "word boolean, key long, n long")
    # tasks send distinct keys: to sum them once more before they move would cost more than it saves
    return seen.repartition("word", "key").groupBy("word", "key").agg(F.sum("n").alias("n"))


def lookup(keys: np.ndarray, table: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some ascending keys whether it is in an ascending table, and its value (0 if not)."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    hit = table[at] == keys
    return hit, np.where(hit, logs[at], 0.0)


def grouped(keys: np.ndarray, row: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, row) in the order of keys: row, times, and the distinct keys with the number of the one each pair has. row is below 256; whole: keys have 64 bits, not 56."""
    if whole:
        order = np.lexsort((row, keys))
        keys, row = keys[order], row[order]
        at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))) if len(keys) else np.zeros(0, np.int64)
        key, row, n = keys[at], row[at], len(keys)
    else:
        both = keys.view(np.uint64) << np.uint64(8) | row.astype(np.uint64)
        both.sort()
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        key, row, n = (both[at] >> np.uint64(8)).view(np.int64), (both[at] & np.uint64(255)).astype(np.int64), len(both)
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    return row, np.diff(np.append(at, n)), key[first], np.cumsum(first) - 1


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: shifted by eight, then Stirling's series."""
    x = np.asarray(x, float)
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at each binary node (1 to 255) of rows of 256 byte counts."""
    total = np.zeros((len(counts), 512))
    total[:, 256:] = counts
    for k in range(255, 0, -1):
        total[:, k] = total[:, 2 * k] + total[:, 2 * k + 1]
    return total[:, 0:512:2][:, :256], total[:, 1:512:2][:, :256]


HALVES, WHOLES = lgamma(np.arange(1 << 12) + 0.5), lgamma(np.arange(1 << 12) + 1.0)


def log_gamma(x: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    """lgamma(x + shift) for whole x, small ones looked up."""
    out = table[np.minimum(x, len(table) - 1).astype(np.int64)]
    large = x >= len(table)
    out[large] = lgamma(x[large] + shift)
    return out


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return log_gamma(zeros, 0.5, HALVES) + log_gamma(ones, 0.5, HALVES) - np.log(np.pi) - log_gamma(zeros + ones, 1.0, WHOLES)


class Depth:
    """The contexts of one depth: estimators, weighted block probabilities, and the share of each one's own estimate."""

    def __init__(self, counts: np.ndarray, longer: np.ndarray | None):
        """longer: per row and node, summed log weighted probabilities of the contexts one byte longer."""
        zeros, ones = nodes(counts)
        self.seen = zeros + ones > 0
        self.estimate = (ones + 0.5) / (zeros + ones + 1)
        own = block(zeros, ones)
        self.weighted = own if longer is None else np.logaddexp(own, longer) - np.log(2)
        self.share = np.ones_like(own) if longer is None else np.exp(own - np.log(2) - self.weighted)


def subtree(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys, all of those that share their last ``top`` bytes: the probability of each bit of each one's byte, mixed over the depths
    from ``top`` (nan: not seen there), and what the contexts one byte shorter need, by cell: a context and below it, in nine bits,
    1 to 255 for the log weighted probabilities of its nodes and 256 to 511 for the counts of bytes."""
    pairs, counts, up = {depth: keys.view(np.uint64)}, {depth: n.astype(float)}, {}
    for d in range(depth - 1, top - 1, -1):
        longer = pairs[d + 1]
        pairs[d], up[d] = np.unique(longer >> np.uint64(16) << np.uint64(8) | longer & np.uint64(255), return_inverse=True)
        counts[d] = np.bincount(up[d], counts[d + 1])
    above = (pairs[top] >> np.uint64(16) << np.uint64(9)).astype(np.int64)
    byte = (pairs[top] & np.uint64(255)).astype(np.int64) | 256
    probability, cells, values = np.empty((len(keys), 8), np.float32), [above | byte], [counts[top]]
    for k in range(8):
        # all pairs under a node lie side by side
        run, estimate, share, seen = {}, {}, {}, {}
        for d in range(depth, top - 1, -1):
            node, bit = pairs[d] >> np.uint64(8 - k), pairs[d] >> np.uint64(7 - k) & np.uint64(1) > 0
            new = np.append(True, node[1:] != node[:-1])
            run[d], first = np.cumsum(new) - 1, np.flatnonzero(new)
            ones, both = np.add.reduceat(counts[d] * bit, first), np.add.reduceat(counts[d], first)
            own = block(both - ones, ones)
            if d == depth:
                weighted = own
            else:
                longer = np.bincount(run[d][up[d][begun]], weighted, len(first))
                weighted = np.logaddexp(own, longer) - np.log(2)
                share[d] = np.exp(own - np.log(2) - weighted)[run[d]]
            of_bit = np.where(bit, ones[run[d]], (both - ones)[run[d]])
            estimate[d], seen[d] = (of_bit + 0.5) / (both[run[d]] + 1), (both > 0)[run[d]]
            begun = first
        cells.append(above[first] | byte[first] >> (8 - k))
        values.append(weighted)
        # the probability is fixed + left x what the longer contexts say
        fixed, left, p = np.zeros(len(pairs[top])), np.ones(len(pairs[top])), np.where(seen[top], estimate[top], np.nan)
        for d in range(top, depth):
            fixed, left = (fixed + left * share[d] * estimate[d])[up[d]], (left * (1 - share[d]))[up[d]]
            p = np.where(seen[d + 1], fixed + left * estimate[d + 1], p[up[d]])
        probability[:, k] = p
    cell, of = np.unique(np.concatenate(cells), return_inverse=True)
    return probability, cell, np.bincount(of, np.concatenate(values))


def spelled(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, and for each its 256 counts and the summed log weighted probabilities of the contexts one byte longer, by node."""
    contexts, row = np.unique(cells >> 9, return_inverse=True)
    both = np.zeros((len(contexts), 512))
    np.add.at(both, (row, cells & 511), values)
    return contexts, both[:, 256:], both[:, :256]


def context_table(counts: DataFrame, depth: int) -> DataFrame:
    """(key, n, log) of each context and byte: log10 probability of the byte."""
    spark, top = counts.sparkSession, min(depth, 3)
    pairs = counts.where("not word").select("key", "n", F.shiftrightunsigned("key", 8 * (depth - top + 1)).alias("last"))
    groups = max(1, -(-pairs.count() // GROUP))

    def fixed(values: np.ndarray) -> pa.Array:
        """Rows as binary values."""
        rows = np.ascontiguousarray(values)
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * rows[:1].nbytes), pa.py_buffer(rows)]).cast(pa.binary())

    def grow(table: pa.Table) -> pa.Table:
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        probability, cell, value = subtree(key, n, depth, top)
        none = len(cell)
        return pa.table({"key": pa.array(np.append(key, cell)), "n": pa.concat_arrays([pa.array(n), pa.nulls(none, pa.int64())]), "bits": pa.concat_arrays([fixed(probability), pa.nulls(none, pa.binary())]), "value": pa.concat_arrays([pa.nulls(len(key), pa.float64()), pa.array(value)])})

    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("last"), F.lit(groups)))
    grown = cut(dealt.groupBy("part").applyInArrow(grow, "key long, n long, bits binary, value double"))
    cells = grown.where("n is null").groupBy("key").agg(F.sum("value").alias("value"))

    def shorter(table: pa.Table) -> pa.Table:
        """For contexts of two bytes that share the last: estimates (nan: not seen) and shares of their nodes, and their own cells for that byte."""
        contexts, seen, longer = spelled(table.column("key").to_numpy(), table.column("value").to_numpy())
        d2 = Depth(seen, longer)
        held = np.concatenate([np.where(d2.seen, d2.estimate, np.nan), d2.share], axis=1).astype(np.float32)
        cell = (contexts[0] >> 8 << 9) | np.arange(512)
        value = np.append(d2.weighted.sum(axis=0), seen.sum(axis=0))
        return pa.table({"key": pa.array(np.append(contexts, cell)), "bits": pa.concat_arrays([fixed(held), pa.nulls(512, pa.binary())]), "value": pa.concat_arrays([pa.nulls(len(contexts), pa.float64()), pa.array(value)])})

    pair = (np.zeros(0, np.int64), np.zeros((0, 512), np.float32))
    if top == 3:
        # at most 256 contexts of two bytes share the last one
        twos = cut(cells.groupBy(F.shiftright("key", 17).alias("one")).applyInArrow(shorter, "key long, bits binary, value double"))
        found = twos.where("bits is not null").select("key", "bits").toArrow().sort_by("key").combine_chunks()
        if len(found):
            pair = found.column("key").to_numpy(), bytesk.column(found.column("bits"))[0].view(np.float32).reshape(-1, 512)
        cells = twos.where("bits is null").select("key", "value")
    ones = cells.toArrow()  # at most 256 contexts of one byte
    last, seen, longer = spelled(ones.column("key").to_numpy(), ones.column("value").to_numpy())
    sums = np.zeros((256, 512))
    sums[last] = np.concatenate([seen, longer], axis=1)
    d1 = Depth(sums[:, :256], sums[:, 256:])
    root = Depth(sums[:, :256].sum(axis=0, keepdims=True), d1.weighted.sum(axis=0, keepdims=True))
    short, whole = [], []
    for e0, e1 in ((1 - root.estimate, 1 - d1.estimate), (root.estimate, d1.estimate)):
        short.append(np.where(d1.seen, root.share * e0 + (1 - root.share) * e1, e0))
        whole.append(root.share * e0 + (1 - root.share) * d1.share * e1)
    held = spark.sparkContext.broadcast((np.array(short), np.array(whole), (1 - root.share) * (1 - d1.share), *pair))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, whole, left, contexts, two = held.value
        for batch in batches:
            data, _ = bytesk.column(batch.column(2))
            bits = data.view(np.float32).reshape(-1, 8).astype(float)
            key = batch.column(0).to_numpy()
            byte, last, log = key & 255, key >> 8 * depth, np.zeros(len(key))
            at = np.searchsorted(contexts, key >> 8 * (depth - 1))
            for k in range(8):
                node, bit, p = (256 | byte) >> (8 - k), byte >> (7 - k) & 1, bits[:, k]
                if top == 3:
                    one, share = two[at, node].astype(float), two[at, 256 + node]
                    own = np.where(bit, one, 1 - one)
                    p = np.where(np.isnan(p), own, share * own + (1 - share) * p)
                log += np.log10(np.where(np.isnan(p), short[bit, last, node], whole[bit, last, node] + left[last, node] * p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log.astype(np.float32))], names=["key", "n", "log"])

    return grown.where("n is not null").select("key", "n", "bits").mapInArrow(finish, "key long, n long, log float")


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", top_words: int = TOP_WORDS, depth: int = DEPTH, top_contexts: int = TOP_CONTEXTS) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows whose crc32 of the id as text is divisible by 10 are held out and not learned from; a null
    id counts as the empty text and is held out. Null and empty texts have one token and one byte,
    the end. With nothing to learn from, base_score is 0 and each byte costs eight bits. Repeated
    rows are learned from and scored one by one. An empty table gives no rows. depth: bytes of context.
    """
    if not 2 <= depth <= DEEPEST:
        raise ValueError(f"depth is from 2 to {DEEPEST}")
    spark = docs.sparkSession
    small_batches(spark)
    crc = F.crc32(F.coalesce(named(doc_id).cast("string"), F.lit("")).cast("binary"))
    base = docs.select(named(doc_id).cast("long").alias("doc_id"), (crc % 10 == 0).alias("held_out"), named(text).alias("text"))
    counts = cut(corpus_counts(base, depth))
    vocabulary = counts.where("word").select("key", "n")
    total, distinct, ends = vocabulary.agg(F.sum("n"), F.count("n"), F.max(F.when(F.col("key") == int(END_WORD), F.col("n")))).first()
    total, distinct = total or 0, distinct or 0
    scale = float(np.log10(total + 0.1 * (distinct + 1)))
    top = vocabulary.orderBy(F.desc("n"), "key").limit(top_words).toArrow()
    ordered = lambda t, log: (lambda o: (t.column("key").to_numpy()[o], log[o]))(np.argsort(t.column("key").to_numpy()))
    held = spark.sparkContext.broadcast(ordered(top, np.log10(top.column("n").to_numpy() + 0.1) - scale))
    # contexts by how often they were seen, in steps of an eighth of a doubling: the commonest steps that top_contexts holds
    contexts = context_table(counts, depth).withColumn("step", F.floor(8 * F.log2(F.col("n") + 1.0)))
    steps, least, room = contexts.groupBy("step").count().orderBy(F.desc("step")).collect(), None, top_contexts
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    common = contexts.where(F.lit(False) if least is None else F.col("step") >= least).select("key", "log").toArrow()
    model = spark.sparkContext.broadcast(ordered(common, common.column("log").to_numpy().astype(np.float32)))
    end_log = float(np.log10((ends or 0) + 0.1)) - scale

    names, of_text = ["doc_id", "print", "word", "key", "times", "of_text"], ["held_out", "n_tokens", "n_known", "base", "score", "n_bytes"]
    kind = "struct<held_out:boolean,n_tokens:long,n_known:long,base:double,score:double,n_bytes:long>"
    arrow = pa.struct([pa.field(n, t) for n, t in zip(of_text, (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what the broadcast tables give, and rows for what they don't hold."""
        for batch in batches:
            data, off = bytesk.column(batch.column(3))
            for i, j in ((a, min(a + 256, to)) for start, to in bytesk.slices(off) for a in range(start, to, 256)):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                keys, first = word_keys(part, o)
                sums, more = [np.diff(first) + 1], []
                for word, keys, ends_ in ((True, keys, np.diff(first)), (False, coded(part, o, depth)[0], np.diff(o) + 1)):
                    row, times, distinct, of = grouped(keys, np.repeat(np.arange(j - i), ends_), word)
                    hit, logs = lookup(distinct, *(held if word else model).value)
                    hit = hit[of]
                    if word:
                        sums.append(np.bincount(row, times * hit, minlength=j - i).astype(np.int64) + bool(ends))
                    sums.append(np.bincount(row, times * logs[of], minlength=j - i) + (end_log if word else 0.0))
                    more.append((word, row[~hit], distinct[of[~hit]], times[~hit]))
                sums.append(np.diff(o) + 1)
                one = lambda c, i=i, j=j, batch=batch: batch.column(c).slice(i, j - i)
                # word is null, so that no key joins these
                yield pa.RecordBatch.from_arrays([one(0), one(1), pa.nulls(j - i, pa.bool_()), one(1), pa.array(np.zeros(j - i, np.int64)), pa.StructArray.from_arrays([one(2), *map(pa.array, sums)], fields=list(arrow))], names=names)
                for word, row, keys, times in more:
                    if len(row):
                        at = pa.array(row)
                        yield pa.RecordBatch.from_arrays([one(0).take(at), one(1).take(at), pa.array(np.full(len(row), word)), pa.array(keys), pa.array(times), pa.nulls(len(row), arrow)], names=names)

    marked = base.select("doc_id", F.xxhash64("text").alias("print"), "held_out", "text")
    scored = marked.mapInArrow(score, f"doc_id long, print long, word boolean, key long, times long, of_text {kind}")
    values = vocabulary.select(F.lit(True).alias("word"), "key", (F.log10(F.col("n") + 0.1) - scale).alias("value"))
    if room < 0:
        less = contexts if least is None else contexts.where(F.col("step") < least)
        values = values.unionAll(less.select(F.lit(False), "key", F.col("log").cast("double")))
    value = F.col("times") * F.coalesce("value", F.log10(F.lit(0.1)) - scale)
    known = F.when(F.col("word") & F.col("value").isNotNull(), F.col("times"))
    once = [F.first(f"of_text.{c}", ignorenulls=True).alias(c) for c in of_text]
    more = [F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (("more_known", known), ("more_base", F.when(F.col("word"), value)), ("more_score", F.when(~F.col("word"), value)))]
    df = scored.join(values, ["word", "key"], "left").groupBy("doc_id", "print").agg(F.count("of_text").alias("rows"), *once, *more)
    # rows that repeat have all been summed, and share alike
    df = df.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    total_score = F.col("score") + F.col("more_score") / F.col("rows")
    return df.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.expr("more_known div rows")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("more_base") / F.col("rows")).alias("base_score"), total_score.alias("score"), (-total_score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
