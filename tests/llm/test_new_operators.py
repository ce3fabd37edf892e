"""Hard negatives, the Merkle manifest and decontamination against plain versions, on tables with odd rows."""

import math
import random
import zlib

import brute
import numpy as np
import pytest
import texts
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, merkle, negatives


def got(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def want(rows):
    return sorted(map(tuple, rows), key=repr)


# --- hard negatives ---


def vectors(seed, n=260, dims=6, copies=40):
    r = random.Random(seed)
    out = [(k, [r.gauss(0, 0.3) + (k % 3) * 0.2 for _ in range(dims)], r.randrange(4)) for k in range(n)]
    out += [(n + k, out[20][1], 1) for k in range(copies)]  # a vector with many copies: scores tie
    out += [(20, out[20][1], out[20][2]), (20, out[21][1], 1), (None, out[20][1], 1), (None, out[3][1], 2)]  # repeated and missing ids
    out += [(900, None, 1), (910, out[0][1], None), (920, [math.nan] * dims, 1), (930, [0.1, None, 0.2, 0.1, 0.0, 0.1], 1), (940, [math.inf] * dims, 1), (950, [], 2), (960, [1.5, 2.5], 3), (970, [3e4] * dims, 0), (980, [1e30] + [0.0] * (dims - 1), 0)]
    r.shuffle(out)
    return out


def plain_negatives(rows, every, k=5, m=10, low=30, high=90):
    rows = [(i, [max(-(1 << 24), min(1 << 24, math.floor(min(256 * x, 1e300)))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda s: sorted(s, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for a, (i, v, y) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(dot(v, w), j, z) for b, (j, w, z) in enumerate(rows) if b != a]
        for p, pid, _ in order(x for x in scored if x[2] == y)[:k]:
            fits = order(x for x in scored if x[2] != y and low * p <= 100 * x[0] <= high * p)[:m]
            out += [(i, pid, rank + 1, j, p, s) for rank, (s, j, _) in enumerate(fits)]
    return out


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize(("seed", "pack", "slack", "counters"), [(1, 8192, 32, 1 << 23), (2, 16, 0, 1 << 23), (3, 8192, 1, 1 << 10)])
def test_hard_negatives(spark, seed, pack, slack, counters, monkeypatch):
    monkeypatch.setattr(negatives, "COUNTERS", counters)  # fewer counters: more digits
    made = vectors(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in made], "vec_id long, embedding array<float>, label int, request string, n int").repartition(3)
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in made]
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, pack=pack, slack=slack)
    assert got(found, *NAMES) == want(plain_negatives(single, 10))


def test_hard_negatives_of_copies_alone(spark):
    """All scores tie, and so do the ids of many rows: keys are told apart to the last digit."""
    made = [(k % 7, [0.5, 0.25], k % 2) for k in range(300)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    found = negatives.hard_negatives(df, F.col("vec_id") == 3, window=(30, 100), slack=0)
    rows = got(found, *NAMES)
    score = 128 * 128 + 64 * 64
    assert len(rows) == sum(k % 7 == 3 for k in range(300)) * 5 * 10 and set(rows) == {(3, 0, r, 0, score, score) for r in range(1, 11)}


def test_hard_negatives_of_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert got(negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0), *NAMES) == []
    lone = spark.createDataFrame([(10, [1.0], 1)], empty.schema)
    assert got(negatives.hard_negatives(lone, F.col("vec_id") % 10 == 0), *NAMES) == []


# --- Merkle manifest ---


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    sized = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: brute.sha("".join(map(sized, r)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)

    def tree(nodes):
        """Root, siblings of each node from below, and how to fold."""
        steps = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for s, k in zip(steps, at, strict=True):
                run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
                s.append((run[: k % 8], run[k % 8 + 1 :]))
            nodes = [brute.sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
            at = [k // 8 for k in at]
        return nodes[0], steps

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in ordered[g]]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for r, steps in zip(ordered[g], trees[g][1], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            digest = leaf((*r[:4], r[4] and brute.lower(r[4]))) if changed else leaf(r)
            for left, right in steps + top:
                digest = brute.sha("".join([*left, digest, *right]))
            proof = "".join("".join(left + right) for left, right in steps + top)
            out.append((r[0], leaf(r), trees[g][0], root, proof, digest, digest == root))
    return out


def manifest_rows(spark, made, levels=4):
    df = spark.createDataFrame([(*r, "clash", 3, "x") for r in made], "doc_id long, source string, lang string, n_chars long, text string, key string, pos int, digest string").repartition(5)
    picked = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(df, tampered=picked, changes={"text": merkle.lowered(F.col("text"))}, levels=levels)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 1}, {"en": 300, "de": 65, None: 8, "": 3, "é": 2}, {f"l{k:03}": 1 + k % 3 for k in range(70)}, {}])
@pytest.mark.parametrize("levels", [4, 1])
def test_manifest(spark, sizes, levels):
    """Blocks of 4,096 nodes, and of eight: several rounds."""
    r = random.Random(str(sizes))
    made = [(r.randrange(1 << 40), r.choice([None, "a", "B"]), g, r.choice([None, 7]), r.choice([*texts.NASTY, f"Text {k}", f"lower {k}"])) for g, n in sizes.items() for k in range(n)]
    if len(made) > 100:
        made += made[:20] + [(None, "a", "en", None, "X"), (None, "a", "en", None, "X"), (made[0][0], "other", made[0][2], 1, "Other text")]
    df = manifest_rows(spark, made, levels)
    assert got(df, "doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified") == want(plain_manifest(made))


def test_proofs_verify_by_their_place(spark):
    made = [(k, "s", "en" if k % 3 else "de", k, f"Text {k}") for k in range(200)]
    for r in manifest_rows(spark, made).collect():
        at = [tuple(r["place"][:2]), tuple(r["place"][2:])]
        assert merkle.fold(r["leaf"].encode(), r["proof"].encode(), at).decode() == r["root"]
        assert merkle.fold(b"0" * 64, r["proof"].encode(), at).decode() != r["root"]


# --- decontamination ---


def plain_decontaminate(docs, items, window=10):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    asked = {}
    for i, t in items:
        w = word.findall(brute.lower(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            asked.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        found = list(word.finditer(brute.lower(t or "")))
        w = [m.group() for m in found]
        hit, named = [False] * len(w), set()
        for k in range(len(w)):
            for n in range(1, min(window, len(w) - k) + 1):
                if tuple(w[k : k + n]) in asked:
                    hit[k : k + n] = [True] * n
                    named |= asked[tuple(w[k : k + n])]
        spans, k = [], 0
        while k < len(w):
            if hit[k]:
                e = k
                while e + 1 < len(w) and hit[e + 1]:
                    e += 1
                spans.append((found[k].start(), found[e].end()))
                k = e
            k += 1
        out.append((i, len(w), sum(hit), sorted(str(x) for x in named if x is not None), spans))
    return out


@pytest.mark.parametrize(("seed", "pack"), [(1, 2 << 20), (2, 900), (3, 90)])
def test_decontamination(spark, seed, pack):
    r = random.Random(seed)
    made = texts.rows(seed, 60, ids=False)
    long = [t for _, t in made if t and len(t.split()) > 40]
    items = [(k, " ".join(r.choice(long).split()[5 : 5 + r.choice([2, 9, 10, 14, 30])])) for k in range(12)]
    items += [(100, None), (101, " .,;"), (102, "A"), (None, " ".join(long[0].split()[-12:])), (0, " ".join(long[1].split()[:11]).upper()), (103, "É ñ ß 漢字 😀")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in made], "doc_id long, text string, items string, hits int").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, window int")
    df = decontaminate.decontaminate(docs, bench, pack_bytes=pack)
    rows = [(x.doc_id, x.n_words, x.n_hit, x["items"], [tuple(s) for s in x.spans]) for x in df.collect()]
    assert want(rows) == want(plain_decontaminate(made, items))


def test_decontamination_of_empty_tables(spark):
    docs, none = texts.table(spark, texts.rows(1, 10)), spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r["items"] and not r.spans for r in decontaminate.decontaminate(docs, none).collect())
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "two")], "doc_id string, text string")
    bench = spark.createDataFrame([("q.1", "Two!")], "item_id string, text string")
    assert got(decontaminate.decontaminate(docs, bench), "doc_id", "n_hit", "items") == want([("a", 1, ["q.1"]), (None, 1, ["q.1"])])
    full = docs.selectExpr("doc_id", "'s' AS source", "'en' AS lang", "1L AS n_chars", "text")
    assert got(merkle.manifest(full), "doc_id", "verified") == want([("a", True), (None, True)])
