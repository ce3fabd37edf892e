"""Operators against plain versions, on tables with nulls, blanks, ties, repeated rows and clashing names."""

import collections
import re

import brute
import numpy as np
import pytest
import texts
from pyspark.sql import functions as F

from fieldloom.llm import bytesk, components, exact, jaccard, lines, mixing, packing, quality, substring, tokens

SEEDS = [1, 2]


def got(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def want(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize(("words", "percent", "chunk"), [(4, 85, 4 << 20), (5, 80, 40_000), (3, 60, 20_000)])
def test_jaccard(spark, seed, words, percent, chunk):
    made = texts.rows(seed)
    df = jaccard.jaccard_components(texts.table(spark, made), words, percent, chunk_bytes=chunk, large_bytes=chunk // 2)
    assert got(df, "doc_id", "n_shingles", "component_id") == want(brute.components(made, words, percent))


def test_jaccard_chain_over_chunks(spark):
    """A chain in which each text is linked with the next ones only, in blocks of many chunks."""
    words = [f"w{k}" for k in range(400)]
    made = [(k, " ".join(words[k : k + 100])) for k in range(300)]
    df = jaccard.jaccard_components(texts.table(spark, made), 4, 85, chunk_bytes=60_000)
    assert got(df, "doc_id", "n_shingles", "component_id") == want((k, 97, 0) for k in range(300))


def plain_keep_one(made, words, percent):
    """How many rows of each (id, text) stay: one of a component, by id and whether there is one; and all rows without a shingle."""
    rows = brute.components_by_row(made, words, percent)
    stay = [made[i] for i, (n, _) in enumerate(rows) if not n]
    groups = collections.defaultdict(list)
    for i, (n, root) in enumerate(rows):
        if n:
            groups[root].append(made[i])
    return stay, [min((i is None, i or 0) for i, _ in g) for g in groups.values()]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_null_ids_and_repeated_rows(spark, seed):
    made = texts.rows(seed, 40, ids=False)
    r = np.random.default_rng(seed)
    made += [(made[r.integers(len(made))][0], made[r.integers(len(made))][1]) for _ in range(60)]  # ids with several texts, and texts with several ids
    made += [(None, made[r.integers(len(made))][1]) for _ in range(20)]
    df = jaccard.jaccard_components(texts.table(spark, made), 4, 85, chunk_bytes=20_000, large_bytes=10_000)
    assert got(df, "doc_id", "n_shingles", "component_id") == want(brute.components(made, 4, 85))
    kept = jaccard.keep_one(texts.table(spark, made), 4, 85)
    assert kept.columns == texts.table(spark, made).columns
    blank, firsts = plain_keep_one(made, 4, 85)
    rows = [(x.doc_id, x.text) for x in kept.collect()]
    full = [x for x in rows if brute.WORD.search(x[1] or "")]
    assert want(x for x in rows if x not in full) == want(blank)
    assert sorted((i is None, i or 0) for i, _ in full) == sorted(firsts)
    assert all(x in made for x in full)


def test_jaccard_links_through_rows_without_id_and_of_ids_with_several_texts(spark):
    words = [f"w{k}" for k in range(400)]
    near = lambda k, step=0: " ".join(words[k + step : k + step + 90])
    made = [(5, near(0)), (3, near(0, 3)), (5, near(200)), (4, near(200, 3)), (10, near(100)), (None, near(100, 6)), (11, near(100, 12)), (None, "alone but for this row"), (None, "alone but for this row"), (7, near(200)), (7, near(300))]
    df = jaccard.jaccard_components(texts.table(spark, made), 4, 85)
    expected = brute.components(made, 4, 85)
    assert got(df, "doc_id", "n_shingles", "component_id") == want(expected) and df.count() == len(made)
    assert [c for _, _, c in expected] == [3, 3, 4, 4, 10, 10, 10, None, None, 4, 7]
    kept = [(x.doc_id, x.text) for x in jaccard.keep_one(texts.table(spark, made), 4, 85).collect()]
    assert want(kept) == want([(3, near(0, 3)), (4, near(200, 3)), (10, near(100)), (None, "alone but for this row"), (7, near(300))])


def test_group_hashes_meet_whenever_sets_are_linked():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 150, 700, 3000]:
        for percent in (80, 85):
            a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, n - -(-percent * n // 100) + 1)
            left = rng.permutation(a)[drop:]
            add = (100 * len(left) - percent * n) // percent
            b = np.sort(np.concatenate([left, rng.integers(0, 1 << 63, max(0, add), dtype=np.uint64)]))
            known = jaccard.bands(percent, 2 * n)
            if jaccard.linked(a, b, percent):
                assert np.intersect1d(jaccard.group_hashes(a, percent, known), jaccard.group_hashes(b, percent, known)).size


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found.get(x, x) == find(x) for x in root)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("options", [{}, {"pack_bytes": 1, "shard_lines": 1}, {"min_chars": 4, "min_docs": 2, "shard_lines": 16, "pack_bytes": 300}])
def test_line_dedup(spark, seed, options):
    made = texts.rows(seed)
    rule = {k: options[k] for k in ("min_chars", "min_docs") if k in options}
    assert got(lines.line_dedup(texts.table(spark, made), **options), "doc_id", "n_lines", "n_dropped", "kept") == want(brute.line_dedup(made, **rule))


def test_minimal_perfect_hash():
    keys = bytesk.mix(np.arange(5000, dtype=np.uint64))
    levels, slots = lines.build(keys)
    assert sorted(slots) == list(range(5000))
    loaded = lines.load([{"shard": 0, "sizes": np.array([len(x) for x in levels]).tobytes(), "bits": np.concatenate(levels).tobytes(), "prints": b"", "largest": b""}])
    assert (lines.find(loaded[0][1], keys) == slots).all()


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize(("length", "gram"), [(50, 20), (12, 4), (5, 2)])
def test_substring_dedup(spark, seed, length, gram):
    made = texts.rows(seed)
    df = substring.substring_dedup(texts.table(spark, made, 3), length, gram)
    assert got(df, "doc_id", "n_words", "n_removed", "kept") == want(brute.substring_dedup(made, length))
    for r in df.collect():
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed


def test_substring_dedup_streams_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = texts.rows(9)
        df = substring.substring_dedup(texts.table(spark, made, 2), 8, 3)
        assert got(df, "doc_id", "n_words", "n_removed", "kept") == want(brute.substring_dedup(made, 8))
        df = jaccard.jaccard_components(texts.table(spark, made, 2), 4, 85)
        assert got(df, "doc_id", "n_shingles", "component_id") == want(brute.components(made, 4, 85))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("words", [1 << 20, 4])
def test_exact_dedup(spark, seed, words):
    made = texts.rows(seed, ids=seed == 1)
    df = exact.exact_dedup(texts.table(spark, made), ["doc_id", "row"], filter_words=words)
    found = got(df, "row.doc_id", "keep_id", "group_size", "kept", "text_sha256")
    expected = want(brute.exact_dedup(made))
    assert [x[:3] + x[4:] for x in found] == [x[:3] + x[4:] for x in expected]
    assert collections.Counter((x[4], x[3]) for x in found) == collections.Counter((x[4], x[3]) for x in expected)
    assert {r.row.row for r in df.collect()} == {"clash"}


def test_mixing(spark):
    made = texts.rows(1, ids=False)
    docs = texts.table(spark, made)
    out = mixing.mix(docs, docs.columns).collect()
    assert len(out) == len(made)
    sizes = collections.Counter()
    for r in out:
        assert r.size == len(brute.WORD.findall(r.row.text or "")) and r.taken == r.copies * r.size <= 3 * r.size and len(r.positions) == r.copies
        sizes[r.row.source] += r.size
    names = sorted(sizes, key=lambda s: (s is None, s))
    expected = dict(zip(names, brute.targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    for s in names:
        mine = [r for r in out if r.row.source == s]
        assert abs(mine[0].target - expected[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - expected[s]) <= max(r.size for r in mine)
        assert all(0 <= p <= 1 for r in mine for p in r.positions)
    again = mixing.mix(docs.repartition(3), docs.columns).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    rows = mixing.curriculum(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in out)


def test_mixing_caps_spread(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 5)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    expected = brute.targets([10, 1000, 0, 5], [5, 2, 1, 5])
    assert np.allclose([found["a"], found["b"], found["c"], found[None]], expected)


def test_curriculum_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(k, "w " * 10, s) for s in "abc" for k in range(300)], "doc_id long, text string, source string")
    out = mixing.mix(docs, ["source"], weights=(1, 1, 1)).collect()
    mean = {s: np.mean([p for r in out if r.row.source == s for p in r.positions]) for s in "abc"}
    assert mean["a"] > 0.55 and abs(mean["b"] - 0.5) < 0.01 and mean["c"] < 0.45


@pytest.mark.parametrize("seed", SEEDS)
def test_quality_base(spark, seed):
    made = texts.rows(seed, ids=False)
    df = quality.quality_rules(texts.table(spark, made))
    expected = []
    for i, t in made:
        w = brute.WORD.findall(t or "")
        seen = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        rep = brute.repeat_words(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(seen) - len(set(seen)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert got(df, "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want(expected)
    assert df.where("kept and base_failed").count() == 0


def test_js_distance(spark):
    p, q = [4.0, 0.0, 6.0], [1.0, 1.0, 2.0]
    row = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"), quality.js_distance(F.array(*map(F.lit, p)), F.array(*[F.lit(0.0)] * 3)).alias("none")).first()
    a, b = np.array(p) / 10, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    assert abs(row.d - np.sqrt((kl(a) + kl(b)) / 2)) < 1e-12 and row.none is None


def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("seed", SEEDS)
def test_packing(spark, seed):
    import zlib

    made = texts.rows(seed, ids=False) + [(9001, "some long words " * 1500)]
    tokenizer, length = hf(), 256
    expected = []
    for i, t in made:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % length or length
        for k, at in enumerate([0, *range(first, len(ids), length)]):
            part = ids[at : at + (first if k == 0 else length)]
            expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    df = packing.pack_documents(texts.table(spark, made), length=length, shard_rows=60).cache()
    assert got(df, "doc_id", "piece", "start", "length", "ids_crc32") == want(expected)
    places = collections.defaultdict(list)
    for r in df.collect():
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= length
    one = packing.pack_documents(texts.table(spark, made), length=length)
    assert one.select("sequence_id").distinct().count() <= 1.05 * sum(r.length for r in one.collect()) / length + 1


def test_sum_of_squares_rule():
    """Each choice of pack() is the best of all by the definition, recomputed from scratch."""
    rng = np.random.default_rng(1)
    lengths, capacity = rng.integers(1, 31, 200), 30
    sequence, offset = packing.pack(lengths, capacity)
    gaps = {}
    for i in np.argsort(-lengths, kind="stable"):
        ss = lambda g: sum(v * v for v in collections.Counter(x for x in g.values() if x).values())
        options = [ss(gaps | {s: g - lengths[i]}) for s, g in gaps.items() if g >= lengths[i]] + [ss(gaps | {"new": capacity - lengths[i]})]
        assert offset[i] == capacity - gaps.get(sequence[i], capacity)
        gaps[sequence[i]] = gaps.get(sequence[i], capacity) - lengths[i]
        assert gaps[sequence[i]] >= 0 and ss(gaps) == min(options)


@pytest.mark.parametrize("seed", SEEDS)
def test_section_tokens(spark, seed):
    made, tokenizer = texts.rows(seed, ids=False), hf()
    expected = []
    for i, t in made:
        t = t or ""
        e = tokenizer.encode(t, add_special_tokens=False)
        ends = [k + 1 for k, c in enumerate(t) if c == "\n"]
        ends = ends if ends and ends[-1] == len(t) else [*ends, len(t)]
        at = 0
        for k, end in enumerate(ends):
            mine = [(a, b) for a, b in e.offsets if at <= a < end or (a == b == end == at)]
            expected.append((i, k, end - at, len(mine), len(e.ids)))
            at = end
    assert got(tokens.section_tokens(texts.table(spark, made)), "doc_id", "section", "n_chars", "n_tokens", "doc_tokens") == want(expected)


def test_tokens_that_cross():
    inside, crossing = tokens.attribute(np.array([2, 3, 4, 1]), np.array([3, 6, 10]))
    assert inside.tolist() == [2, 1, 1] and crossing.tolist() == [1, 1, 0]


LONG = 2_000_000
RUNS = ["a lake " + " " * LONG + " froze", "\t" * LONG, "x" * LONG, "\n" * LONG + "end", "a" + "\u3000" * LONG, "1" * LONG, "-" * LONG + "<|endoftext|>", "Ab \n" * (LONG // 4)]


def test_long_runs(spark):
    """Texts of two million characters without a break, against the library the vocabulary file is made for."""
    import zlib

    expected = [[*hf().encode(t, add_special_tokens=False).ids, 0] for t in RUNS]
    docs = texts.table(spark, list(enumerate(RUNS)), 8)
    found = {r.doc_id: r for r in packing.pack_documents(docs, length=4 * LONG).collect()}
    assert [(found[k].length, found[k].ids_crc32) for k in range(len(RUNS))] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in expected]
    per_doc = tokens.section_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r.doc_id: (r.n, r.of) for r in per_doc} == {k: (len(x) - 1,) * 2 for k, x in enumerate(expected)}


def test_added_token_and_runs_have_the_ids_of_the_file():
    encode, sizes = tokens.encoder(tokens.vocabulary())
    rng = np.random.default_rng(4)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B ", " ", "\n", "<|endoftext|>", "é", "'s", "漢", "12", "\u3000", "\x1c", "<|"], rng.integers(1, 30)))
        ids = encode(t)
        assert ids == hf().encode(t, add_special_tokens=False).ids
        assert sizes[ids].sum() == len(t.encode())


def test_packing_ids_stay_whole_numbers(spark):
    made = [(9007199254740993, "a b"), (None, "c d"), (9007199254740995, "e f")]
    assert got(packing.pack_documents(texts.table(spark, made, 1)), "doc_id") == want([(i,) for i, _ in made])
    many = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    per_shard = packing.pack_documents(many, shard_rows=300).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(per_shard) == 10 and max(r["count"] for r in per_shard) < 500


def thue_morse(a, b, steps=11):
    """Two texts that every polynomial modulo 2 ** 64 with an odd base takes for one."""
    x, y = a, b
    for _ in range(steps):
        x, y = x + y, y + x
    return x, y


def test_texts_on_which_polynomial_hashes_collide(spark):
    x, y = thue_morse("a", "b")
    line = lines.line_dedup(texts.table(spark, [(k, (x, y)[k % 2]) for k in range(6)]))
    assert {r.n_dropped for r in line.collect()} == {0}
    near = jaccard.jaccard_components(texts.table(spark, [(k, (x, y)[k % 2]) for k in range(6)]))
    assert got(near, "doc_id", "component_id") == want((k, k % 2) for k in range(6))
    around = " ".join(f"w{k}" for k in range(30))
    sub = substring.substring_dedup(texts.table(spark, [(k, f"{around} {(x, y)[k]} {around}") for k in range(2)]))
    assert {r.n_removed for r in sub.collect()} == {0}
    u, v = thue_morse("p ", "q ")
    assert len({*bytesk.rolling(bytesk.span_hashes(np.frombuffer((u + v).encode(), np.uint8), *bytesk.words(np.frombuffer((u + v).encode(), np.uint8), np.array([0, 2 * len(u)]))[:2]), 2048)[[0, 2048]].tolist()}) == 2


def test_hashes_of_spans():
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in rng.integers(1, 40, 3000)]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = bytesk.words(raw, np.array([0, len(raw)]))
    found = collections.defaultdict(set)
    for w, h in zip(words, bytesk.span_hashes(raw, starts, ends).tolist(), strict=True):
        found[w].add(h)
    assert all(len(h) == 1 for h in found.values()) and len({h for x in found.values() for h in x}) == len(found)
    alone = [bytesk.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words[:200]]
    assert all(h in found[w] for w, h in zip(words, alone, strict=False))
    hashes = bytesk.span_hashes(raw, starts, ends)
    for k in (1, 2, 5, 20, 37):
        runs = bytesk.rolling(hashes, k)
        assert len(runs) == len(hashes) - k + 1 and runs[11] == bytesk.rolling(hashes[11 : 11 + k], k)[0]
    a, b = np.array([3, 700, 5]), np.array([90, 701, 2900])
    twice = np.concatenate([hashes[k:m] for k, m in zip(a, b, strict=True)])
    ends = np.cumsum(b - a)
    assert (bytesk.range_hashes(hashes, a, b) == bytesk.range_hashes(twice, ends - (b - a), ends)).all()


def test_mixing_spreads_rows_without_an_id(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w w "), "id").alias("text"), F.lit("a").alias("source"))
    out = mixing.mix(docs, ["text"]).collect()
    assert len(out) == 5000 and sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs.repartition(3), ["text"]).collect()))


def test_empty_table(spark):
    docs = texts.table(spark, texts.rows(1)).where("false")
    assert jaccard.jaccard_components(docs).collect() == jaccard.keep_one(docs).collect() == []
    assert lines.line_dedup(docs).collect() == substring.substring_dedup(docs).collect() == []
    assert exact.exact_dedup(docs, docs.columns).collect() == mixing.mix(docs, docs.columns).collect() == mixing.curriculum(docs).collect() == []
    assert quality.quality_rules(docs).collect() == packing.pack_documents(docs).collect() == tokens.section_tokens(docs).collect() == []


def test_columns_with_dots_and_backticks_in_their_names(spark):
    """Operators that carry rows through, one after the other as in the pipeline."""
    made = texts.rows(6, 60)
    docs = texts.table(spark, made).withColumnsRenamed({"row": "a.b", "h1": "c`d.e"})
    docs = docs.withColumn("a", F.struct(F.lit(1).alias("b")))
    df = quality.quality_rules(docs).select("row.*")
    df = exact.exact_dedup(df, df.columns).where("kept").select("row.*")
    df = mixing.curriculum(jaccard.keep_one(df))
    assert df.columns == docs.columns and {tuple(r) for r in df.select("`a.b`", "`c``d.e`", "a.b").collect()} == {("clash", 7, 1)}
    named = docs.withColumnsRenamed({"text": "the.text", "doc_id": "the.id", "source": "the.source", "lang": "the.lang"})
    assert got(quality.quality_rules(named, ["the.id"], text="the.text", lang="the.lang"), "row", "kept") == got(quality.quality_rules(docs, ["doc_id"]), "row", "kept")
    assert got(exact.exact_dedup(named, ["the.id"], text="the.text", doc_id="the.id"), "keep_id", "kept") == got(exact.exact_dedup(docs, ["doc_id"]), "keep_id", "kept")
    assert got(mixing.mix(named, ["the.id"], text="the.text", doc_id="the.id", source="the.source"), "row", "taken") == got(mixing.mix(docs, ["doc_id"]), "row", "taken")
    assert got(jaccard.jaccard_components(named, text="the.text", doc_id="the.id"), "doc_id", "component_id") == got(jaccard.jaccard_components(docs), "doc_id", "component_id")


def test_line_query_and_its_twin_count_rows_that_share_an_id(spark, tmp_path):
    from pathlib import Path
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import twins

    from fieldloom.llm.queries import QUERIES, SQL

    line = "This line of forty characters or more is found in many documents"
    rows = [(1, f"a\n{line}\nb"), (1, f"a\n{line}\nb"), (1, line), (2, f"{line}\nc"), (3, f"  {line.upper()}\n{line}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op3_line_dedup"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in found.collect()) == [(1, 1, 1), (1, 3, 1), (1, 3, 1), (2, 2, 1), (3, 2, 0)]
    c = twins.duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    b = c.sql(SQL["op3_line_dedup"]).df()
    assert twins.rows(found.toPandas(), sorted(b.columns)) == twins.rows(b, sorted(b.columns))
