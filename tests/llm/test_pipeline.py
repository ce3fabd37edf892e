"""corpus_pipeline.run() against plain versions of its stages, each on what the stage before it left."""

import collections

import brute
import corpus_pipeline
import pytest
import texts


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Each stage's input and output rows, and run()'s rows."""
    at = tmp_path_factory.mktemp("sf")
    made = texts.rows(11, 260)
    texts.table(spark, [(i, (t or "") if t is None or len(t) < 200 else t) for i, t in made]).drop("row", "h1").write.parquet(f"{at}/documents.parquet")
    docs, stages = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(at))
        out.write.parquet(f"{at}/{name}")
        out = spark.read.parquet(f"{at}/{name}")
        stages[name] = docs, out
        docs = out
    return stages, corpus_pipeline.run(spark, str(at))


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(run):
    stages, _ = run
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.dtypes == before.dtypes, name


def test_quality_rules(run):
    before, after = run[0]["quality_rules"]
    kept = set(rows(after))
    assert kept and kept < set(rows(before))
    for _, t in kept:
        w = brute.WORD.findall(t)
        assert len(w) >= 50 and 100 * brute.repeat_words(w) <= 50 * len(w)


def test_exact_dedup(run):
    before, after = map(rows, run[0]["exact_dedup"])
    assert sorted(after) == sorted(before[k] for k, x in enumerate(brute.exact_dedup(before)) if x[3])


def test_near_duplicates(run):
    before, after = map(rows, run[0]["ngram_jaccard_join"])
    assert sorted(after) == sorted(r for r, (i, _, c) in zip(before, brute.components(before, 5, 80), strict=True) if i == c)
    assert len(after) < len(before)


def test_mixing(run):
    before, after = run[0]["mixing_sources"]
    sizes, taken = (collections.Counter() for _ in range(2))
    for df, n in ((before, sizes), (after, taken)):
        for r in df.collect():
            n[r.source] += len(brute.WORD.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    largest = max(len(brute.WORD.findall(t)) for _, t in rows(before))
    for s, target in zip(names, brute.targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True):
        assert abs(taken[s] - target) <= largest
    assert max(collections.Counter(rows(after)).values()) <= 3 and set(rows(after)) <= set(rows(before))


def test_packing_and_run(run):
    stages, whole = run
    before, after = stages["best_fit_packing"]
    per_doc = collections.Counter(i for i, _ in rows(before))
    firsts = collections.Counter(r.doc_id for r in after.where("piece = 0").collect())
    assert firsts == per_doc
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(whole) == key(after)


def test_empty_table_and_nulls(spark, tmp_path):
    docs = texts.table(spark, texts.rows(3, 40, ids=False)).drop("row", "h1")
    docs.where("false").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    long = spark.createDataFrame([(None, "A sentence of some words that says little. " * 30 + " " * 1_000_000 + "end", None, None, 5)], docs.schema)
    docs.union(long).coalesce(4).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert all(r.length >= 1 for r in out) and len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_hot_shingles_are_joined_in_parts(spark, monkeypatch):
    from fieldloom.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT", 8)
    made = [(k, " ".join(["one common passage of six words", f"and then a{k} b{k} c{k % 7} d{k % 5}"])) for k in range(120)] + texts.rows(4, 60)
    df = jaccard.jaccard_components(texts.table(spark, [(k, t) for k, (_, t) in enumerate(made)]), 3, 60, chunk_bytes=8_000, large_bytes=500)
    assert sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute.components([(k, t) for k, (_, t) in enumerate(made)], 3, 60))
