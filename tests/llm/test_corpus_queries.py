"""The corpus queries against their DuckDB twins, and all of them for one row per document."""

import collections
import math
import sys
import zlib
from pathlib import Path

import brute
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import twins  # noqa: E402

from fieldloom.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, name):
    twins.assert_twins(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_every_document_is_there(spark, sf, name):
    ids = QUERIES[name](spark, sf).select("doc_id").distinct().count()
    assert ids == spark.read.parquet(f"{sf}/documents.parquet").count()


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_jaccard_query_against_brute_force(spark, sf):
    found = sorted(map(tuple, QUERIES["op2_ngram_jaccard_join"](spark, sf).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == sorted(brute.components(documents(spark, sf), 4, 85))


def test_packing_and_token_queries_against_the_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, ids, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, []
    for i, t in documents(spark, sf):
        ids[i] = tokenizer.encode(t or "", add_special_tokens=False).ids
        whole, at, piece = [*ids[i], 0], 0, 0
        while at < len(whole):
            n = len(whole) % 2048 or 2048 if not at else 2048
            expected.append((i, piece, at, n, zlib.crc32(np.array(whole[at : at + n], "<u4").tobytes())))
            at, piece = at + n, piece + 1
    rows = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in map(sorted, places.values()):
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    sections = QUERIES["op1_token_counts"](spark, sf).groupBy("doc_id").agg({"n_tokens": "sum", "n_chars": "sum"}).collect()
    assert {r.doc_id: (r["sum(n_tokens)"], r["sum(n_chars)"]) for r in sections} == {i: (len(ids[i]), len(t or "")) for i, t in documents(spark, sf)}


def test_language_model_query_base_scores(spark, sf):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    docs = documents(spark, sf)
    words = {i: [*brute.WORD.findall(brute.lower(t or "")), None] for i, t in docs}
    c = collections.Counter(w for i in words if not held(i) for w in words[i])
    n, v = sum(c.values()), len(c)
    for r in QUERIES["op10_lm_scoring"](spark, sf).collect():
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6 * len(w)
