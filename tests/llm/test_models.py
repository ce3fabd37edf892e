"""The trained models: against plain versions, by held-out accuracy, and on odd rows."""

import collections
import math
import re
import zlib

import brute
import numpy as np
import texts

from fieldloom.llm import bytesk, lm, toxicity


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def base_scores(made):
    words = lambda t: brute.WORD.findall(brute.lower(t or "")) + [None]
    c = collections.Counter(w for i, t in made if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in made]


def test_base_scores(spark):
    for top in (1 << 19, 20):
        made = texts.rows(4, ids=False)
        found = sorted(map(tuple, lm.lm_scores(texts.table(spark, made), top_words=top).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=repr)
        expected = sorted(base_scores(made), key=repr)
        assert [x[:5] for x in found] == [x[:5] for x in expected]
        assert np.allclose([x[5] for x in found], [x[5] for x in expected])


def test_words_on_which_polynomial_hashes_collide(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    train, other = [i for i in range(40) if not held(i)][:2]
    found = {r.doc_id: r for r in lm.lm_scores(texts.table(spark, [(train, x), (other, "z"), (next(i for i in range(99) if held(i)), y)])).collect()}
    assert sorted(r.n_known for r in found.values()) == [1, 2, 2]


def plain_ctw(train, text):
    """log10 probability of text by weighting contexts of 0 to 3 bytes, each node looked up by itself."""
    counts = collections.Counter()

    def steps(t):
        raw = [255] * 3 + list(t.encode()) + [255]
        for k in range(3, len(raw)):
            kinds = tuple(raw[k - d] for d in (1, 2, 3))
            node = 1
            for b in range(7, -1, -1):
                bit = raw[k] >> b & 1
                yield kinds, node, bit
                node = 2 * node + bit

    for t in train:
        for kinds, node, bit in steps(t):
            for d in range(4):
                counts[kinds[:d], node, bit] += 1
    children = collections.defaultdict(set)
    for context, node, _ in counts:
        if context:
            children[context[:-1], node].add(context)

    def own(context, node):
        a, b = counts[context, node, 0], counts[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    cache = {}

    def weighted(context, node):
        if (context, node) not in cache:
            e = own(context, node)
            cache[context, node] = e if len(context) == 3 else np.logaddexp(e, sum(weighted(c, node) for c in children[context, node])) - math.log(2)
        return cache[context, node]

    def one(kinds, d, node):
        context = kinds[:d]
        a, b = counts[context, node, 0], counts[context, node, 1]
        p = (b + 0.5) / (a + b + 1)
        if d == 3 or kinds[: d + 1] not in children[context, node]:
            return p
        share = math.exp(own(context, node) - math.log(2) - weighted(context, node))
        return share * p + (1 - share) * one(kinds, d + 1, node)

    return sum(math.log10(p if bit else 1 - p) for kinds, node, bit in steps(text) for p in [one(kinds, 0, node)])


def test_context_tree_weighting(spark):
    made = [(i, t) for i, t in texts.rows(5, 30) if t is None or len(t) < 900]
    train = [t or "" for i, t in made if not held(i)]
    found = {r.doc_id: r for r in lm.lm_scores(texts.table(spark, made)).collect()}
    for i, t in made[:25] + [x for x in made if held(x[0])]:
        assert abs(found[i].score - plain_ctw(train, t or "")) < 1e-3 * (1 + len(t or "")) ** 0.5
        assert abs(found[i].bits_per_byte + found[i].score * math.log2(10) / (len((t or "").encode()) + 1)) < 1e-9


def test_block_probabilities():
    a, b = np.array([[0.0, 3, 1000, 7e7]]), np.array([[0.0, 2, 5, 1e3]])
    expected = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(a[0], b[0], strict=True)]
    assert np.allclose(lm.block(a, b)[0], expected, atol=1e-7)


def test_nothing_to_learn_from(spark):
    only_held = [(i, "some text") for i in range(200) if held(i)]
    for r in lm.lm_scores(texts.table(spark, only_held)).collect():
        assert (r.train_tokens, r.base_score, r.n_known) == (0, 0.0, 0) and abs(r.bits_per_byte - 8) < 1e-6
    assert lm.lm_scores(texts.table(spark, only_held).where("false")).collect() == []


def test_scores_separate_prose_from_noise(spark):
    rng = np.random.default_rng(3)
    prose = [(k, " ".join(rng.choice(["the", "river", "bends", "slowly", "under", "stone", "bridges"], 60))) for k in range(200)]
    noise = [(k, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300))) for k in range(1000, 1010)]
    found = {r.doc_id: r.bits_per_byte for r in lm.lm_scores(texts.table(spark, prose + noise)).collect()}
    assert max(found[k] for k, _ in prose if held(k)) < 1.5 < min(found[k] for k, _ in noise)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels.where("doc_id % 3 > 0")).collect()}
    assert len(found) == docs.count()
    rest = labels.where("doc_id % 3 = 0").collect()
    hit = [found[r.doc_id].toxic for r in rest if r.toxic]
    wrong = [found[r.doc_id].toxic for r in rest if not r.toxic]
    assert sum(hit) >= 0.8 * len(hit) and sum(wrong) <= 0.005 * len(wrong)
    for r in found.values():
        assert 0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) and r.severity >= r.p_toxic - 1e-9


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)) < 0.4
    latent = x @ np.array([3.0, 1.5, 0.0, -2.0]) + rng.logistic(size=3000)
    grades = (latent > 0.5).astype(int) + (latent > 2.5)
    row, column = np.nonzero(x)
    w, b = toxicity.fit(row, column, grades, 4, penalty=1e-5)
    assert np.allclose(w, [3, 1.5, 0, -2], atol=0.35) and np.allclose(b, [0.5, 2.5], atol=0.3)


def test_severity_tells_dense_from_mild_on_held_out_rows(spark):
    """The second threshold on labelled texts left out of the fit: graver texts hold a larger number of words that, by these labels, mark toxic texts."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels.where("doc_id % 3 > 0")).collect()}
    rest = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("doc_id", "text", "toxic").collect()
    words = lambda t: brute.WORD.findall(brute.lower(t))
    seen = {side: collections.Counter(w for r in rest if r.toxic == side for w in set(words(r.text))) for side in (0, 1)}
    n = collections.Counter(r.toxic for r in rest)
    marks = {w for w, k in seen[1].items() if k >= 5 and k / n[1] > 10 * (seen[0][w] + 0.5) / n[0]}
    hits = {g: [sum(w in marks for w in words(r.text)) for r in rest if r.toxic and found[r.doc_id].grade == g] for g in (1, 2)}
    assert min(map(len, hits.values())) >= 5 and np.median(hits[2]) >= 1.5 * np.median(hits[1])
    precision = [np.mean([r.toxic for r in rest if found[r.doc_id].grade == g]) for g in (1, 2)]
    assert precision[1] >= precision[0] - 0.02 and precision[1] > 0.95


def plain_toxicity(made, labels):
    """Severity, grade and probability of each text, features counted text by text and scored bucket by bucket."""
    n_of = lambda w, n: w.encode()[:n]

    def features(t):
        out = collections.Counter()
        for w in re.findall("[A-Za-z\x80-\U0010ffff]+", t or ""):
            for n in (5, 6, 7, 1 << 30):
                raw = np.frombuffer(n_of(brute.lower(w), n), np.uint8)
                h = int(bytesk.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) + n
                out[int(bytesk.mix(np.array([h % 2**64], np.uint64))[0]) % toxicity.BUCKETS] += 1
        return out

    known = [(i, features(t), labels[i]) for i, t in made if i in labels]
    n = collections.Counter(g > 0 for _, _, g in known)
    d = {side: collections.Counter(b for _, f, g in known for b in f if (g > 0) == side) for side in (True, False)}
    chosen, markers = [], set()
    for b in sorted(d[True] | d[False]):
        x, y = d[True][b], d[False][b]
        p = (x + y) / len(known)
        z = (x / n[True] - y / n[False]) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n[True] + 1 / n[False]))
        if x + y >= toxicity.MIN_DOCS and abs(z) >= toxicity.MIN_Z:
            chosen.append(b)
            if (x + 0.5) / (n[True] + 1) >= 10 * (y + 0.5) / (n[False] + 1):
                markers.add(b)
    top = max(g for _, _, g in known)
    grades = [g + (g > 0 and top == 1 and sum(k for b, k in f.items() if b in markers) >= toxicity.SEVERE) for _, f, g in known]
    pairs = [(r, chosen.index(b)) for r, (_, f, _) in enumerate(known) for b in sorted(f) if b in chosen]
    w, b = toxicity.fit(*map(np.array, zip(*pairs)), np.array(grades), len(chosen), levels=max(2, top))
    out = []
    for i, t in made:
        score = sum(w[chosen.index(x)] for x in features(t) if x in chosen)
        above = [1 / (1 + math.exp(-(score - e))) for e in b]
        steps = [x - y for x, y in zip([1, *above], [*above, 0], strict=True)]
        out.append((i, sum(above), steps.index(max(steps)), above[0]))
    return out


def test_toxicity_against_plain(spark):
    r = np.random.default_rng(12)
    common, bad = [f"{a}{b}en" for a in "bdfgklm" for b in "aeiou"], ["vile", "Wretchedness", "scumlike", "ünfit"]
    made, labels, grades = [], {}, {}
    for k in range(240):
        n = r.choice([0, 0, 3, 15])
        made.append((k, " ".join(r.permutation(np.concatenate([r.choice(common, 30), r.choice(bad, n)])))))
        if k % 4:
            labels[k], grades[k] = int(n > 0), int(n > 0) * (1 + int(n > 3) * 2)
    made += [(None, "vile vile vile"), (None, None), (900, ""), (901, "vile " * 400)]
    for known, top in ((labels, 2), (grades, 3)):
        table = spark.createDataFrame([*known.items()], "doc_id long, toxic int")
        found = sorted(map(tuple, toxicity.toxicity(texts.table(spark, made), table).select("doc_id", "severity", "grade", "p_toxic").collect()), key=repr)
        expected = sorted(plain_toxicity(made, known), key=repr)
        assert [(x[0], x[2]) for x in found] == [(x[0], x[2]) for x in expected]
        assert np.allclose([(x[1], x[3]) for x in found], [(x[1], x[3]) for x in expected], atol=1e-6)
        assert max(x[2] for x in found) == top and max(x[1] for x in found) <= top


def test_toxicity_takes_one_text_of_an_id_that_repeats(spark):
    docs = texts.table(spark, [(k % 3, f"text {k} " * 3) for k in range(60)])
    sample = toxicity.labelled_texts(docs, spark.createDataFrame([(0, 1), (0, 0), (2, -4), (7, 1)], "doc_id long, toxic int"), "text", "doc_id", "toxic", 10)
    assert sorted((r.id, r.grade) for r in sample.collect()) == [(0, 1), (2, 0)]


def test_toxicity_odd_rows(spark):
    made = texts.rows(6, 30, ids=False)
    docs = texts.table(spark, made)
    none = spark.createDataFrame([(1, None), (None, 1), (4, 0), (987654, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, none).collect()
    assert len(out) == len(made) and not any(r.toxic for r in out)
    assert toxicity.toxicity(docs.where("false"), none).collect() == [] == toxicity.toxicity(docs.where("false"), none.where("false")).collect()
