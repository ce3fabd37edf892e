"""The language model with true bytes as context, deeper than three: against a plain version, by held-out texts, and with a table that is joined."""

import collections
import math
import zlib

import numpy as np
import texts

from fieldloom.llm import lm


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def plain(train, made, depth):
    """log10 probability of each text of made, node by node, contexts as byte strings."""

    def steps(t):
        raw = b"\xff" * depth + t.encode() + b"\xff"
        for k in range(depth, len(raw)):
            for b in range(8):
                yield raw[k - depth : k], (256 | raw[k]) >> (8 - b), raw[k] >> (7 - b) & 1

    counts, longer = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for t in train:
        for context, node, bit in steps(t):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
                if d:
                    longer[context[depth - d + 1 :], node].add(context[depth - d :])
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted = {}
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        e = own(*counts[context, node])
        weighted[context, node] = e if len(context) == depth else np.logaddexp(e, sum(weighted[c, node] for c in longer[context, node])) - math.log(2)

    def one(context, node, bit):
        p, left = 0.0, 1.0
        for d in range(depth + 1):
            c = counts.get((context[depth - d :], node), (0, 0))
            estimate = (c[bit] + 0.5) / (sum(c) + 1)
            if d == depth or (context[depth - d - 1 :], node) not in counts:
                return p + left * estimate
            share = math.exp(own(*c) - math.log(2) - weighted[context[depth - d :], node])
            p, left = p + left * share * estimate, left * (1 - share)

    return [sum(math.log10(one(*x)) for x in steps(t)) for t in made]


def test_deep_contexts_match_plain(spark):
    made = [(i, t or "") for i, t in texts.rows(5, 30) if t is None or len(t) < 400]
    assert any(held(i) for i, _ in made)
    for depth in (2, 6):
        expected = plain([t for i, t in made if not held(i)], [t for _, t in made], depth)
        for top in (1 << 21, 100, 0):
            found = {r.doc_id: r for r in lm.lm_scores(texts.table(spark, made), depth=depth, top_contexts=top).collect()}
            for (i, t), e in zip(made, expected, strict=True):
                assert abs(found[i].score - e) < 1e-3 * (1 + len(t)) ** 0.5


def test_what_longer_contexts_tell(spark):
    # what follows is told by the case, the digit or the character four bytes before it
    r = np.random.default_rng(8)
    pairs = [("Q1...", "left"), ("q1...", "rest"), ("Q2...", "moon"), ("漢...", "sand"), ("字...", "tree")]
    made = [(k, " ".join("".join(pairs[i]) for i in r.integers(0, 5, 40))) for k in range(120)]
    deep, short = ({x.doc_id: x.bits_per_byte for x in lm.lm_scores(texts.table(spark, made), depth=d).collect()} for d in (lm.DEEPEST, 3))
    assert all(deep[i] < 0.8 * short[i] for i, _ in made if held(i))


def test_contexts_are_bytes_themselves():
    part = np.frombuffer("aA1é".encode(), np.uint8)
    keys, begin = lm.coded(part, np.array([0, len(part)]), 6)
    raw = b"\xff" * 6 + bytes(part) + b"\xff"
    assert [int(k) for k in keys] == [int.from_bytes(raw[k : k + 6][::-1] + raw[k + 6 : k + 7]) for k in range(len(part) + 1)] and begin.tolist() == [0]
