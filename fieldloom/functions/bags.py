"""Scores of words as plain functions: what a task needs for texts that it holds already, without pandas."""

from __future__ import annotations

import re
from collections import Counter

#: What ``metrics.BLANKS`` matches, in Python, whose own \s has four control characters more; and a word of the ROUGE scores.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD = re.compile(r"\w+", re.ASCII)


def bag_f1(x: str | None, y: str | None) -> float:
    """ROUGE-1 F1 of two texts: words in lower case, as bags; 0 if either has none."""
    p, q = (x or "").lower().split(), (y or "").lower().split()
    if not p or not q:
        return 0.0
    return 1.0 if p == q else 2 * (Counter(p) & Counter(q)).total() / (len(p) + len(q))


def score_of(gt: list[str], pred: list[str], metric: str | None) -> float | None:
    """``metrics.raw_score`` in Python, for values that are there already."""
    if not gt:
        return None
    if not pred:
        return 0.0
    if metric == "jaccard":
        p, q = ({SPACES.sub("", v) for v in side} for side in (gt, pred))
        return len(p & q) / len(p | q)
    if metric == "exact_match":
        a, b = (SPACES.sub(" ", " ".join(side)).strip(" ") for side in (gt, pred))
        return 1.0 if a == b else 0.0
    return bag_f1(" ".join(gt), " ".join(pred))


def word_tokens(text: str | None) -> list[str]:
    """Runs of letters A to Z, digits and _, in lower case."""
    return [w.lower() for w in WORD.findall(text or "")]


def grams_f1(p: list[str], q: list[str], n: int) -> float:
    """F1 of bags of n-grams; both without any: 1."""
    x, y = (Counter(zip(*[t[i:] for i in range(n)], strict=False)) for t in (p, q))
    return 2 * (x & y).total() / (x.total() + y.total()) if x or y else 1.0


def lcs_f1(p: list[str], q: list[str]) -> float:
    """F1 of the longest common subsequence, whose table is a row of bits: a bit of the shorter list for each place where the row doesn't rise."""
    if not p or not q:
        return 1.0 if not p and not q else 0.0
    short, long = (p, q) if len(p) <= len(q) else (q, p)
    places: dict[str, int] = {}
    for i, w in enumerate(short):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(short)) - 1
    for w in long:
        if at := places.get(w):
            hit = row & at
            row = (row + hit | row - hit) & full
    return 2 * (len(short) - row.bit_count()) / (len(p) + len(q))
