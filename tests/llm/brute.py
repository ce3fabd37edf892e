"""Plain versions of the operators, row by row and pair by pair, to hold results against."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def components_by_row(rows, k, percent):
    """(set size, index of the component's first row) of each row"""
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [(len(sets[i]), find(i)) for i in range(len(rows))]


def components(rows, k, percent):
    """(id, set size, smallest id) of each row"""
    found = components_by_row(rows, k, percent)
    ids = collections.defaultdict(list)
    for (i, _), (_, root) in zip(rows, found, strict=True):
        if i is not None:
            ids[root].append(i)
    return [(i, n, min(ids[root], default=None) if n else i) for (i, _), (n, root) in zip(rows, found, strict=True)]


def line_dedup(rows, min_chars=40, min_docs=5):
    lines = [(t or "").split("\n") for _, t in rows]
    key = lambda x: lower(x.strip(WS))
    holders = collections.defaultdict(set)
    for i, ls in enumerate(lines):
        for x in ls:
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = []
    for i, ls in enumerate(lines):
        kept = []
        for x in ls:
            held = holders.get(key(x), ())
            if len(held) < min_docs or rows[i][0] == max((rows[h][0] for h in held if rows[h][0] is not None), default=None):
                kept.append(x)
        out.append((rows[i][0], len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - length + 1):
                g = tuple(w[k : k + length])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def exact_dedup(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for k, n in enumerate(norm):
        groups[n].append(k)
    out = [None] * len(rows)
    for n, ks in groups.items():
        best = max(ks, key=lambda k: (len(rows[k][1] or ""), rows[k][0] is not None, -(rows[k][0] or 0)))
        for k in ks:
            out[k] = (rows[k][0], rows[best][0], len(ks), k == best, sha(n))
    return out


def targets(sizes, weights):
    """Shares of all sizes by weight, cut at 3 times a source's own and shared out again until none is above."""
    total, fixed = sum(sizes), {}
    while True:
        rest = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        w = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / w for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: 3.0 * sizes[i] for i in over}


def repeat_words(w):
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + d for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for d in range(3)})
