"""Cleaning pages before a model reads them: eight strategies over one tree, and the regex one as a column expression."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .dom import Node, parse

STRATEGIES = ("none", "raw_regex", "whitelist", "dom_formula", "dom_depth_abs", "dom_depth_rel", "entropy", "hybrid")
#: The tags that the whitelist keeps.
KEEP = frozenset("article main section header h1 h2 h3 h4 p a time figure figcaption ul ol li blockquote cite span div address img".split())
PLACEHOLDER = "[CONTENT]"
ELLIPSIS = "…"


@dataclass(frozen=True)
class Settings:
    """Weights of text share, length and depth; thresholds for a sentence, a fixed cut and a placeholder; the cut; least entropy."""

    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    thresholds: tuple[float, float, float] = (0.3, 0.5, 0.7)
    cut: int = 80
    min_entropy: float = 3.5


#: What the regex strategy takes out, in this order.
REMOVALS = [
    *[(rf"(?is)<{t}[^>]*>.*?</{t}>", "") for t in ("script", "style", "iframe")],
    (r"(?s)<!--.*?-->", ""),
    *[(rf"(?is)<{t}[^>]*>.*?</{t}>", "") for t in ("nav", "aside", "form", "noscript", "header")],
    (r'\s+on\w+="[^"]*"', ""), (r'\s+data-[^=]+="[^"]*"', ""), (r"\s{2,}", " "),
]


def raw_regex(html: Column) -> Column:
    """The regex strategy inside the query plan."""
    for pattern, by in REMOVALS:
        html = F.regexp_replace(html, pattern, by)
    return F.regexp_replace(html, r"^\s+|\s+$", "")


def spaced_text(n: Node) -> str:
    return " ".join(t for s in n.strings() if (t := s.strip()))


def glued_text(n: Node) -> str:
    return "".join(s.strip() for s in n.strings())


def attached(n: Node, root: Node) -> bool:
    while n.parent is not None:
        n = n.parent
    return n is root


def live(root: Node):
    """Elements as first found, without those that have been taken out since."""
    return (n for n in list(root.elements()) if attached(n, root))


def hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "")
    return "display:none" in style or "visibility:hidden" in style


def within(n: Node, *tags: str) -> bool:
    return any(a.tag in tags for a in n.ancestors())


def drop(root: Node, wanted) -> None:
    for n in live(root):
        if wanted(n):
            n.detach()


def prepare(root: Node) -> None:
    drop(root, lambda n: n.tag in ("script", "style", "iframe", "noscript"))
    for n in [x for x in root.walk() if x.tag == "#comment"]:
        n.detach()
    drop(root, hidden)


def replace_content(n: Node, text: str) -> None:
    for c in n.children:
        c.parent = None
    n.children = []
    n.add(Node(None, data=text))


def first_sentence(text: str, cut: int = 80) -> str:
    end = re.search(r"[.!?]", text)
    return text[: end.end()] if end else text[:cut] + ELLIPSIS


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def keep_known(root: Node, strict: bool) -> None:
    """Navigation goes, form controls dissolve; tags that aren't known dissolve too (strict) or lose their attributes."""
    drop(root, lambda n: n.tag in ("header", "footer", "aside") and not within(n, "article", "main"))
    for n in live(root):
        if n.tag in ("nav", "form", "menu"):
            n.detach()
        elif n.tag in ("button", "input", "select", "textarea") or strict and n.tag not in KEEP:
            n.unwrap()
        elif n.tag not in KEEP:
            n.attrs = {}


def by_score(root: Node, s: Settings, depth: str | None) -> None:
    """Shortens elements with text of their own, in document order; what has been shortened counts for those that follow."""
    level = lambda n: sum(1 for _ in n.ancestors())
    every = list(root.elements())
    deepest = max(map(level, every), default=1) if depth == "relative" else 1
    scale = math.log(max((len(glued_text(n)) for n in every), default=1) + 1)
    for n in live(root):
        if not "".join(c.data for c in n.children if c.tag is None).strip():
            continue
        text = spaced_text(n)
        if not text:
            continue
        down = 0.0
        if depth:
            d = level(n)
            down = 1 / ((d / deepest if depth == "relative" and deepest else d) + 1)
        parts = (len(text) / len(n.to_html()), math.log(len(text) + 1) / scale if scale else 0.0, down)
        score = sum(w * p for w, p in zip(s.weights, parts, strict=True))
        rank = sum(score >= t for t in s.thresholds)
        if rank:
            replace_content(n, (first_sentence(text), text[: s.cut] + ELLIPSIS, PLACEHOLDER)[rank - 1])


def by_entropy(root: Node, s: Settings) -> None:
    for n in live(root):
        text = spaced_text(n)
        if len(text) >= 20 and entropy(text) < s.min_entropy:
            replace_content(n, PLACEHOLDER)


def clean(html: str, strategy: str = "dom_formula", settings: Settings = Settings()) -> str:
    """The page cleaned by a strategy; ValueError for an unknown one."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}; one of {', '.join(STRATEGIES)}")
    if strategy == "none":
        return html
    if strategy == "raw_regex":
        for pattern, by in REMOVALS:
            html = re.sub(pattern, by, html)
        return html.strip()
    root = parse(html)
    prepare(root)
    if strategy in ("whitelist", "hybrid"):
        keep_known(root, strategy == "whitelist")
    elif strategy == "entropy":
        by_entropy(root, settings)
    else:
        by_score(root, settings, {"dom_formula": None, "dom_depth_abs": "absolute", "dom_depth_rel": "relative"}[strategy])
    return root.to_html()


def clean_udf(strategy: str):
    """clean() over a column of pages."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")

    @pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else clean(p, strategy))

    return run
