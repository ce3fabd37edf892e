"""The structure of a page for a model to read: noise out, telling attributes and class names kept, repeats and depth limited."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql.functions import pandas_udf

from .clean import drop, glued_text, hidden, live, spaced_text, within
from .dom import Node, parse

#: Tags, words in class or id, attributes and parts of class names that decide what is left.
NOISE_TAGS = (
    "script", "style", "iframe", "noscript", "nav", "form", "button", "input", "select", "textarea", "svg", "canvas", "video", "audio",
)
NOISE_WORDS = (
    "adv", "adRenderer", "medyanet", "dfp", "adservice", "advertisement", "banner", "sponsor", "promo", "cookie", "popup", "modal", "overlay", "gdpr",
    "social-share", "share-bar", "newsletter", "related-articles", "recommended",
)
DATA_ATTRS = (
    "data-testid", "data-trackable", "data-type", "data-component", "data-widget", "data-id", "data-module", "data-section", "data-block", "data-article",
)
STAY_EMPTY = (
    "h1", "h2", "h3", "h4", "h5", "h6", "main", "article", "section", "header", "p", "time", "figure", "figcaption", "address",
)
UNITS = (
    "px", "rem", "em", "vh", "vw", "%", "pt", "ch", "ex", "fr", "deg",
)
UTILITY = (
    "flex", "box", "width", "height", "col", "row", "gap", "font", "text", "bg", "color", "opacity", "shadow", "border", "rounded", "transition",
    "transform", "display", "position", "overflow", "cursor", "align", "justify", "layout",
)
SHORT_WORDS = (
    "text", "body", "main", "col", "row", "nav", "tag", "date", "img", "btn", "top", "sub", "box", "bar", "tab", "bio", "map", "by", "list", "all", "for",
    "new", "set", "get", "use", "add", "app", "end", "rich", "open", "left", "read", "dark", "hide", "show", "next", "prev", "last", "item", "card",
    "hero", "page", "link", "wrap", "ads", "cta", "src", "alt", "rel", "ref", "wp", "name", "post", "type", "form", "data", "grid", "side", "full",
    "meta", "info", "user", "logo", "icon", "feed", "more", "back", "site", "head", "foot", "menu", "tags", "cats", "byline", "author", "b", "t", "x",
    "y",
)
NAMESPACES = (
    "c", "l", "u", "o", "t", "is", "has", "js", "qa",
)
REPEATABLE = frozenset("p td tr dd dt blockquote figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("span div li td time small cite address a p figcaption blockquote".split())
WITH_TEXT = frozenset(("text_included", "enriched", "hybrid"))
SIZED = frozenset(("enriched", "hybrid"))
SHORT = 80
_UNIT = re.compile(r"\d+(?:\.\d+)?(?:" + "|".join(map(re.escape, UNITS)) + r")$")


def generated(part: str) -> bool:
    """Whether a short piece looks like a hash: digits, several capitals inside, or hardly a vowel."""
    letters = [c for c in part if c.isalpha()]
    vowels = sum(c in "aeiouAEIOU" for c in letters)
    unspoken = len(part) <= 6 and bool(letters) and vowels < 0.25 * len(letters)
    return part.isalnum() and len(part) <= 7 and (unspoken or any(map(str.isdigit, part)) or sum(map(str.isupper, part[1:])) >= 2)


#: What a piece of a class name tells, by the first of these that holds.
PIECE_RULES = (
    (lambda p: p[:1] in ("", "_"), False),
    (lambda p: p in SHORT_WORDS, True),
    (generated, False),
    (lambda p: p.lower() != p or _UNIT.match(p.strip("[]")), True),
    (lambda p: len(p) >= 5 and ("_" in p or p.isalpha()), True),
)


def telling(part: str) -> bool:
    """Whether a piece of a class name means something, rather than being generated."""
    return next((verdict for holds, verdict in PIECE_RULES if holds(part)), False)


def without_hash(token: str) -> str:
    """A name without a generated suffix behind two underscores."""
    hashed = re.fullmatch(r"(.+)__([^\W_]+)", token, re.DOTALL)
    return hashed[1] if hashed and not telling(hashed[2]) else token


def modified(token: str) -> str | None:
    """A name with a modifier, unless it modifies a utility; "" if it has none."""
    base, dashes, _ = token.partition("--")
    last = base[max(base.rfind("-") + 1, base.rfind("__") + 2 if "__" in base else 0) :]
    return "" if not dashes else None if base in UTILITY or last in UTILITY else token


def pieced(token: str) -> str | None:
    """The telling pieces of a name, in asterisks if others went; a short letter suffix stays."""
    parts = token.split("-")
    stays = [telling(p) for p in parts]
    if not any(stays) or all(stays):
        return token if all(stays) else None
    stays[-1] = stays[-1] or len(parts[-1]) <= 2 and parts[-1].isalpha()
    return "*" + "-".join(p for p, ok in zip(parts, stays, strict=True) if ok) + "*"


def class_token(token: str) -> str | None:
    """A class name as it is, in asterisks what is left of it without generated pieces, or None."""
    token = without_hash(token)
    with_modifier = modified(token)
    if with_modifier != "":
        return with_modifier
    grid = re.match(r"[a-z]{1,3}-\d{1,4}$", token)
    return token if grid or "-" in token and token.split("-")[0] in NAMESPACES else pieced(token)


def count(n: Node, *tags: str) -> int:
    return sum(1 for x in n.elements() if x is not n and (not tags or x.tag in tags))


def remove_noise(root: Node) -> None:
    drop(root, lambda n: n.tag in NOISE_TAGS)

    def named_noise(n: Node) -> bool:
        name = (" ".join(n.classes()) + " " + n.attrs.get("id", "")).lower()
        return any(w in name for w in NOISE_WORDS) and len(glued_text(n)) <= 500

    drop(root, named_noise)
    drop(root, lambda n: n.tag in ("header", "footer", "aside") and not within(n, "article", "main"))
    drop(root, lambda n: n.tag == "article" and not count(n, "p"))
    drop(root, lambda n: not {"fixed", "sticky", "hidden"}.isdisjoint(n.classes()))
    drop(root, hidden)

    def menu(n: Node) -> bool:
        items = [c for c in n.children if c.tag == "li"]
        links = sum(any(x.tag == "a" for x in c.children) for c in items)
        return len(items) >= 5 and links / len(items) >= 0.8

    drop(root, lambda n: n.tag == "ul" and not within(n, "article") and menu(n))
    articles = [n for n in root.elements() if n.tag == "article"]
    if len(articles) == 1:  # what stands beside the only article and looks like a list of others
        size = count(articles[0])
        for n in articles[0].siblings():
            inside = count(n)
            if n is not articles[0] and inside >= 20 and (count(n, "a") > 10 or count(n, "h3", "h4", "h5") > 5 or inside > 2 * size):
                n.detach()


def keep_attributes(root: Node, mode: str) -> None:
    for n in root.elements():
        kept = {}
        if n.attrs.get("id") and not re.search(r"\d{5,}", n.attrs["id"]):
            kept["id"] = n.attrs["id"]
        names = [t for c in n.classes() if (t := class_token(c)) is not None]
        if names:
            kept["class"] = " ".join(names)
        kept |= {a: n.attrs[a] for a in DATA_ATTRS if n.attrs.get(a)}
        if n.tag == "img" and mode in SIZED:
            size = {a: n.attrs[a] for a in ("width", "height") if n.attrs.get(a)}
            named = None if size else re.search(r"(\d{3,4})[xX](\d{3,4})(?:[/_.]|$)", n.attrs.get("src", ""))
            kept |= {"width": named[1], "height": named[2]} if named else size
        n.attrs = kept


def limit_depth(root: Node, most: int) -> int:
    gone = 0
    level = [root]
    for depth in range(most + 1):
        below = [c for n in level for c in n.children if c.is_element]
        if depth == most:
            for c in below:
                c.detach()
            gone = len(below)
        level = below
    return gone


def limit_siblings(root: Node, most: int) -> int:
    gone = 0
    for parent in live(root):
        seen: Counter = Counter()
        extra = []
        for c in parent.children:
            if not c.is_element or c.tag in REPEATABLE or c.attrs.get("id") or c.tag == "li" and within(c, "article", "main"):
                continue
            key = c.tag, tuple(sorted(c.classes()))
            seen[key] += 1
            if seen[key] > most and len(glued_text(c)) <= 200:
                extra.append(c)
        for c in extra:
            c.detach()
        gone += len(extra)
    return gone


def note_gone(parent: Node, tag: str) -> None:
    """The comment on a parent that lists the tags it has lost."""
    for c in parent.children:
        if c.tag == "#comment" and c.data.strip().startswith("contains:"):
            names = [t.strip() for t in c.data.strip()[len("contains:") :].split(",")]
            if tag not in names:
                c.data = f" contains: {', '.join([*names, tag])} "
            return
    parent.add(Node("#comment", data=f" contains: {tag} "))


def remove_empty(root: Node, mode: str) -> None:
    """Until nothing changes: elements without content, name or text go, and are noted on their parent."""
    changed = True
    while changed:
        changed = False
        for n in live(root):
            named = any(n.attrs.get(a) for a in ("class", "id", *DATA_ATTRS))
            sized = n.tag == "img" and mode in SIZED and ("width" in n.attrs or "height" in n.attrs)
            if n.tag in STAY_EMPTY or named or sized or any(c.tag is not None for c in n.children) or mode in WITH_TEXT and glued_text(n):
                continue
            parent = n.parent
            n.detach()
            note_gone(parent, n.tag)
            changed = True


def render(n: Node, mode: str, indent: int = 0) -> list[str]:
    pad, out = "  " * indent, []
    for c in n.children:
        if not c.is_element:
            if c.tag is None and mode in WITH_TEXT and n.tag in TEXT_TAGS and 0 < len(c.data.strip()) <= SHORT:
                out.append(pad + c.data.strip())
            continue
        attrs = "".join(f' {a}="{c.attrs[a]}"' for a in ("id", "class", *DATA_ATTRS) if c.attrs.get(a))
        notes = [x.data.strip() for x in c.children if x.tag == "#comment"]
        note = f"<!-- {' '.join(notes)} -->" if notes else ""
        if c.tag == "img" and mode in SIZED:
            shown = "".join(f' {a}="{c.attrs[a]}"' for a in ("width", "height", "class") if c.attrs.get(a))
            out += [f"{pad}<img{shown}>"] if shown else []
        elif any(x.is_element for x in c.children):
            out += [f"{pad}<{c.tag}{attrs}>{note}", *render(c, mode, indent + 1), f"{pad}</{c.tag}>"]
        else:
            body = note
            text = spaced_text(c)
            if text and mode in WITH_TEXT:
                long = len(text) >= SHORT and c.tag not in HEADINGS
                if mode == "text_included" or c.tag in TEXT_TAGS and not long:
                    body = text
                elif c.tag in TEXT_TAGS:
                    body = text[:60].rstrip() + "…"
            out.append(f"{pad}<{c.tag}{attrs}>{body}</{c.tag}>")
    return out


@dataclass
class Skeleton:
    text: str
    node_count: int
    pruned_siblings: int
    pruned_depth: int


def skeleton(html: str, mode: str = "whitelist", max_depth: int = 16, max_siblings: int = 2) -> Skeleton:
    """The skeleton of a page; modes text_included, enriched and hybrid keep texts, the last two only short ones and sizes of images."""
    root = parse(html)
    remove_noise(root)
    keep_attributes(root, mode)
    if mode not in WITH_TEXT:
        for n in [x for x in root.walk() if not x.is_element and x.tag != "#root"]:
            n.detach()
    deep = limit_depth(root, max_depth)
    wide = limit_siblings(root, max_siblings)
    remove_empty(root, mode)
    return Skeleton("\n".join(render(root, mode)), count(root), wide, deep)


def skeleton_udf(mode: str = "whitelist", max_depth: int = 16, max_siblings: int = 2):
    """skeleton() over a column of pages."""

    @pandas_udf("text string, node_count long, pruned_siblings long, pruned_depth long")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vars(skeleton(p or "", mode, max_depth, max_siblings)) for p in pages], columns=["text", "node_count", "pruned_siblings", "pruned_depth"])

    return run
