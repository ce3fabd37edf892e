"""Running rules over pages: each page is parsed once, whatever the number of rules of its layout."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import css, dom, rx, xpath
from .functions.bags import score_of


def css_elements(tree: dom.Node, rule: str, merge: bool) -> list[dom.Node]:
    """Elements of all alternatives if they merge, else of the first one that has any."""
    if merge:
        return css.select(tree, rule)
    return next((found for part in css.split_selectors(rule) if (found := css.select(tree, part))), [])


def css_values(tree: dom.Node, rule: str, kind: str, merge: bool = False) -> list[str]:
    found = css_elements(tree, rule, merge)
    if kind in ("image", "url"):
        name = "src" if kind == "image" else "href"
        return [v for n in found if (v := n.attrs.get(name, "").strip())]
    return [t for n in found if (t := dom.visible_text(n))]


def xpath_values(tree: dom.Node, rule: str, kind: str) -> list[str]:
    """Strings as they are; of an element its text with what follows it, or its own or first inner image or link."""

    def value(x) -> str:
        if isinstance(x, (str, float, bool)):
            return xpath.to_string(x)
        if kind == "text":
            return dom.visible_text(x, tail=True)
        tag, name = ("img", "src") if kind == "image" else ("a", "href")
        own = (x.tag == tag or kind == "url") and x.attrs.get(name)
        if own or kind == "image" and x.tag == tag:
            return own or ""
        return next((d.attrs[name] for d in x.elements() if d.tag == tag and d.attrs.get(name)), "")

    return [v for x in xpath.evaluate(tree, rule) if (v := value(x).strip())]


class Page:
    """A page with its trees, built when first asked for."""

    def __init__(self, html: str | None):
        self.html = html or ""
        self.trees: dict[bool, dom.Node] = {}
        self.found: dict[tuple, list[str]] = {}

    def tree(self, implied: bool) -> dom.Node:
        if implied not in self.trees:
            self.trees[implied] = dom.parse(self.html, implied)
        return self.trees[implied]

    def values(self, rule: str | None, lang: str, kind: str = "text", merge: bool = False) -> list[str]:
        """What a rule finds; rules that several owners share run once. The list isn't to be changed."""
        key = (rule, lang, kind, merge)
        if key not in self.found:
            self.found[key] = self.evaluated(*key)
        return self.found[key]

    def evaluated(self, rule: str | None, lang: str, kind: str, merge: bool) -> list[str]:
        if not rule:
            return []
        if lang == "css":
            return css_values(self.tree(False), rule, kind, merge)
        if lang == "xpath":
            return xpath_values(self.tree(True), rule, kind)
        if lang == "regex":
            return rx.values(self.html, rule, kind)
        raise ValueError(f"unknown rule language: {lang}")


#: Rule rows that are sent to all tasks as they are; more are joined to the pages of their layout.
MAX_SENT = 100_000
#: Characters of pages, times their rules, whose results a task holds at once before it hands them on.
HELD_CHARS = 16 << 20
#: Bytes a core gets at least before pages are left in the partitions they came in.
SPREAD_BYTES = 64 << 20


def spread(pages: DataFrame) -> DataFrame:
    """pages in as many partitions as there are cores, if they are so few bytes that files alone would leave cores idle; larger inputs don't move."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    size = int(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return pages.repartition(cores) if size < cores * SPREAD_BYTES else pages


def over_rules(pages: DataFrame, rules: DataFrame, on: list[str], keep: list[str], kernel: Callable[[Page, list[tuple]], Iterable[tuple]], schema: str, html: str = "html") -> DataFrame:
    """What kernel gives for each page and the rules of its layout: the columns to keep, and those of schema.

    rules: the columns ``on`` that name a layout, and the kernel's columns in order. Rules are few as a rule: up to MAX_SENT go to
    all tasks once, and pages stay where they are. Results leave Python by HELD_CHARS, so that a task's memory doesn't grow with its batch. More are gathered per layout and joined to its pages. Only the columns
    needed go to Python, and html goes no further. Pages of layouts without rules give nothing.
    """
    own = [c for c in rules.columns if c not in on]
    few = rules.select(*on, *own).limit(MAX_SENT + 1).collect()
    n, k_on, sent = len(keep), len(on), None
    if len(few) <= MAX_SENT:
        sets: dict[tuple, list] = {}
        for r in few:
            sets.setdefault(tuple(r)[:k_on], []).append(tuple(r)[k_on:])
        sent = pages.sparkSession.sparkContext.broadcast({k: v for k, v in sets.items() if None not in k})
        work = spread(pages).select(*keep, F.col(html).alias("html"), *[F.col(c).alias(f"on_{c}") for c in on])
    else:
        each = rules.groupBy(*on).agg(F.collect_list(F.struct(*own)).alias("rules"))
        work = spread(pages).join(each, on).select(*keep, F.col(html).alias("html"), "rules")
    out = StructType([*pages.select(*keep).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def handed(batch: pa.RecordBatch, row: list[int], made: list[tuple]) -> pa.RecordBatch:
        at = pa.array(row, pa.int32())
        columns = zip(*made, strict=True) if made else [()] * (len(arrow) - n)
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(at).cast(arrow.field(k).type) for k in range(n)], *[pa.array(c, arrow.field(n + k).type) for k, c in enumerate(columns)]], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is None:
                listed = [[tuple(r.values()) for r in x] for x in batch.column(n + 1).to_pylist()]
            else:
                keys = zip(*[batch.column(n + 1 + k).to_pylist() for k in range(k_on)], strict=True)
                listed = [sent.value.get(k, []) for k in keys]
            row, made, held = [], [], 0
            for i, mine in enumerate(listed):
                if mine:
                    text = batch.column(n)[i].as_py()
                    made += kernel(Page(text), mine)
                    row += [i] * (len(made) - len(row))
                    held += len(text or "") * len(mine)
                if made and held >= HELD_CHARS:
                    yield handed(batch, row, made)
                    row, made, held = [], [], 0
            yield handed(batch, row, made)

    return work.mapInArrow(run, out)


def found_values(page: Page, rules: list[tuple]) -> Iterator[tuple]:
    """(rule_id, vals, ref_vals) for rules (rule_id, lang, kind, merge, rule, ref)."""
    vals = [page.values(rule, lang, kind, bool(merge)) for _, lang, kind, merge, rule, _ in rules]
    by_id = {r[0]: v for r, v in zip(rules, vals, strict=True)}
    return ((r[0], v, None if r[5] is None else by_id.get(r[5], [])) for r, v in zip(rules, vals, strict=True))


def scored_values(wanted: bool) -> Callable[[Page, list[tuple]], Iterator[tuple]]:
    """A kernel for rules (exp_id, field, metric, lang, kind, merge, rule, gt_rule), the last in CSS: exp_id, field, metric, how many values both sides have, the unrounded score, and if wanted the values."""

    def kernel(page: Page, rules: list[tuple]) -> Iterator[tuple]:
        for exp_id, field, metric, lang, kind, merge, rule, gt_rule in rules:
            gt, pred = page.values(gt_rule, "css", kind, bool(merge)), page.values(rule, lang, kind, bool(merge))
            yield exp_id, field, metric, len(gt), len(pred), score_of(gt, pred, metric), *((gt, pred) if wanted else ())

    return kernel


def rule_values(pages: DataFrame, rules: DataFrame, on: list[str], keep: list[str], html: str = "html") -> DataFrame:
    """A row per page and rule of its layout: the columns to keep, rule_id, vals (array of strings; empty if nothing matched), ref_vals.

    rules: the columns ``on`` that name a layout, rule_id, lang (css, xpath, regex), kind (text, image,
    url), merge, rule (null or empty finds nothing), and if wanted ref: another rule_id of the layout, whose values stand
    beside in ref_vals.
    """
    ref = F.col("ref") if "ref" in rules.columns else F.lit(None)
    flat = rules.select(*on, F.col("rule_id").cast("string").alias("rule_id"), "lang", "kind", "merge", "rule", ref.cast("string").alias("ref"))
    return over_rules(pages, flat, on, keep, found_values, "rule_id string, vals array<string>, ref_vals array<string>", html)


def catalyst_regex_values(html, pattern: str, group: int = 1):
    """The values of a pattern that Java reads as Python does, inside the query plan: no Python, no time limit; for patterns of one's own."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?is)" + pattern), F.lit(group)), html_to_text), lambda t: t != "")


def closed_references(html):
    """html as a column in which character references count with their semicolon only: one without (``&amp`` at the end of a cut title), which HTML would decode too, stays as it is written."""
    return F.regexp_replace(html, r"&(?=[A-Za-z#])(?!(?:[A-Za-z][A-Za-z0-9]*+|#[0-9]++|#[xX][0-9A-Fa-f]++);)", "&amp;")


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_to_text(fragment):
    """Text of a fragment as a column: the commonest entities only are decoded; ``rx.html_to_text`` knows all."""
    out = F.regexp_replace(F.regexp_replace(fragment, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
