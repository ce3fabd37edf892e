"""Exports of rules and values, report tables as CSV, Markdown and LaTeX, the data set card, and the manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import over_rules


def layout_documents(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """A row per layout: maps of selectors and metrics by field, and how many pages it has; rows as groundtruth.export_rows gives them. layout_pages has the pages, a row each."""
    as_map = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", v))))
    key = ["domain", "layout_id"]
    maps = rows.groupBy(*key, "layout_name", "page_type", "template_id").agg(as_map("selector").alias("selectors"), as_map("metric").alias("metrics"))
    return maps.join(scope.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pages")), key, "left").na.fill(0, ["n_pages"])


def layout_pages(scope: DataFrame) -> DataFrame:
    """The pages of layouts in order."""
    return scope.select("domain", "layout_id", "page").orderBy("domain", "layout_id", "page")


def page_documents(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per page of a layout with rules: the values of its fields as a map, made where the page is read, so that values don't shuffle and pages of one name have a row each.

    pages: domain, layout_id, page, html. rules: layout_id, field, kind, merge, rule (CSS).
    """

    def kernel(page, mine):
        yield (sorted((field, page.values(rule, "css", kind, bool(merge))) for field, kind, merge, rule in mine),)

    own = rules.select("layout_id", "field", "kind", "merge", "rule").dropDuplicates(["layout_id", "field"])
    return over_rules(pages, own, ["layout_id"], ["domain", "layout_id", "page"], kernel, "fields map<string, array<string>>")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _best(rows: list[dict], column: str, rule: str | None) -> set[int]:
    numbers = [(i, float(r[column])) for i, r in enumerate(rows) if isinstance(r[column], (int, float)) and not isinstance(r[column], bool)]
    if rule is None or len(numbers) < 2:
        return set()
    size = abs if rule == "absmin" else lambda v: v
    goal = (max if rule == "max" else min)(size(v) for _, v in numbers)
    return {i for i, v in numbers if size(v) == goal}


def render_table(df: DataFrame, best: dict[str, str] | None = None, style: str = "markdown", caption: str = "", most: int = 10_000) -> str:
    """A report table as text; best: column to max, min or absmin, whose cell is set bold. For report-sized frames: more than most rows raise ValueError."""
    if style not in ("csv", "markdown", "latex"):
        raise ValueError(f"unknown style: {style}")
    rows, names = [r.asDict() for r in df.limit(most + 1).collect()], df.columns
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    bold = {c: _best(rows, c, (best or {}).get(c)) for c in names}
    plain = lambda v: "" if v is None else str(v)
    if style == "csv":
        quoted = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s
        return "\n".join(",".join(quoted(plain(v)) for v in line) for line in [names, *[[r[c] for c in names] for r in rows]])
    if style == "markdown":
        cell = lambda v, b: f"**{v}**" if b else v.replace("|", "\\|")
        lines = [[cell(plain(r[c]), i in bold[c]) for c in names] for i, r in enumerate(rows)]
        return "\n".join("| " + " | ".join(x) + " |" for x in [names, ["---"] * len(names), *lines])
    safe = lambda s: "".join({"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}.get(c, c) for c in s)
    body = [" & ".join(rf"\textbf{{{safe(plain(r[c]))}}}" if i in bold[c] else safe(plain(r[c])) for c in names) + r" \\" for i, r in enumerate(rows)]
    kinds = "l" + "r" * (len(names) - 1)
    return "\n".join([r"\begin{table}", r"\centering", *([rf"\caption{{{safe(caption)}}}"] if caption else []), rf"\begin{{tabular}}{{{kinds}}}", r"\toprule", " & ".join(map(safe, names)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def card_counts(sites: DataFrame) -> DataFrame:
    """Totals over sites with a layout; languages may be several, separated by slashes."""
    own = sites.where("layouts > 0")
    languages = own.select(F.explode(F.split("language", "/")).alias("l")).select(F.trim("l").alias("l")).where("l <> ''").agg(F.countDistinct("l").alias("languages"))
    return own.agg(F.count(F.lit(1)).alias("sites"), F.countDistinct(F.nullif("country", F.lit(""))).alias("countries"), F.coalesce(F.sum("layouts"), F.lit(0)).alias("layouts"), F.coalesce(F.sum("gt_pages"), F.lit(0)).alias("gt_pages")).crossJoin(languages)


def card_countries(sites: DataFrame) -> DataFrame:
    """Sites and pages per country, most sites first."""
    country = F.coalesce(F.nullif("country", F.lit("")), F.lit("?"))
    return sites.where("layouts > 0").groupBy(country.alias("country")).agg(F.min("language").alias("language"), F.count(F.lit(1)).alias("sites"), F.sum("gt_pages").alias("gt_pages")).orderBy(F.desc("sites"), "country")


def dataset_card(name: str, sites: DataFrame, templates: DataFrame) -> str:
    totals = card_counts(sites).first()
    lines = [f"| {k.replace('_', ' ')} | {totals[k]} |" for k in ("sites", "countries", "languages", "layouts", "gt_pages")]
    return "\n".join([f"# {name}", "", "## Statistics", "", "| | |", "|---|---|", *lines, "", "### Templates", "", render_table(templates), "", "### Sites per country", "", render_table(card_countries(sites)), ""])


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def manifest(experiments: DataFrame, code: dict[str, str], templates: str) -> DataFrame:
    """What is needed to repeat experiments, as rows (part, value in JSON): how they are scored, fingerprints of code and templates, then a row per experiment (configuration, prompts, rules as they are). Nothing is collected; write_jsonl writes it."""
    spark = experiments.sparkSession
    head = {"scoring": {"aggregation": "mean of the layouts' means", "match_threshold": 0.9}, "code": {k: fingerprint(v) for k, v in code.items()}, "templates": fingerprint(templates)}
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in head.items()], "part string, value string")
    return rows.union(experiments.select(F.lit("experiment"), F.to_json(F.struct("*"))))
