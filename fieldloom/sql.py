"""Functions for Spark SQL: register(spark), then e.g.

    SELECT word_f1(a, b), css_to_xpath(rule) FROM pairs
    SELECT t.* FROM pages, LATERAL css_select(html, 'h1') AS t
    SELECT * FROM rule_values(TABLE(SELECT page_id, html, rules FROM pages))
    SELECT field, fleiss_kappa(subject, category), krippendorff_alpha(subject, category) FROM ratings GROUP BY field
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import clean, css, dom, responses, skeleton
from .extract import Page
from .functions import metrics


@udtf(returnType="ord int, tag string, text string, html string")
class CssSelect:
    """Elements of a page that a selector list matches."""

    def eval(self, html: str, selector: str):
        for k, n in enumerate(css.select(dom.parse(html or ""), selector)):
            yield k, n.tag, dom.visible_text(n), n.to_html()


@udtf(returnType="node_id int, parent_id int, depth int, tag string, id string, classes array<string>, attrs map<string,string>, text string")
class DomNodes:
    """All elements of a page."""

    def eval(self, html: str):
        for n in dom.parse(html or "").elements():
            above = [a for a in n.ancestors() if a.is_element]
            yield n.order, above[0].order if above else None, len(above), n.tag, n.attrs.get("id"), n.classes(), n.attrs, dom.visible_text(n)


@udtf
class RuleValues:
    """For each page of a table with html and rules (array of struct<rule_id, lang, kind, merge, rule>) what each rule finds: the table's other columns, rule_id, vals.

    A page is parsed once for all its rules. With PARTITION BY a partition's pages come together; nothing here needs it.
    """

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        missing = {"html", "rules"} - set(pages.dataType.names if pages.isTable else [])
        if missing:
            raise ValueError("rule_values needs a TABLE argument with html and rules")
        kept = StructType([f for f in pages.dataType.fields if f.name not in ("html", "rules")])
        return AnalyzeResult(kept.add("rule_id", StringType()).add("vals", ArrayType(StringType())))

    def eval(self, row: Row):
        page, found = Page(row["html"] or ""), row.asDict()
        others = [v for k, v in found.items() if k not in ("html", "rules")]
        for r in row["rules"] or []:
            yield (*others, r["rule_id"], page.values(r["rule"], r["lang"] or "css", r["kind"] or "text", bool(r["merge"])))


def rated(subject: pd.Series, category: pd.Series) -> pd.DataFrame:
    """Counts per subject and category of subjects with two ratings or more; empty ratings are none."""
    df = pd.DataFrame({"s": subject, "c": category.astype(object)})
    df = df[df["c"].notna() & (df["c"].astype(str) != "") & df["s"].notna()]
    n = df.groupby(["s", "c"]).size().unstack(fill_value=0)
    return n[n.sum(axis=1) >= 2]


@pandas_udf(DoubleType())
def fleiss_kappa(subject: pd.Series, category: pd.Series) -> float:
    """As operators.agreement.fleiss_kappa, for groups that a task can hold; the operator takes any."""
    n = rated(subject, category)
    if len(n) < 2:
        return float("nan")
    m, po = n.sum(axis=1), ((n**2).sum(axis=1) - n.sum(axis=1)) / (n.sum(axis=1) * (n.sum(axis=1) - 1))
    pe = float(((n.sum() / m.sum()) ** 2).sum())
    return 1.0 if pe >= 1 else round((float(po.mean()) - pe) / (1 - pe), 6)


@pandas_udf(DoubleType())
def krippendorff_alpha(unit: pd.Series, category: pd.Series) -> float:
    """As operators.agreement.nominal_alpha, for groups that a task can hold; the operator takes any."""
    n = rated(unit, category)
    if not len(n):
        return float("nan")
    m, total = n.sum(axis=1), float(n.sum().sum())
    observed = float(((m**2 - (n**2).sum(axis=1)) / (m - 1)).sum()) / total
    expected = (total**2 - float((n.sum() ** 2).sum())) / (total * (total - 1))
    return 1.0 if expected == 0 else round(1 - observed / expected, 6)


def register(spark: SparkSession) -> None:
    text = responses.string_udf
    for name, f in {
        "word_f1": metrics.word_f1, "rouge_l": metrics.rouge_l, "sequence_ratio": metrics.sequence_ratio, "html_to_text": metrics.html_text, "dates_match": metrics.dates_match,
        "normalize_rule": text(css.normalize_rule), "split_selectors": text(css.split_selectors, "array<string>"), "css_to_xpath": text(css.css_to_xpath), "readable_xpath": text(css.readable_xpath),
        "class_token": text(skeleton.class_token), "repair_selector": text(responses.repair_selector), "skeleton": skeleton.skeleton_udf("enriched"),
        **{f"clean_{s}": clean.clean_udf(s) for s in clean.STRATEGIES},
    }.items():
        spark.udf.register(name, f)
    for name, f in (("fleiss_kappa", fleiss_kappa), ("krippendorff_alpha", krippendorff_alpha)):
        spark.udf.register(name, f)
    spark.udtf.register("rule_values", RuleValues)
    spark.udtf.register("css_select", CssSelect)
    spark.udtf.register("dom_nodes", DomNodes)
