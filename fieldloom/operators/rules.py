"""Rules judged over all pages of their layouts: selector scores, validation with previews, bulk tests, XPath suggestions, rewritten rules.

All of them run through ``extract.over_rules``: a page is parsed once for all rules of its layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scoring
from ..extract import over_rules
from ..responses import string_udf


def selector_scores(pages: DataFrame, rules: DataFrame, on: list[str], keep: list[str], metric: str = "f1", mode: str | None = None, most_chars: int | None = scoring.TEXT_LIMIT) -> DataFrame:
    """score and label of each rule on each page of its layout; rules: on, rule_id, field, lang, rule, gt_lang, gt_rule, optional. mode: the skeleton on which CSS rules that miss are tried. most_chars: how much of a text is compared, None for all of it."""

    def kernel(page, mine):
        return ((rule_id, *scoring.selector_score(page, rule, gt_rule, lang, gt_lang, bool(optional), field, metric, mode, most_chars)) for rule_id, field, lang, rule, gt_lang, gt_rule, optional in mine)

    return over_rules(pages, rules.select(*on, "rule_id", "field", "lang", "rule", "gt_lang", "gt_rule", "optional"), on, keep, kernel, "rule_id string, score double, label string")


def validate_rules(pages: DataFrame, rules: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Whether rules match, how often, with previews; syntax errors are told from no match. rules: on, rule_id, lang, merge, rule, css (a rule to compare with, or null)."""
    schema = "rule_id string, valid boolean, n long, previews array<string>, matched string, error string, css_count long, same boolean, same_count boolean"
    return over_rules(pages, rules.select(*on, "rule_id", "lang", "merge", "rule", "css"), on, keep, scoring.validate, schema)


def suggested_xpaths(pages: DataFrame, rules: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """An XPath for each CSS rule, verified on each page; rules: on, rule_id, merge, rule."""

    def kernel(page, mine):
        return ((rule_id, *scoring.suggest_xpath(page, rule, bool(merge))) for rule_id, merge, rule in mine)

    return over_rules(pages, rules.select(*on, "rule_id", "merge", "rule"), on, keep, kernel, "rule_id string, xpath string, verified boolean")


def joined_values(pages: DataFrame, rules: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Values by the other definition (``scoring.joined_value``); rules: on, field, merge, rule."""

    def kernel(page, mine):
        return ((field, scoring.joined_value(page, rule, field, bool(merge))) for field, merge, rule in mine)

    return over_rules(pages, rules.select(*on, "field", "merge", "rule"), on, keep, kernel, "field string, vals array<string>")


def token_tests(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """rules with XPath tests of the whole class attribute rewritten to tests of its words."""
    return rules.withColumn(rule, F.when(F.col("lang") == "xpath", string_udf(scoring.token_tests)(F.coalesce(rule, F.lit("")))).otherwise(F.col(rule)))


def block_rules(rules: DataFrame) -> DataFrame:
    """Rules of fields with several blocks, a row per block: key is field[i]. rules: layout_id, field, value (text, or a JSON list or object), merge, optional, blocks (whether the field has blocks)."""
    is_list = F.ltrim("value").startswith("[") & F.from_json("value", "array<string>").isNotNull()
    items = F.when(is_list, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    css = lambda v: F.when(F.ltrim(v).startswith("{"), F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in ("css", "image", "link")])).otherwise(v)
    each = rules.select("*", F.posexplode(F.when(F.col("blocks"), items).otherwise(F.array("value"))).alias("i", "item"))
    key = F.when(F.col("blocks"), F.concat("field", F.lit("["), F.col("i").cast("string"), F.lit("]"))).otherwise(F.col("field"))
    return each.select("layout_id", key.alias("key"), css(F.col("item")).alias("rule"), "merge", "optional").where("coalesce(rule, '') <> ''")


def bulk_test(pages: DataFrame, rules: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Each rule's verdict and first preview on each page, and whether all required rules match there; rules: on, key, rule (CSS), merge, optional, as block_rules gives them."""

    def kernel(page, mine):
        shown = [scoring.shown_texts(page, rule, "css", bool(merge))[:2] for _, rule, merge, _ in mine]
        passed = all(texts or optional for (texts, _), (_, _, _, optional) in zip(shown, mine, strict=True))
        return ((key, bool(texts), previews[0] if previews else "", bool(optional), passed) for (key, _, _, optional), (texts, previews) in zip(mine, shown, strict=True))

    return over_rules(pages, rules.select(*on, "key", "rule", "merge", "optional"), on, keep, kernel, "key string, valid boolean, preview string, optional boolean, all_required_pass boolean")
