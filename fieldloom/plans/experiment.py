"""Experiments as data: from pages and rule sets to values, cells and summaries, with results kept per layout so that a run resumes.

All experiments of a group go through one plan; exp_id is a column. Results are committed per batch of
layouts (``sinks.atomic``), and a later run only takes layouts that are not there yet.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..extract import over_rules, scored_values
from ..functions import metrics as m
from ..operators import summaries
from ..regexgen import generate
from ..sinks import atomic

CELLS = "layout_id string, page string, field string, score double, label string, is_sample boolean, pred array<string>, gt array<string>, metric string, exp_id string"


@dataclass(frozen=True)
class Config:
    """How an experiment is run; bad values raise ValueError."""

    lang: str = "css"
    cleaning: str = "hybrid"
    skeleton: str | None = "enriched"
    sample: str = "first"
    seed: int = 42
    max_pages: int | None = None

    def __post_init__(self):
        from ..clean import STRATEGIES

        for ok, what in ((self.lang in ("css", "xpath", "regex", "regexn"), "lang"), (self.cleaning in STRATEGIES, "cleaning"), (self.sample in ("first", "random"), "sample"), (self.max_pages is None or self.max_pages > 0, "max_pages")):
            if not ok:
                raise ValueError(f"bad {what}: {getattr(self, what)}")


def sample_pages(scope: DataFrame, config: Config = Config()) -> DataFrame:
    """The page of each layout that the model sees: the first, or one drawn by seed, domain and layout."""
    key = ["domain", "layout_id"]
    if config.sample == "first":
        return scope.groupBy(*key).agg(F.min("page").alias("sample_page"))
    seed = config.seed

    @F.pandas_udf("long")
    def place(domain: pd.Series, layout: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([random.Random(f"{seed}|{d}|{x}").choice(range(k)) for d, x, k in zip(domain, layout, n, strict=True)], dtype="int64")

    # drawn from the number of pages, a row per layout; then the page of that rank by name
    drawn = scope.groupBy(*key).agg(F.count("page").alias("n")).where("n > 0").withColumn("place", place("domain", "layout_id", "n"))
    ranked = scope.where("page is not null").withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("page")) - 1)
    return ranked.join(drawn, key).where("rank = place").select(*key, F.col("page").alias("sample_page"))


def grid(pages: DataFrame, fields: DataFrame, gt_rules: DataFrame, model_rules: DataFrame) -> DataFrame:
    """Cells with the values of both sides, scored.

    pages: layout_id, page, html. fields: layout_id, field, type, metric, merge. gt_rules: layout_id, field,
    rule (CSS). model_rules: exp_id, layout_id, field, lang, rule. Rules of all experiments and of the ground
    truth run together, so each page is parsed once, and cells come out of that pass: pages don't shuffle. A missing rule finds
    nothing. An experiment has cells for the layouts it has a rule row for.
    """
    return summaries.labelled(scored(pages, fields, gt_rules, model_rules, True)).select("exp_id", "layout_id", "page", "field", "metric", "gt", "pred", "score", "label")


def scored(pages: DataFrame, fields: DataFrame, gt_rules: DataFrame, model_rules: DataFrame, values: bool = False) -> DataFrame:
    """Cells as in grid with n_gt, n_pred (how many values both sides have) and raw, the unrounded score; gt and pred only if values are wanted: texts then stay in the task that reads the page."""
    kinds = fields.select("layout_id", "field", m.field_kind(F.col("type")).alias("kind"), "merge", "metric")
    # the rules of all cells, missing ones too: a table by layout, not by page
    members = model_rules.select("layout_id", "exp_id").distinct().join(kinds, "layout_id").join(model_rules.select("layout_id", "exp_id", "field", "lang", "rule"), ["layout_id", "exp_id", "field"], "left")
    gt = gt_rules.select("layout_id", "field", F.col("rule").alias("gt_rule")).dropDuplicates(["layout_id", "field"])
    rules = members.join(gt, ["layout_id", "field"], "left").select("layout_id", "exp_id", "field", "metric", F.coalesce("lang", F.lit("css")).alias("lang"), "kind", "merge", "rule", "gt_rule")
    schema = "exp_id string, field string, metric string, n_gt int, n_pred int, raw double" + ", gt array<string>, pred array<string>" * values
    return over_rules(pages, rules, ["layout_id"], ["layout_id", "page"], scored_values(values), schema)


def mark_samples(cells: DataFrame, samples: DataFrame) -> DataFrame:
    return cells.join(samples.select("layout_id", "sample_page"), "layout_id").withColumn("is_sample", F.col("page") == F.col("sample_page")).drop("sample_page")


SLOTS = ["exp_id", "layout_id"]


def done_layouts(spark: SparkSession, path: str) -> DataFrame:
    """exp_id and layout_id of what has been committed."""
    return atomic.filled(spark, path, SLOTS).select(*SLOTS)


def run(pages: DataFrame, fields: DataFrame, gt_rules: DataFrame, model_rules: DataFrame, samples: DataFrame, path: str) -> DataFrame:
    """Scores the layouts of each experiment that are not in path yet, commits them together, and returns all cells there. A run that is cut off leaves no layout half done."""
    spark = pages.sparkSession
    left = model_rules.join(done_layouts(spark, path), SLOTS, "left_anti")
    if not left.isEmpty():
        cells = mark_samples(grid(pages, fields, gt_rules, left), samples)
        atomic.commit(cells.select("layout_id", "page", "field", "score", "label", "is_sample", "pred", "gt", "metric", "exp_id"), path, SLOTS)
    return atomic.committed(spark, path, SLOTS, CELLS)


def rewritten(pages: DataFrame, fields: DataFrame, gt_rules: DataFrame, model_rules: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Experiments with their rules as written and rewritten (such as ``operators.rules.token_tests``), scored in one pass over the pages: exp_id, mean_before, mean_after, change, same_place, changed (how many rules the rewriting changed).

    Inputs as for grid. rewrite takes model_rules and returns them with other rules.
    """
    after = rewrite(model_rules.withColumn("was", F.col("rule")))
    changed = after.groupBy("exp_id").agg(F.sum((F.coalesce("rule", F.lit("")) != F.coalesce("was", F.lit(""))).cast("long")).alias("changed"))
    named = lambda df, form: df.withColumn("exp_id", F.to_json(F.struct(F.lit(form).alias("form"), "exp_id")))
    cells = summaries.labelled(scored(pages, fields, gt_rules, named(model_rules, "before").unionByName(named(after.drop("was"), "after"))))
    means = summaries.experiment_summary(cells.withColumn("is_sample", F.lit(False))).withColumn("e", F.from_json("exp_id", "form string, exp_id string"))
    one = lambda form: means.where(F.col("e.form") == form).select("e.exp_id", "mean")
    return summaries.rescored(one("before"), one("after")).join(changed, "exp_id")


def regex_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """For CSS rules the regular expressions that give the same values on the given pages of their layout: layout_id, field, regex, strategy, passed, total, tried; rules: layout_id, field, kind, rule. pages must be few per layout (sample pages)."""
    from ..extract import Page

    def make(df: pd.DataFrame) -> pd.DataFrame:
        first = df.iloc[0]
        df = df.sort_values("page")
        wanted = [Page(h).values(first["rule"], "css", first["kind"]) for h in df["html"]]
        found = generate(first["rule"], df["html"].tolist(), wanted, first["kind"]) or {"regex": None, "strategy": None, "passed": 0, "total": len(df), "tried": 0}
        return pd.DataFrame([{"layout_id": first["layout_id"], "field": first["field"], **found}])

    both = pages.select("layout_id", "page", "html").join(rules.select("layout_id", "field", "kind", "rule"), "layout_id")
    return both.groupBy("layout_id", "field").applyInPandas(make, "layout_id string, field string, regex string, strategy string, passed long, total long, tried long")


def status(runs: DataFrame) -> DataFrame:
    """One status per group from those of its members: running before queued, then error, interrupted, cancelled, done."""
    order = ["running", "queued", "error", "interrupted", "cancelled", "done"]
    return runs.groupBy("group_id").agg(F.min_by("status", F.array_position(F.array(*map(F.lit, order)), F.col("status"))).alias("status"), F.count(F.lit(1)).alias("members"))
