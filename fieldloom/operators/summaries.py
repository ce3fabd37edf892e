"""Scores of experiments rolled up: layouts, experiments, groups, comparisons between members, study analytics.

Means are rounded at each level (cells, layouts, experiments) to four places, and a missing score is
in no mean. All inputs are long tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from .selection import upper_median

LAYOUT = ["exp_id", "layout_id"]


def mean(c: str | Column) -> Column:
    return F.round(F.avg(c), 4)


def score_cells(grid: DataFrame, gt: str = "gt", pred: str = "pred", metric: str = "metric") -> DataFrame:
    """grid with score (four places) and label; the label goes by the unrounded score. No values and no rule are the same here."""
    raw = grid.withColumn("raw", m.raw_score(F.col(gt), F.col(pred), F.col(metric)))
    return raw.withColumns({"score": F.round("raw", 4), "label": m.label_of(F.col("raw"), F.col(gt), F.col(pred))}).drop("raw")


def labelled(scored: DataFrame, counts: bool = False) -> DataFrame:
    """score_cells for cells that have their numbers of values n_gt, n_pred and raw already; these three go, or with counts raw alone."""
    label = F.when(F.col("n_gt") == 0, "NO_GT").when(F.col("n_pred") == 0, "MISS").otherwise(m.score_label(F.col("raw")))
    return scored.withColumns({"score": F.round("raw", 4), "label": label}).drop("raw", *(() if counts else ("n_gt", "n_pred")))


def n_values(cells: DataFrame, side: str) -> Column:
    """How many values cells have on a side: the column n_<side> if there is one, so that texts needn't come along, else the size of its array; null for a null array."""
    return F.col(f"n_{side}") if f"n_{side}" in cells.columns else F.when(F.col(side).isNotNull(), F.size(side))


def layout_summary(cells: DataFrame) -> DataFrame:
    """cells: exp_id, layout_id, page, field, score, label, is_sample."""
    return cells.groupBy(*LAYOUT).agg(mean("score").alias("mean"), mean(F.when(F.col("is_sample"), F.col("score"))).alias("sample_mean"), mean(F.when(~F.col("is_sample"), F.col("score"))).alias("others_mean"), F.countDistinct("page").alias("n_pages"))


def layout_fields(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*LAYOUT, "field").agg(mean("score").alias("mean"))


def experiment_summary(cells: DataFrame) -> DataFrame:
    """Means of layout means."""
    return layout_summary(cells).groupBy("exp_id").agg(mean("mean").alias("mean"), mean("sample_mean").alias("sample_mean"), mean("others_mean").alias("others_mean"), F.count(F.lit(1)).alias("n_layouts"))


def experiment_breakdown(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """Means by field and by template (templates: layout_id, template_id), both from one pass over the cells as grouping sets."""
    sets = cells.groupingSets([[*LAYOUT, "field"], LAYOUT], *LAYOUT, "field").agg(mean("score").alias("mean"), F.grouping("field").alias("whole"))
    named = sets.join(templates.select("layout_id", "template_id"), "layout_id", "left")
    axis = F.when(F.col("whole") == 1, F.struct(F.lit("template").alias("axis"), F.col("template_id").alias("value"))).otherwise(F.struct(F.lit("field").alias("axis"), F.col("field").alias("value")))
    return named.withColumn("a", axis).groupBy("exp_id", "a.axis", "a.value").agg(mean("mean").alias("mean"))


def label_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("exp_id", "label").agg(F.count(F.lit(1)).alias("n"))


def match_rate(cells: DataFrame, by: list[str]) -> DataFrame:
    """Share of MATCH among cells with ground truth; null where there are none."""
    share = F.sum((F.col("label") == "MATCH").cast("long")) / F.nullif(F.sum((F.col("label") != "NO_GT").cast("long")), F.lit(0))
    return cells.groupBy(*by).agg(F.round(share, 4).alias("match_rate"))


def run_totals(runs: DataFrame) -> DataFrame:
    """runs: exp_id, layout_id, error, tokens_in, tokens_out, ms. Tokens and time of all layouts, failed ones too."""
    return runs.groupBy("exp_id").agg(F.count(F.lit(1)).alias("llm_calls"), F.count("error").alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("ms").alias("ms"))


def leaderboard(cells: DataFrame) -> DataFrame:
    """Experiments by mean, the best marked; those without a mean last."""
    best = F.max("mean").over(Window.partitionBy(F.lit(0)))
    return experiment_summary(cells).withColumn("is_best", F.coalesce(F.col("mean") == best, F.lit(False))).orderBy(F.desc_nulls_last("mean"), "exp_id")


def layouts_won(cells: DataFrame) -> DataFrame:
    """Layouts in which an experiment has the highest mean of two or more; ties count for all."""
    by = Window.partitionBy("layout_id")
    marked = layout_summary(cells).withColumns({"top": F.max("mean").over(by), "n": F.count("mean").over(by)})
    return marked.groupBy("exp_id").agg(F.sum(((F.col("mean") == F.col("top")) & (F.col("n") >= 2)).cast("long")).alias("won"))


def heat_map(cells: DataFrame, experiments: list[str]) -> DataFrame:
    """A row per layout, a column of means per experiment."""
    return layout_summary(cells).groupBy("layout_id").pivot("exp_id", experiments).agg(F.first("mean"))


def compare(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Common layouts of two experiments, the largest difference first."""
    of = lambda e: F.col("exp_id") == e
    # both sides from one pass: a join of the two would run the cells twice
    sides = layout_summary(cells.where(of(a) | of(b))).groupBy("layout_id").agg(F.max(F.when(of(a), F.col("mean"))).alias("mean_a"), F.max(F.when(of(b), F.col("mean"))).alias("mean_b"), F.max(of(a)).alias("has_a"), F.max(of(b)).alias("has_b"))
    both = sides.where("has_a and has_b and layout_id is not null").drop("has_a", "has_b")
    return both.withColumn("delta", F.round(F.col("mean_b") - F.col("mean_a"), 4)).orderBy(F.desc_nulls_last(F.abs("delta")), "layout_id")


def pairs_of(listed: Column, who: str) -> Column:
    """Pairs (a, b) of an array's structs in the order of their member ``who``."""
    return F.flatten(F.transform(listed, lambda a: F.transform(F.filter(listed, lambda b: a[who] < b[who]), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def cross_check(cells: DataFrame, members: int | None = None) -> DataFrame:
    """Per cell of the layouts and pages that every member has: how far the members' values agree (null if no pair found anything) and how they score on average.

    cells: exp_id, layout_id, page, field, metric, pred, score. members: how many experiments there are, counted if not given.
    A page's cells are gathered in one row (members times fields), and members are paired inside it: one shuffle, no join.
    """
    n = members or cells.select("exp_id").distinct().count()
    page = cells.groupBy("layout_id", "page").agg(F.collect_list(F.struct("field", "exp_id", "metric", "pred", "score")).alias("all"))
    both = page.where(F.size(F.array_distinct(F.col("all.exp_id"))) == n)
    per = both.withColumn("field", F.explode(F.array_distinct(F.col("all.field")))).select("layout_id", "page", "field", F.filter("all", lambda c: c["field"] == F.col("field")).alias("cell"))
    scored = F.filter(F.col("cell.score"), lambda s: s.isNotNull())
    gt_mean = F.round(F.aggregate(scored, F.lit(0.0), lambda x, s: x + s) / F.nullif(F.size(scored), F.lit(0)), 4)
    pairs = per.select("layout_id", "page", "field", gt_mean.alias("gt_mean"), F.explode_outer(pairs_of(F.col("cell"), "exp_id")).alias("p"))
    raw = m.raw_score(F.col("p.a.pred"), F.col("p.b.pred"), F.col("p.a.metric"))
    agree = m.pair_agreement(F.round("raw", 4), F.col("p.a.pred"), F.col("p.b.pred"))
    return pairs.withColumn("raw", raw).withColumn("agree", F.when(F.col("p").isNotNull(), agree)).groupBy("layout_id", "page", "field").agg(mean("agree").alias("agree"), F.max("gt_mean").alias("gt_mean"))


def cross_check_by(checked: DataFrame, by: list[str]) -> DataFrame:
    return checked.groupBy(*by).agg(mean("agree").alias("agree"), mean("gt_mean").alias("gt_mean"), F.count("agree").alias("n")).orderBy(F.asc_nulls_last("agree"), *by)


def odd_cells(checked: DataFrame, kind: str, limit: int = 30) -> DataFrame:
    """Where members agree against the ground truth (suspicious), or disagree (hard): layout fields by number of cells, a top-k report."""
    odd = (F.col("agree") >= 0.9) & (F.col("gt_mean") < 0.3) if kind == "suspicious" else F.col("agree") < 0.3
    return checked.where(odd).groupBy("layout_id", "field").agg(F.count(F.lit(1)).alias("n"), mean("agree").alias("agree"), mean("gt_mean").alias("gt_mean")).orderBy(F.desc("n"), "layout_id", "field").limit(limit)


def lost_points(cells: DataFrame) -> DataFrame:
    """Each label's share of the points below 1."""
    by = cells.where("score is not null").groupBy("exp_id", "label").agg(F.sum(1 - F.col("score")).alias("lost"))
    return by.withColumn("share", F.round(F.col("lost") / F.nullif(F.sum("lost").over(Window.partitionBy("exp_id")), F.lit(0.0)), 3)).select("exp_id", "label", F.round("lost", 4).alias("lost"), "share")


def exclusive_quantile(values: Column, p: float) -> Column:
    """The p-quantile at position (n + 1) p of the sorted values, interpolated, kept within them; null for under two values."""
    bind = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))

    def at(s: Column) -> Column:
        n = F.size(s)
        low = F.least(F.greatest(F.floor((n + 1) * p), F.lit(1)), n - 1).cast("int")
        return F.when(n >= 2, F.get(s, low - 1) + ((n + 1) * p - low) * (F.get(s, low) - F.get(s, low - 1)))

    return bind(F.sort_array(values), at)


def gap_statistics(cells: DataFrame) -> DataFrame:
    """Sample mean less mean of other pages, in points, over the layouts of an experiment: least, quartiles, most, mean size."""
    gaps = layout_summary(cells).where("sample_mean is not null and others_mean is not null").select("exp_id", F.round(100 * (F.col("sample_mean") - F.col("others_mean")), 4).alias("gap"))
    listed = gaps.groupBy("exp_id").agg(F.collect_list("gap").alias("g"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.round(F.avg(F.abs("gap")), 4).alias("mean_abs"))
    return listed.select("exp_id", "least", *[F.round(exclusive_quantile(F.col("g"), p), 4).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], "most", "mean_abs")


def coverage_reasons(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells scored or not per layout and field, with the reason; cells: layout_id, page, field, gt or n_gt; rules: layout_id, field (those with a ground-truth rule)."""
    n = n_values(cells, "gt")
    status = F.when(F.col("ruled").isNull(), "no_rule").when(n.isNull(), "no_page").when(n == 0, "rule_found_nothing").otherwise("scored")
    return cells.join(rules.select("layout_id", "field", F.lit(True).alias("ruled")).distinct(), ["layout_id", "field"], "left").groupBy("layout_id", "field", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def coverage_table(cells: DataFrame, gt_rules: DataFrame, user_rules: DataFrame, excluded: DataFrame, sources: DataFrame) -> DataFrame:
    """Per layout and field: pages, scored, not_scored, status, annotators_with_rule, and source: who wrote the reference rule, else the administrator.

    cells: layout_id, page, field, gt, of one experiment. gt_rules, user_rules (with user): layout_id, field, rule. excluded: layout_id, field,
    left out on purpose. sources: layout_id, field, annotators (groundtruth.rule_sources). A pair without a reference value isn't scored.
    """
    key, ruled = ["layout_id", "field"], "coalesce(rule, '') <> ''"
    has = F.coalesce(F.size("gt") > 0, F.lit(False)).cast("long")
    per = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("pages"), F.sum(has).alias("scored"))
    who = user_rules.where(ruled).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("user")), " ").alias("annotators_with_rule"))
    wrote = sources.groupBy(*key).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("annotators")))), " ").alias("wrote"))
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    df = per.join(mark(gt_rules.where(ruled), "approved"), key, "left").join(mark(excluded, "out"), key, "left").join(who, key, "left").join(wrote, key, "left")
    status = F.when(F.col("approved"), "reference rule").when(F.col("out"), "left out by the administrator").when(F.col("annotators_with_rule").isNotNull(), "annotator rule without a decision").otherwise("no rule by any annotator")
    source = F.when(F.col("approved"), F.coalesce(F.nullif("wrote", F.lit("")), F.lit("administrator"))).otherwise("")
    return df.select(*key, "pages", "scored", (F.col("pages") - F.col("scored")).alias("not_scored"), status.alias("status"), F.coalesce("annotators_with_rule", F.lit("")).alias("annotators_with_rule"), source.alias("source"))


def coverage_totals(table: DataFrame) -> DataFrame:
    """Sums over a coverage_table: pairs, scored and not_scored ones, pairs not scored by reason, rules approved and rules of the administrator; kind, name, n."""
    of = lambda test: F.sum(test.cast("long"))
    sums = {("pairs", "all"): F.sum("pages"), ("pairs", "scored"): F.sum("scored"), ("pairs", "not_scored"): F.sum("not_scored"), ("rules", "approved"): of(F.col("status") == "reference rule"), ("rules", "administrator"): of(F.col("source") == "administrator")}
    whole = table.agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.coalesce(c, F.lit(0)).alias("n")) for (k, n), c in sums.items()]).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    reason = F.when(F.col("status") == "reference rule", "reference rule returns no value on the page").otherwise(F.col("status"))
    return whole.unionByName(table.groupBy(reason.alias("name")).agg(F.sum("not_scored").alias("n")).select(F.lit("not_scored").alias("kind"), "name", "n"))


def reference_points(cells: DataFrame) -> DataFrame:
    """Rule sets that stand beside the models, an annotator's own or a generic one: in percent the mean of layout means, of all cells (field null) and per field, with sample pages and others apart. One pass over the cells as grouping sets."""
    part = lambda test: mean(F.when(test, F.col("score")))
    means = {"mean": mean("score"), "sample_mean": part(F.col("is_sample")), "others_mean": part(~F.col("is_sample"))}
    sets = cells.groupingSets([[*LAYOUT, "field"], LAYOUT], *LAYOUT, "field").agg(*[c.alias(n) for n, c in means.items()])
    return sets.groupBy("exp_id", "field").agg(*[F.round(F.round(100 * F.avg(n), 6), 1).alias(n) for n in means])


def reference_support(similarities: DataFrame) -> DataFrame:
    """How many annotators come within 0.8 of the reference; similarities: cell columns layout_id, page, field, and annotator, similarity."""
    per = similarities.groupBy("layout_id", "page", "field").agg(F.sum((F.col("similarity") >= 0.8).cast("long")).alias("k"))
    bucket = F.when(F.col("k") == 0, "none").when(F.col("k") == 1, "one").otherwise("at_least_two")
    by = per.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def over_extraction(cells: DataFrame, absent: DataFrame) -> DataFrame:
    """Share of cells with a value among fields that no annotator found on the layout; cells: exp_id, layout_id, field, pred or n_pred; absent: layout_id, field."""
    return cells.join(absent, ["layout_id", "field"], "left_semi").groupBy("exp_id").agg(F.round(F.avg((n_values(cells, "pred") > 0).cast("double")), 4).alias("share"), F.count(F.lit(1)).alias("n"))


def timing(times: DataFrame) -> DataFrame:
    """times: exp_id, layout_id, ms. The median is the upper one of an even number; of layouts equally slow the last by name."""
    median = upper_median(times, ["exp_id"], "ms").select("exp_id", F.col("median").alias("median_ms"))
    per = times.groupBy("exp_id").agg(F.round(F.avg("ms"), 2).alias("mean_ms"), F.max("ms").alias("max_ms"), F.max_by("layout_id", F.struct("ms", "layout_id")).alias("slowest"))
    return per.join(median, "exp_id", "left").select("exp_id", "mean_ms", "median_ms", "max_ms", "slowest")


def regex_places(found: DataFrame) -> DataFrame:
    """Regex rules by where they match on the sample page: found: exp_id, rule, in_raw, in_skeleton, valid."""
    where = F.when(F.coalesce(F.col("rule"), F.lit("")) == "", "no_rule").when(~F.col("valid"), "invalid").when(F.col("in_raw") & F.col("in_skeleton"), "both").when(F.col("in_raw"), "raw_only").when(F.col("in_skeleton"), "skeleton_only").otherwise("neither")
    return found.groupBy("exp_id", where.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def rule_coverage(values: DataFrame) -> DataFrame:
    """How many pages a rule finds something on, of how many, and on how many not (empty_pages has them); values: layout_id, field, page, vals."""
    return values.groupBy("layout_id", "field").agg(F.sum((F.size("vals") > 0).cast("long")).alias("matched"), F.count(F.lit(1)).alias("total"), F.sum((F.size("vals") == 0).cast("long")).alias("n_empty"))


def empty_pages(values: DataFrame) -> DataFrame:
    """The pages on which a rule finds nothing, a row each: a list per layout would grow with it."""
    return values.where(F.size("vals") == 0).select("layout_id", "field", "page")


def required_pass(values: DataFrame) -> DataFrame:
    """Pages on which every required rule finds something; values: layout_id, page, field, optional, vals."""
    page = values.groupBy("layout_id", "page").agg(F.bool_and((F.size("vals") > 0) | F.col("optional")).alias("passed"))
    return page.groupBy("layout_id").agg(F.sum(F.col("passed").cast("long")).alias("pass_count"), F.count(F.lit(1)).alias("total"))


def rescored(before: DataFrame, after: DataFrame) -> DataFrame:
    """Experiments scored anew against another reference: both means, the change, and whether the order by mean stayed. before, after: exp_id, mean."""
    both = before.select("exp_id", F.col("mean").alias("mean_before")).join(after.select("exp_id", F.col("mean").alias("mean_after")), "exp_id")
    place = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(c), "exp_id"))
    return both.withColumn("change", F.round(F.col("mean_after") - F.col("mean_before"), 4)).withColumn("same_place", place("mean_before") == place("mean_after"))
