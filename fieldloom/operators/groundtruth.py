"""Approval of ground truth, progress of annotators, and reports on the data set, as joins and aggregates over study tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "coalesce(rule, '') <> ''"


def count_if(condition):
    return F.sum(F.when(condition, 1).otherwise(0).cast("long"))


def page_scope(assignments: DataFrame, pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages of each layout: assigned by the ground truth, not skipped, and there. max_pages keeps the first ones by name."""
    kept = assignments.where("layout_id is not null and not coalesce(skipped, false)").join(pages.select("domain", "page"), ["domain", "page"], "left_semi")
    if max_pages is None:
        return kept
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("domain", "layout_id").orderBy("page"))).where(F.col("k") <= max_pages).drop("k")


def resolve_template(layouts: DataFrame, templates: DataFrame) -> DataFrame:
    """The layout's template if it names one, else its page type if there is a template of that name, else the empty name."""
    t = templates.select(F.col("template_id").alias("t")).distinct()
    named = F.coalesce(F.col("template_id"), F.lit("")) != ""
    df = layouts.join(t, F.col("page_type") == F.col("t"), "left")
    return df.withColumns({"resolved": F.when(named, F.col("template_id")).otherwise(F.coalesce("t", F.lit(""))), "template_inferred": ~named}).drop("t")


def eligible_layouts(layouts: DataFrame, rules: DataFrame, scope: DataFrame, templates: DataFrame) -> DataFrame:
    """Layouts that can be evaluated: with a template, a CSS rule and a page."""
    key = ["domain", "layout_id"]
    n = scope.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pages"))
    ruled = rules.where("lang = 'css'").where(RULE)
    return resolve_template(layouts, templates).where("resolved <> ''").join(ruled, key, "left_semi").join(n, key).withColumn("name", F.coalesce("name", "layout_id"))


def effective_assignments(gt: DataFrame, mine: DataFrame) -> DataFrame:
    """A user's own assignments over those of the ground truth."""
    key = ["domain", "page"]
    own = mine.select(*key, F.col("layout_id").alias("l"), F.col("skipped").alias("s"), F.lit(True).alias("own"))
    pick = lambda a, b: F.when(F.col("own"), F.col(a)).otherwise(F.col(b))
    return gt.join(own, key, "full").select(*key, pick("l", "layout_id").alias("layout_id"), pick("s", "skipped").alias("skipped"))


def unapproved_fields(user_rules: DataFrame, gt_rules: DataFrame) -> DataFrame:
    """Fields that annotators have rules for and the ground truth has none: layout_id, field, annotators."""
    return user_rules.where(RULE).join(gt_rules.where(RULE), ["layout_id", "field"], "left_anti").groupBy("layout_id", "field").agg(F.sort_array(F.collect_set("user")).alias("annotators"))


def rule_sources(gt_rules: DataFrame, user_rules: DataFrame, normal: str = "normal") -> DataFrame:
    """Annotators whose rule, in normal form, is the approved one; nobody if an administrator wrote it."""
    key = ["layout_id", "field", "lang", normal]
    wrote = user_rules.select(*key, "user").distinct()
    return gt_rules.where(F.col(normal).isNotNull()).join(wrote, key, "left").groupBy(*key).agg(F.sort_array(F.collect_set("user")).alias("annotators"))


def can_compile(unapproved: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Per layout whether every field left out has been confirmed, and those that have not; confirmed: layout_id, field."""
    open_ = unapproved.join(confirmed, ["layout_id", "field"], "left_anti").groupBy("layout_id").agg(F.sort_array(F.collect_list("field")).alias("missing"))
    return unapproved.select("layout_id").distinct().join(open_, "layout_id", "left").select("layout_id", F.col("missing").isNull().alias("ok"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def layout_status(gt_rules: DataFrame, user_rules: DataFrame, compiled: DataFrame) -> DataFrame:
    """none, stale or approved per layout and language; compiled: layout_id, lang, at; user_rules with updated_at."""
    key = ["layout_id", "lang"]
    last = user_rules.where(RULE).groupBy(*key).agg(F.max("updated_at").alias("last"), F.countDistinct("user").alias("annotators"))
    ruled = gt_rules.where(RULE).select(*key, F.lit(True).alias("has_gt")).distinct()
    df = ruled.join(last, key, "full").join(compiled, key, "left")
    status = F.when(F.col("has_gt").isNull(), "none").when(F.col("last") > F.col("at"), "stale").otherwise("approved")
    return df.select(*key, status.alias("status"), F.coalesce("annotators", F.lit(0).cast("long")).alias("annotators"), F.col("at").alias("compiled_at"), F.col("last").alias("last_change"))


def site_overview(status: DataFrame, layouts: DataFrame) -> DataFrame:
    """Layouts of a site by status of their CSS rules, those that wait to be compiled in any language, and the last compilation."""
    each = layouts.select("domain", "layout_id").join(status, "layout_id", "left")
    waits = (F.col("annotators") > 0) & F.col("status").isin("none", "stale")
    per = each.groupBy("domain", "layout_id").agg(F.max(F.when(F.col("lang") == "css", F.col("status"))).alias("css"), F.max(F.coalesce(waits, F.lit(False))).alias("pending"), F.max("compiled_at").alias("at"))
    css = F.coalesce("css", F.lit("none"))
    return per.groupBy("domain").agg(*[count_if(css == s).alias(s) for s in ("approved", "stale", "none")], count_if(F.col("pending")).alias("pending"), F.max("at").alias("last_compiled"))


def page_types(pages: DataFrame) -> DataFrame:
    """pages with page_type by file name."""
    p = F.col("page")
    return pages.withColumn("page_type", F.when(p == "homepage.html", "homepage").when(p.startswith("listing_"), "listing").when(p.startswith("article_"), "article").otherwise("other"))


def dataset_sites(sites: DataFrame, pages: DataFrame, layouts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per site: pages by type, pages with ground truth, skipped ones, layouts; zero where there are none."""
    typed = page_types(pages).groupBy("domain").agg(*[count_if(F.col("page_type") == t).alias(t) for t in ("article", "listing", "homepage")])
    marked = assignments.join(layouts.select("domain", "layout_id", F.lit(True).alias("there")).distinct(), ["domain", "layout_id"], "left")
    given = marked.groupBy("domain").agg(count_if(F.col("there") & ~F.coalesce("skipped", F.lit(False))).alias("gt_pages"), count_if(F.col("skipped")).alias("skipped"))
    n = layouts.groupBy("domain").agg(F.count(F.lit(1)).alias("layouts"))
    df = sites.join(typed, "domain", "left").join(given, "domain", "left").join(n, "domain", "left")
    zeros = ["article", "listing", "homepage", "gt_pages", "skipped", "layouts"]
    return df.na.fill(0, zeros).withColumn("pages", F.col("article") + F.col("listing") + F.col("homepage"))


def dataset_templates(layouts: DataFrame, scope: DataFrame) -> DataFrame:
    """Per template: layouts, sites and pages with ground truth, most layouts first."""
    n = scope.groupBy("domain", "layout_id").agg(F.count(F.lit(1)).alias("n"))
    return layouts.join(n, ["domain", "layout_id"], "left").groupBy("template_id").agg(F.count(F.lit(1)).alias("layouts"), F.countDistinct("domain").alias("sites"), F.coalesce(F.sum("n"), F.lit(0)).alias("gt_pages")).orderBy(F.desc("layouts"), "template_id")


def site_completion(pages: DataFrame, assignments: DataFrame) -> DataFrame:
    """Pages assigned per site; complete with five or all of them, ready with five."""
    n = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("total_pages"))
    done = assignments.where("layout_id is not null and not coalesce(skipped, false)").groupBy("domain").agg(F.count(F.lit(1)).alias("annotated"))
    df = n.join(done, "domain", "left").na.fill(0, ["annotated"])
    return df.withColumns({"complete": F.col("annotated") >= F.least(F.lit(5), F.col("total_pages")), "ready": F.col("annotated") >= 5})


def my_status(layouts: DataFrame, rules: DataFrame, user: str) -> DataFrame:
    """How many of a site's layouts a user has written rules for."""
    mine = rules.where(F.col("user") == user).where(RULE).select("layout_id").distinct().withColumn("done", F.lit(1))
    per = layouts.join(mine, "layout_id", "left").groupBy("domain").agg(F.count(F.lit(1)).alias("layouts"), F.coalesce(F.sum("done"), F.lit(0)).alias("my_layouts"))
    return per.withColumn("my_status", F.when(F.col("my_layouts") == 0, "none").when(F.col("my_layouts") >= F.col("layouts"), "done").otherwise("partial"))


def annotation_progress(assignments: DataFrame, rules: DataFrame) -> DataFrame:
    """Per user and site: pages assigned and skipped, layouts and rules by language, last change. rules: user, domain, layout_id, lang, rule, updated_at."""
    key = ["user", "domain"]
    pages = assignments.groupBy(*key).agg(count_if(F.col("layout_id").isNotNull() & ~F.coalesce("skipped", F.lit(False))).alias("assigned"), count_if(F.col("skipped")).alias("skipped"))
    written = rules.where(RULE).groupBy(*key).agg(F.countDistinct("layout_id").alias("layouts"), *[count_if(F.col("lang") == x).alias(x) for x in ("css", "xpath", "regex")], F.max("updated_at").alias("last"))
    return pages.join(written, key, "full").na.fill(0)


def rule_suggestions(rules: DataFrame) -> DataFrame:
    """Per layout and field the rule to propose, who wrote it first, the share of pairs of annotators whose rules are the same (po), and the mean of po over the layout's fields (layout_po; fields of fewer than two rules are in no mean).

    rules: layout_id, field, user, ord, rule, normal (the form that is compared; the rule as written is proposed).
    """
    key = ["layout_id", "field"]
    per = rules.where("coalesce(normal, '') <> ''").groupBy(*key, "normal").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sum("n") * (F.sum("n") - 1)
    po = per.groupBy(*key).agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.nullif(pairs, F.lit(0))).alias("po"))
    whole = po.groupBy("layout_id").agg(F.round(F.avg("po"), 6).alias("layout_po"))
    best = suggested_rule(rules).select(*key, "rule", "user")
    return best.join(po.withColumn("po", F.round("po", 6)), key, "left").join(whole, "layout_id", "left").select(*key, "rule", "user", "po", "layout_po")


def suggested_rule(rules: DataFrame) -> DataFrame:
    """Per layout and field the rule most annotators wrote, the first one on a tie, and who wrote it first; rules: layout_id, field, user, ord, rule."""
    key = ["layout_id", "field"]
    counted = rules.where(RULE).groupBy(*key, "rule").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.min_by("user", "ord").alias("user"))
    best = counted.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first")))
    return best.where("k = 1").select(*key, "rule", "user", "n")


def export_rows(layouts: DataFrame, rules: DataFrame, fields: DataFrame, scope: DataFrame) -> DataFrame:
    """A row per approved rule with its metric and number of pages, as exports carry it."""
    n = scope.groupBy("domain", "layout_id").agg(F.count(F.lit(1)).alias("page_count"))
    df = layouts.join(rules, ["domain", "layout_id"]).join(fields.select("template_id", "field", "metric"), ["template_id", "field"], "left").join(n, ["domain", "layout_id"], "left")
    return df.select("domain", "layout_id", F.coalesce("name", "layout_id").alias("layout_name"), F.coalesce("page_type", F.lit("article")).alias("page_type"), "template_id", "field", F.col("rule").alias("selector"), F.coalesce("metric", F.lit("rouge")).alias("metric"), F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"))


def user_activity(annotations: DataFrame, experiments: DataFrame) -> DataFrame:
    """Per user: sites with annotations, last change, experiments started; users of either kind. annotations: user, domain, updated_at; experiments: exp_id, created_by."""
    wrote = annotations.groupBy("user").agg(F.countDistinct("domain").alias("sites"), F.max("updated_at").alias("last_annotation"))
    began = experiments.where("coalesce(created_by, '') <> ''").groupBy(F.col("created_by").alias("user")).agg(F.count(F.lit(1)).alias("experiments"))
    return wrote.join(began, "user", "full").na.fill(0, ["sites", "experiments"])


def annotated_pages(assignments: DataFrame) -> DataFrame:
    """Pages that any annotator has assigned to a layout, each once, in order: the page set a layout is compiled with."""
    return assignments.where("layout_id is not null and not coalesce(skipped, false)").select("domain", "layout_id", "page").distinct().orderBy("domain", "layout_id", "page")


def safe_name(name: Column) -> Column:
    """Whether a name is a single part of a path that can't leave its folder; null isn't."""
    return F.coalesce((F.length(name) <= 255) & ~name.isin("", ".", "..") & ~name.rlike(r"[/\\\x00:]"), F.lit(False))


def search(experiments: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Experiments with the text in any of some columns, whatever the case; all of them for an empty text."""
    return experiments.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))


def slim(experiments: DataFrame, columns: list[str]) -> DataFrame:
    """Listed columns only; dotted names reach into structs and are named by their last part, so that readers prune what isn't listed."""
    return experiments.select(*[F.col(c).alias(c.rpartition(".")[2]) for c in columns])


SECRET = r"(?i)(^|[_-])(api[_-]?key|key|token|secret|password|authorization)$"


def backend_snapshot(params: Column) -> Column:
    """A map of a backend's settings without secrets, as an experiment keeps them."""
    return F.map_filter(params, lambda k, v: ~k.rlike(SECRET))


def may_change(owner: Column, user: str, is_admin: bool) -> Column:
    """Who may change a template or prompt: its owner and administrators."""
    return F.lit(True) if is_admin else F.coalesce(owner == user, F.lit(False))


def change_owned(table: DataFrame, changes: DataFrame, key: str, user: str, is_admin: bool = False) -> DataFrame:
    """A table of templates or prompts after a user's changes: rows with op "put" are new or replace what the user may change, "delete" removes it; others stay as they are.

    table: key, owner and more; changes: key, op, and the table's other columns. What replaces a row keeps its owner; a new row is the user's.
    """
    asked = changes.withColumnsRenamed({c: f"new_{c}" for c in changes.columns})
    both = table.join(asked, table[key] == asked[f"new_{key}"], "full")
    there, allowed = F.col(key).isNotNull(), F.col(key).isNull() | may_change(F.col("owner"), user, is_admin)
    acts = F.col("new_op").isNotNull() & allowed
    kept = both.where(~(F.coalesce(acts, F.lit(False)) & (F.col("new_op") == "delete")) | F.col("new_op").isNull())
    pick = lambda c: (F.when(there, F.col("owner")).when(acts, F.lit(user)) if c == "owner" else F.when(acts, F.col(f"new_{c}")).otherwise(F.col(c))).alias(c)
    return kept.where(there | (F.col("new_op") == "put")).select(*[pick(c) for c in table.columns])
