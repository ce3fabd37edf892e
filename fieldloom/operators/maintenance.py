"""Changes to study tables, as rewrites by key: a new version of the table comes out, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def country_totals(sites: DataFrame) -> DataFrame:
    return sites.groupBy("country", "code").agg(F.count(F.lit(1)).alias("sites"))


def delete_layouts(assignments: DataFrame, gone: DataFrame) -> DataFrame:
    """Assignments to deleted layouts lose their layout and stay."""
    marked = assignments.join(gone.select("domain", "layout_id").distinct().withColumn("gone", F.lit(True)), ["domain", "layout_id"], "left")
    return marked.withColumn("layout_id", F.when(F.col("gone").isNull(), F.col("layout_id"))).select(*assignments.columns)


def exclude(excluded: DataFrame, domains: DataFrame) -> DataFrame:
    """The exclusion list with more domains, each once."""
    return excluded.select("domain").union(domains.select("domain")).distinct()


def rule_changes(old: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """History rows of a save: fields whose rule changed, with old and new."""
    key = ["user", "domain", "layout_id", "field"]
    both = old.select(*key, F.col("rule").alias("old")).join(new.select(*key, F.col("rule").alias("new")), key, "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("at", F.to_timestamp(F.lit(at)))


def keep_decisions(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Decisions on fields that still have no rule."""
    return decisions.join(rules.where("coalesce(rule, '') <> ''"), ["layout_id", "field"], "left_anti")


def next_number(pages: DataFrame, prefix: str) -> DataFrame:
    """Per domain the smallest number from 1 that no page article_NNN (or other prefix) has. Gaps come from the order of numbers taken."""
    n = F.regexp_extract("page", rf"^{prefix}_(\d+)\.html$", 1)
    taken = pages.where(n != "").select("domain", n.cast("long").alias("n")).where("n > 0").distinct()
    ranked = taken.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("n")))
    # numbers below the first gap equal their rank
    full = ranked.where("n = k").groupBy("domain").agg(F.max("n").alias("n"))
    return pages.select("domain").distinct().join(full, "domain", "left").select("domain", (F.coalesce("n", F.lit(0)) + 1).alias("next"))


def free_numbers(pages: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """Rows of new (domain, ord and whatever else) with page: the kth of a domain, by ord, gets the kth number from 1 that none of its pages has. pages: domain, page.

    A taken number n with rank i has n - i free ones below it, so the kth free number is k plus the taken ones with fewer than k free ones below. Both
    are merged on that count in one window; nothing is looped over, and gaps of any length cost nothing. Names that aren't of the prefix take no number; rows equal in ord follow in any order.
    """
    n = F.regexp_extract("page", rf"^{prefix}_(\d+)\.html$", 1)
    taken = pages.where(n != "").select("domain", n.cast("long").alias("n")).where("n > 0").distinct()
    below = taken.select("domain", (F.col("n") - F.row_number().over(Window.partitionBy("domain").orderBy("n")) + 1).alias("k"))
    asked = new.select("domain", F.row_number().over(Window.partitionBy("domain").orderBy("ord")).cast("long").alias("k"), F.struct("*").alias("row"))
    both = below.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy("domain").orderBy("k", F.col("row").isNotNull())
    number = F.col("k") + F.count(F.when(F.col("row").isNull(), 1)).over(order)
    name = F.concat(F.lit(f"{prefix}_"), F.when(F.length(number.cast("string")) < 3, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")), F.lit(".html"))
    return both.withColumn("page", name).where("row is not null").select("row.*", "page")


def added_pages(pages: DataFrame, fetched: DataFrame, page_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bulk add: new pages (domain, page, html), their index rows and the results by address. fetched: domain, ord, url, html (null: not fetched), method, error, at; failures take no number."""
    named = free_numbers(pages, fetched.where("html is not null"), page_type)
    index = named.select("domain", "page", "url", F.lit(page_type).alias("page_type"), "method", F.length("html").cast("long").alias("size"), "at")
    result = named.select("domain", "ord", "url", F.lit(True).alias("success"), "page", F.lit(None).cast("string").alias("error"))
    failed = fetched.where("html is null").select("domain", "ord", "url", F.lit(False).alias("success"), F.lit(None).cast("string").alias("page"), F.coalesce("error", F.lit("Download failed")).alias("error"))
    return named.select("domain", "page", "html"), index, result.unionByName(failed)


def model_catalog(installed: DataFrame, registered: DataFrame) -> DataFrame:
    """Models installed or registered with a backend: offered unless hidden or known to be missing. registered: backend, model, hidden, is_default; installed: backend, model, reachable."""
    reach = installed.groupBy("backend").agg(F.max("reachable").alias("known"))
    there = installed.where("model is not null").select("backend", "model", F.lit(True).alias("installed")).distinct()
    df = there.join(registered, ["backend", "model"], "full").join(reach, "backend", "left")
    flags = {"installed": F.coalesce("installed", F.lit(False)), "hidden": F.coalesce("hidden", F.lit(False)), "is_default": F.coalesce("is_default", F.lit(False))}
    return df.withColumns(flags).withColumn("offered", ~F.col("hidden") & ~(F.coalesce("known", F.lit(False)) & ~F.col("installed"))).drop("known")


def effective_parameters(backends: DataFrame, models: DataFrame) -> DataFrame:
    """Generation parameters of each model over those of its backend: maps params and model_params."""
    none = F.create_map().cast("map<string,string>")
    mine = F.coalesce("model_params", none)
    base = F.map_filter(F.coalesce("params", none), lambda k, v: ~F.array_contains(F.map_keys(mine), k))
    return backends.join(models, "backend").select("backend", "model", F.map_concat(base, mine).alias("params"))


def request_spacing(requests: DataFrame, min_delay: float, most: float = 30.0) -> DataFrame:
    """When requests may go out: host, at (seconds), crawl_delay; pause is what a request waits since the one before it to the same host arrived."""
    gap = F.greatest(F.lit(min_delay), F.least(F.coalesce("crawl_delay", F.lit(0.0)), F.lit(most)))
    before = F.lag("at").over(Window.partitionBy("host").orderBy("at", "request_id"))
    return requests.withColumn("pause", F.when(before.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), gap - (F.col("at") - before))))
