"""Agreement between annotators: observed agreement, Fleiss' kappa, Krippendorff's alpha, and the study over rules and values.

Ratings are long: a row per subject and rating. Sums over categories are map-side combined counts, so a
category that holds most ratings is one number per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..shared import kept
from .summaries import pairs_of


def _counts(ratings: DataFrame, subject: list[str], category: str, by: list[str]) -> DataFrame:
    """Per subject of two ratings or more: n, and pairs that agree over all pairs."""
    rated = ratings.where(F.col(category).isNotNull() & (F.col(category).cast("string") != ""))
    per = rated.groupBy(*by, *subject, category).agg(F.count(F.lit(1)).alias("k_count"))
    each = per.groupBy(*by, *subject).agg(F.sum("k_count").alias("n"), F.sum(F.col("k_count") * F.col("k_count")).alias("squares")).where("n >= 2")
    return each.withColumn("po", (F.col("squares") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))


def observed_agreement(ratings: DataFrame, subject: list[str], category: str) -> DataFrame:
    """Share of pairs of ratings that are equal, per subject; subjects with fewer than two non-empty ratings are left out."""
    return _counts(ratings, subject, category, []).select(*subject, "n", F.round("po", 6).alias("po"))


def fleiss_kappa(ratings: DataFrame, subject: list[str], category: str, by: list[str] | None = None) -> DataFrame:
    """kappa, po, pe, n_subjects per group. Subjects weigh alike, chance goes by pooled categories; kappa is null for one subject and 1 where chance is certain."""
    by = by or []
    each = _counts(ratings, subject, category, by)
    rated = ratings.where(F.col(category).isNotNull() & (F.col(category).cast("string") != ""))
    whole = rated.groupBy(*by, category, *subject).agg(F.count(F.lit(1)).alias("k_count"))
    pooled = whole.join(each.select(*by, *subject), [*by, *subject], "left_semi").groupBy(*by, category).agg(F.sum("k_count").alias("k_count"))
    pe = pooled.groupBy(*by).agg((F.sum(F.col("k_count").cast("double") * F.col("k_count")) / F.pow(F.sum("k_count").cast("double"), F.lit(2.0))).alias("pe"))
    po = each.groupBy(*by).agg(F.avg("po").alias("po"), F.count(F.lit(1)).alias("n_subjects"))
    both = po.join(pe, by) if by else po.crossJoin(pe)
    kappa = F.when(F.col("n_subjects") < 2, None).when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)))
    return both.where("n_subjects > 0").select(*by, F.round(kappa, 6).alias("kappa"), F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), "n_subjects")


def nominal_alpha(ratings: DataFrame, unit: list[str], category: str) -> DataFrame:
    """Krippendorff's alpha for a distance of 0 or 1, exact, from counts alone; units with one value are left out."""
    per = ratings.groupBy(*unit, category).agg(F.count(F.lit(1)).alias("k_count"))
    units = per.groupBy(*unit).agg(F.sum("k_count").alias("m"), F.sum(F.col("k_count") * F.col("k_count")).alias("squares")).where("m >= 2")
    within = units.agg((F.sum((F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1)) / F.sum("m")).alias("d_o"), F.sum("m").cast("double").alias("n"), F.count(F.lit(1)).alias("units"))
    pooled = per.join(units.select(*unit), unit, "left_semi").groupBy(category).agg(F.sum("k_count").cast("double").alias("k_count")).agg(F.sum(F.col("k_count") * F.col("k_count")).alias("squares"))
    both = within.crossJoin(pooled).withColumn("d_e", (F.col("n") * F.col("n") - F.col("squares")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0.0)))
    alpha = F.when(F.col("d_e") == 0, 1.0).otherwise(1 - F.col("d_o") / F.nullif("d_e", F.lit(0.0)))
    return both.where("units > 0").select(F.round(alpha, 6).alias("alpha"), F.round("d_o", 6).alias("d_o"), F.round("d_e", 6).alias("d_e"), "units")


def pair_similarities(values: DataFrame) -> DataFrame:
    """Annotators paired within their cell: layout_id, page, field, metric, user_a, user_b, a, b, similarity; values: user, layout_id, page, field, metric, vals (null: no rule, so no value).

    A cell's values are gathered in one row (a value per annotator) and paired inside it.
    """
    key = ["layout_id", "page", "field"]
    cell = values.where("vals is not null").groupBy(*key).agg(F.collect_list(F.struct("user", "vals")).alias("all"), F.min("metric").alias("metric"))
    pairs = cell.select(*key, "metric", F.explode(pairs_of(F.col("all"), "user")).alias("p"))
    pairs = pairs.select(*key, "metric", F.col("p.a.user").alias("user_a"), F.col("p.b.user").alias("user_b"), F.col("p.a.vals").alias("a"), F.col("p.b.vals").alias("b"))
    pairs = pairs.withColumn("raw", m.raw_score(F.col("a"), F.col("b"), F.col("metric")))
    return pairs.withColumn("similarity", m.pair_similarity(F.col("raw"), F.col("a"), F.col("b"))).drop("raw")


def by_pair(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("user_a", "user_b").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("similarity"), 3).alias("similarity"))


def by_layout(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Content agreement of a layout, and the mean over its fields of the agreement on rules; rules: layout_id, field, user, rule (normalised)."""
    po = observed_agreement(rules, ["layout_id", "field"], "rule").groupBy("layout_id").agg(F.round(F.avg("po"), 3).alias("rule_agreement"))
    content = pairs.groupBy("layout_id").agg(F.countDistinct("page").alias("pages"), F.round(F.avg("similarity"), 3).alias("content_agreement"))
    users = rules.groupBy("layout_id").agg(F.countDistinct("user").alias("annotators"))
    return content.join(users, "layout_id", "left").join(po, "layout_id", "left")


def content_alpha(values: DataFrame, by: str = "field", max_pairs: int = 20_000) -> DataFrame:
    """Krippendorff's alpha of extracted values per field, distance 1 less similarity.

    Observed distances come from pairs within a cell. Expected ones come from the pool of all values:
    each value meets the next ones in an order by md5 (the first follow the last), as many as give about
    max_pairs pairs and one at least, or all of them where the pool has no more pairs than that.
    """
    key = ["layout_id", "page", "field"]
    said = values.where("vals is not null").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("m >= 2")
    # read six times below; pages are parsed once
    said = kept(said)
    distance = lambda pairs: pairs.withColumn("raw", m.raw_score(F.col("a"), F.col("b"), F.col("metric"))).withColumn("d", 1 - m.pair_similarity(F.col("raw"), F.col("a"), F.col("b")))
    inner = distance(said.select(*key, "metric", "m", F.col("user").alias("ua"), F.col("vals").alias("a")).join(said.select(*key, F.col("user").alias("ub"), F.col("vals").alias("b")), key).where("ua < ub"))
    observed = inner.groupBy(by).agg(F.sum(2 * F.col("d") / (F.col("m") - 1)).alias("s"))
    size = said.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*key).alias("units"))
    # places in the order: by slices of the hash, so that a field's values needn't meet in one task
    order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (*key, "user")]))
    sliced = said.select(by, "metric", "vals", *[c for c in (*key, "user") if c != by], order.alias("o")).withColumn("slice", F.substring("o", 1, 3))
    before = sliced.groupBy(by, "slice").agg(F.count(F.lit(1)).alias("k_count")).withColumn("before", F.sum("k_count").over(Window.partitionBy(by).orderBy("slice")) - F.col("k_count"))
    within = Window.partitionBy(by, "slice").orderBy("o", *key, "user")
    place = (F.col("before") + F.row_number().over(within) - 1).alias("place")
    pool = sliced.join(before.select(by, "slice", "before"), [by, "slice"]).select(by, "metric", "vals", place).join(size.select(by, "n"), by)
    whole = F.col("n") * (F.col("n") - 1) <= 2 * max_pairs
    steps = F.when(whole, F.col("n") - 1 - F.col("place")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(max_pairs) / F.col("n"))))
    meets = F.explode(F.when(steps > 0, F.transform(F.sequence(F.lit(1).cast("long"), steps.cast("long")), lambda x: (F.col("place") + x) % F.col("n"))))
    outer = distance(pool.select(by, "metric", F.col("vals").alias("a"), meets.alias("place")).join(pool.select(by, "place", F.col("vals").alias("b")), [by, "place"]))
    expected = outer.groupBy(by).agg(F.avg("d").alias("d_e"))
    both = observed.join(size, by).join(expected, by).withColumn("d_o", F.col("s") / F.col("n"))
    return both.select(by, F.round(F.when(F.col("d_e") == 0, 1.0).otherwise(1 - F.col("d_o") / F.nullif("d_e", F.lit(0.0))), 3).alias("alpha"), "units", F.col("n").alias("n_values"))


def _rounded(c: str) -> Column:
    return F.round(c, 3).alias(c)


def exact_share(rules: DataFrame, by: list[str], subject: list[str]) -> DataFrame:
    """Share of pairs of annotators of a subject whose rules are the same, over all pairs of a group; rules: by, subject, rule (normalised; null and empty ones are no rules). From counts, without pairs."""
    per = rules.where("coalesce(rule, '') <> ''").groupBy(*by, *subject, "rule").agg(F.count(F.lit(1)).alias("k_count"))
    each = per.groupBy(*by, *subject).agg(F.sum("k_count").alias("n"), F.sum(F.col("k_count") * (F.col("k_count") - 1)).alias("same"))
    return each.groupBy(*by).agg(F.round(F.sum("same") / F.nullif(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)), 3).alias("rule_exact_share"))


def field_study(pairs: DataFrame, values: DataFrame, rules: DataFrame, alpha: DataFrame | None = None) -> DataFrame:
    """Agreement per field: metric, layouts (subjects rated twice or more), kappa, observed agreement and exact share of rules, content alpha, units and mean similarity.

    pairs: pair_similarities(values). rules: layout_id, field, user, rule (normalised). alpha: content_alpha(values) if
    known already. A field without enough ratings has nulls.
    """
    kappa = fleiss_kappa(rules, ["layout_id"], "rule", ["field"]).select("field", F.col("n_subjects").alias("layouts"), F.round("kappa", 3).alias("rule_kappa"), F.round("po", 3).alias("rule_po"))
    alpha = (content_alpha(values) if alpha is None else alpha).select("field", F.col("alpha").alias("content_alpha"), F.col("units").alias("content_units"))
    similar = pairs.groupBy("field").agg(F.min("metric").alias("metric"), F.round(F.avg("similarity"), 3).alias("content_similarity"))
    df = rules.select("field").distinct()
    for part in (similar, kappa, exact_share(rules, ["field"], ["layout_id"]), alpha):
        df = df.join(part, "field", "left")
    return df.na.fill(0, ["layouts", "content_units"]).select("field", "metric", "layouts", "rule_kappa", "rule_po", "rule_exact_share", "content_alpha", "content_units", "content_similarity")


def pooled_kappa(rules: DataFrame) -> DataFrame:
    """Kappa per language and field with layouts as subjects; rules: layout_id, lang, field, user, rule."""
    return fleiss_kappa(rules, ["layout_id"], "rule", ["lang", "field"]).select("lang", "field", *[_rounded(c) for c in ("kappa", "po", "pe")], "n_subjects")


def against_reference(texts: DataFrame) -> DataFrame:
    """Each annotator's text of a cell against the reference: em, jac, r1, r2, rl, and in each row who comes closest (suggested_user, suggested_rule).

    texts: cell columns layout_id, page, field, user, ord, rule, text (null or empty: found nothing), gt (the approved rule's text, or null).
    Without one the reference is the first other text that differs, else the text itself. The best has the highest rl, of equal ones the first.
    """
    key = ["layout_id", "page", "field"]
    said = texts.where("coalesce(text, '') <> ''")
    cell = said.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ord", "user", "rule", "text"))).alias("all"), F.max(F.nullif("gt", F.lit(""))).alias("gt"))
    each = cell.select(*key, "all", "gt", F.explode("all").alias("me"))
    other = F.get(F.filter("all", lambda o: o["text"] != F.col("me.text")), F.lit(0))["text"]
    ref = F.coalesce("gt", other, F.col("me.text"))
    df = each.select(*key, F.col("me.user").alias("user"), F.col("me.ord").alias("ord"), F.col("me.rule").alias("rule"), F.col("me.text").alias("text"), ref.alias("ref"))
    df = df.withColumn("em", (F.col("text") == F.col("ref")).cast("int")).withColumn("by", m.text_measures("text", "ref")).select("*", "by.*")
    best = F.max_by(F.struct("user", "rule"), F.struct("rl", -F.col("ord"))).over(Window.partitionBy(*key))
    return df.withColumn("best", best).select(*key, "user", "em", "jac", "r1", "r2", "rl", F.col("best.user").alias("suggested_user"), F.col("best.rule").alias("suggested_rule"))
