"""Saving approved rules of layouts: refused while a field that is left out isn't confirmed; else decisions, notes, sources, times and pages change together.

All layouts of a save go through the same joins by layout and field, and by page for the assignments.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groundtruth import RULE, rule_sources, unapproved_fields

KEY = ["layout_id", "field"]
REASON_CHARS, NOTE_CHARS = 500, 1000


class Saved(NamedTuple):
    """refused: layout_id, unconfirmed (field, annotators). The rest are whole tables after the save: decisions: layout_id, field, by, at, reason, annotators. notes: layout_id, field, note. sources: layout_id, field, lang, normal, annotators. compiled: layout_id, lang, by, at. assignments: domain, page, layout_id, skipped."""

    refused: DataFrame
    decisions: DataFrame
    notes: DataFrame
    sources: DataFrame
    compiled: DataFrame
    assignments: DataFrame


def trimmed(c: Column, most: int | None) -> Column:
    """c without white space at its ends, of most characters at most, or whole with None; empty for null."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return text if most is None else F.substring(text, 1, most)


def compile_rules(layouts: DataFrame, selectors: DataFrame, user_rules: DataFrame, excluded: DataFrame, previous: dict[str, DataFrame], pages: DataFrame, by: str, at: str, reason_chars: int | None = REASON_CHARS, note_chars: int | None = NOTE_CHARS) -> Saved:
    """Approves rules for the given layouts (layout_id) in one save, as by at the time at.

    selectors: layout_id, field, lang, rule, normal, note. user_rules: layout_id, field, user, lang, rule, normal.
    excluded: layout_id, field, reason: fields left out on purpose, confirmed even without a reason. previous: the
    tables of the last save by name (decisions, notes, compiled, assignments). pages: layout_id, domain, page.

    A field that annotators wrote rules for, without an approved one and not excluded, refuses its layout, which stays as it was.
    A decision with the same reason and annotators keeps who made it and when. An approved rule's sources are the
    annotators who wrote it. The layout's pages are replaced by those given, which leave any other layout.
    """
    missing = unapproved_fields(user_rules.join(layouts, "layout_id", "left_semi"), selectors)
    told = excluded.groupBy(*KEY).agg(F.max("reason").alias("reason"), F.lit(True).alias("confirmed"))
    asked = missing.join(told, KEY, "left").withColumn("reason", trimmed(F.col("reason"), reason_chars))
    refused = asked.where("confirmed is null").groupBy("layout_id").agg(F.sort_array(F.collect_list(F.struct("field", "annotators"))).alias("unconfirmed"))
    saved = layouts.select("layout_id").distinct().join(refused, "layout_id", "left_anti")
    mine, rest = (lambda df: df.join(saved, "layout_id", "left_semi")), (lambda name: previous[name].join(saved, "layout_id", "left_anti"))

    was = previous["decisions"].select(*KEY, F.col("by").alias("was_by"), F.col("at").alias("was_at"), F.col("reason").alias("was_reason"), F.col("annotators").alias("was_annotators"))
    same = F.coalesce((F.col("was_reason") == F.col("reason")) & (F.col("was_annotators") == F.col("annotators")), F.lit(False))
    kept = lambda old, new: F.when(same, F.col(old)).otherwise(F.lit(new))
    decided = mine(asked).join(was, KEY, "left").select(*KEY, kept("was_by", by).alias("by"), kept("was_at", at).alias("at"), "reason", "annotators")

    approved = mine(selectors).where(RULE)
    notes = mine(selectors).select(*KEY, trimmed(F.col("note"), note_chars).alias("note")).where("note <> ''")
    compiled = approved.select("layout_id", "lang").distinct().select("layout_id", "lang", F.lit(by).alias("by"), F.lit(at).alias("at"))
    given = mine(pages).select("domain", "page", "layout_id", F.lit(False).alias("skipped"))
    stay = previous["assignments"].join(saved.withColumn("saved", F.lit(True)), "layout_id", "left").where("saved is null").select("domain", "page", "layout_id", "skipped")
    return Saved(
        refused, rest("decisions").unionByName(decided), rest("notes").unionByName(notes), rule_sources(approved, user_rules), rest("compiled").unionByName(compiled),
        stay.join(given, ["domain", "page"], "left_anti").unionByName(given),
    )
