"""Saves of approved rules, proposals, coverage, reference points and rewritten rules on small tables, odd rows among them."""

import difflib

import pytest
from pyspark.sql import functions as F
from test_study import rows

from fieldloom import scoring
from fieldloom.extract import Page
from fieldloom.functions import metrics as m
from fieldloom.operators import compiling, groundtruth, rules as ruling, summaries
from fieldloom.plans import experiment

RULES = "layout_id string, field string, user string, lang string, rule string, normal string"
PICKED = "layout_id string, field string, lang string, rule string, normal string, note string"
DECIDED = "layout_id string, field string, by string, at string, reason string, annotators array<string>"
EMPTY_SAVE = {"decisions": DECIDED, "notes": "layout_id string, field string, note string", "compiled": "layout_id string, lang string, by string, at string", "assignments": "domain string, page string, layout_id string, skipped boolean"}


@pytest.fixture
def save(spark):
    def run(layouts, selectors, users, excluded, pages=(), previous=None, **options):
        make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        was = {k: make((previous or {}).get(k, []), s) for k, s in EMPTY_SAVE.items()}
        return compiling.compile_rules(
            make([(x,) for x in layouts], "layout_id string"), make(selectors, PICKED), make(users, RULES), make(excluded, "layout_id string, field string, reason string"), was,
            make(pages, "layout_id string, domain string, page string"), "me", "now", **options,
        )

    return run


USERS = [("l", "a", "u", "css", "h1", "h1"), ("l", "b", "v", "css", "p", "p"), ("l", "b", "u", "css", "q", "q"), ("l", "c", "u", "css", "", ""), ("l", "d", "u", "css", None, None), ("k", "a", "u", "css", "h1", "h1")]


def test_an_unconfirmed_field_refuses_its_layout_alone(save):
    old = {"decisions": [("l", "b", "x", "then", "why", ["u"])], "notes": [("l", "a", "old")], "compiled": [("l", "css", "x", "then")], "assignments": [("s", "1", "l", False)]}
    done = save("lk", [("l", "a", "css", "h1", "h1", "n"), ("k", "a", "xpath", "//h1", "//h1", " note ")], USERS, [], [("l", "s", "2"), ("k", "s", "3")], old)
    assert rows(done.refused) == [("l", [("b", ["u", "v"])])]
    assert rows(done.decisions) == [("l", "b", "x", "then", "why", ["u"])]
    assert rows(done.notes) == [("k", "a", "note"), ("l", "a", "old")]
    assert rows(done.compiled) == [("k", "xpath", "me", "now"), ("l", "css", "x", "then")]
    assert rows(done.assignments) == [("s", "1", "l", False), ("s", "3", "k", False)]
    assert rows(done.sources, "layout_id", "field", "annotators") == [("k", "a", [])]  # the administrator's: none wrote it as XPath


def test_unchanged_decisions_keep_who_made_them(save):
    picked = [("l", "a", "css", "h1", "h1", None)]
    old = lambda reason, who: {"decisions": [("l", "b", "x", "then", reason, who)]}
    kept = save("l", picked, USERS, [("l", "b", "  no\n")], previous=old("no", ["u", "v"]))
    assert rows(kept.decisions) == [("l", "b", "x", "then", "no", ["u", "v"])] and rows(kept.sources, "field", "annotators") == [("a", ["u"])]
    for was in (old("other", ["u", "v"]), old("no", ["u"]), None):
        assert rows(save("l", picked, USERS, [("l", "b", "no")], previous=was).decisions) == [("l", "b", "me", "now", "no", ["u", "v"])]
    # confirmed twice, and without a reason; a decision on a field that is approved now goes
    assert rows(save("l", picked, USERS, [("l", "b", None), ("l", "b", None)]).decisions, "reason") == [("",)]
    assert rows(save("l", [*picked, ("l", "b", "css", "p", "p", "")], USERS, [], previous=old("no", ["u", "v"])).decisions) == []


def test_reasons_are_cut_or_whole(save):
    long = "x" * 2000
    picked = [("l", "a", "css", "h1", "h1", long)]
    cut, whole = save("l", picked, USERS, [("l", "b", long)]), save("l", picked, USERS, [("l", "b", long)], reason_chars=None, note_chars=None)
    assert rows(cut.decisions.select(F.length("reason"))) == [(500,)] and rows(cut.notes.select(F.length("note"))) == [(1000,)]
    assert rows(whole.decisions, "reason") == [(long,)] and rows(whole.notes, "note") == [(long,)]


def test_pages_are_replaced_and_leave_other_layouts(save):
    old = {"assignments": [("s", "1", "l", False), ("s", "2", "k", True), ("s", "3", "k", False), ("t", "2", "k", False), ("s", "9", None, True)]}
    done = save("l", [("l", "a", "css", "h1", "h1", None), ("l", "b", "css", "p", "p", None)], USERS, [], [("l", "s", "2"), ("l", "s", "4")], old)
    assert rows(done.assignments) == [("s", "2", "l", False), ("s", "3", "k", False), ("s", "4", "l", False), ("s", "9", None, True), ("t", "2", "k", False)]


def test_saves_of_nothing(save):
    for table in save("", [], [], []):
        assert table.count() == 0


def test_proposals_with_agreement(spark):
    rules = [("l", "a", "u", 1, "x>y", "x > y"), ("l", "a", "v", 2, "x > y", "x > y"), ("l", "a", "w", 3, "z", "z"), ("l", "b", "u", 1, "z", "z"), ("l", "c", "u", 1, "", None), ("k", "b", "u", 1, "z", "z")]
    df = spark.createDataFrame(rules, "layout_id string, field string, user string, ord int, rule string, normal string")
    assert rows(groundtruth.rule_suggestions(df)) == [("k", "b", "z", "u", None, None), ("l", "a", "x>y", "u", 0.333333, 0.333333), ("l", "b", "z", "u", None, 0.333333)]


def test_coverage_by_reason(spark):
    cells = [("l", str(p), f, g) for p in range(3) for f, g in (("a", ["x"] if p else []), ("b", []), ("c", None), ("d", []))]
    rules = lambda r: spark.createDataFrame(r, "layout_id string, field string, user string, rule string")
    table = summaries.coverage_table(
        spark.createDataFrame(cells, "layout_id string, page string, field string, gt array<string>"), rules([("l", "a", None, "h1"), ("l", "b", None, "")]), rules([("l", "b", "u", "p"), ("l", "b", "t", "p"), ("l", "d", "u", None)]),
        spark.createDataFrame([("l", "c"), ("l", "c"), ("l", "a")], "layout_id string, field string"), spark.createDataFrame([("l", "a", [])], "layout_id string, field string, annotators array<string>"),
    )
    assert rows(table, "field", "pages", "scored", "not_scored", "status", "annotators_with_rule", "source") == [
        ("a", 3, 2, 1, "reference rule", "", "administrator"), ("b", 3, 0, 3, "annotator rule without a decision", "t u", ""), ("c", 3, 0, 3, "left out by the administrator", "", ""), ("d", 3, 0, 3, "no rule by any annotator", "", ""),
    ]
    totals = {(k, n): c for k, n, c in rows(summaries.coverage_totals(table))}
    assert totals[("pairs", "all")] == 12 and totals[("pairs", "scored")] == 2 and totals[("rules", "administrator")] == 1 and totals[("not_scored", "reference rule returns no value on the page")] == 1
    assert {n for (k, _), n in totals.items() if k == "not_scored"} == {1, 3}
    assert rows(summaries.coverage_totals(table.limit(0))) == [("pairs", "all", 0), ("pairs", "not_scored", 0), ("pairs", "scored", 0), ("rules", "administrator", 0), ("rules", "approved", 0)]


def test_reference_points_are_means_of_layout_means(spark):
    cells = [("e", "l", "1", "a", 1.0, True), ("e", "l", "2", "a", 0.0, False), ("e", "l", "2", "b", None, False), ("e", "k", "1", "a", 1.0, True)]
    df = spark.createDataFrame(cells, "exp_id string, layout_id string, page string, field string, score double, is_sample boolean")
    assert rows(summaries.reference_points(df)) == [("e", "a", 75.0, 100.0, 0.0), ("e", "b", None, None, None), ("e", None, 75.0, 100.0, 0.0)]


def test_rewritten_rules_are_scored_beside_the_written_ones(spark):
    html = "<div class='x ad  big'>one</div><p class='ad'>two</p><div class='ads'>three</div>"
    pages = spark.createDataFrame([("l", "1", html), ("k", "1", "")], "layout_id string, page string, html string")
    fields = spark.createDataFrame([(lay, "a", "text", "exact_match", False) for lay in "lk"], "layout_id string, field string, type string, metric string, merge boolean")
    gt = spark.createDataFrame([("l", "a", "div.ad"), ("k", "a", "div.ad")], "layout_id string, field string, rule string")
    models = [("e", "l", "a", "xpath", "//div[@class='ad']"), ("f", "l", "a", "css", "div.ad"), ("g", "l", "a", "xpath", None), ("h", "l", "a", "xpath", "//div[@class='big x']"), ("h", "k", "a", "xpath", "//div")]
    out = experiment.rewritten(pages, fields, gt, spark.createDataFrame(models, "exp_id string, layout_id string, field string, lang string, rule string"), ruling.token_tests)
    assert rows(out, "exp_id", "mean_before", "mean_after", "change", "changed")[:3] == [("e", 0.0, 1.0, 1.0, 1), ("f", 1.0, 1.0, 0.0, 0), ("g", 0.0, 0.0, 0.0, 0)]
    assert rows(out, "exp_id", "mean_before", "mean_after")[3] == ("h", 0.0, 1.0)


def test_texts_are_compared_as_far_as_asked(spark):
    a, b = "a" * 6000 + "b" * 3000, "a" * 6000 + "c" * 3000
    page = Page(f"<h1>{a}</h1><h2>{b}</h2>")
    assert scoring.selector_score(page, "h1", "h2", metric="seq")[0] == 1.0
    assert scoring.selector_score(page, "h1", "h2", metric="seq", most_chars=None)[0] == difflib.SequenceMatcher(None, b, a).ratio() < 0.7
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows(df.select(m.sequence_ratio("a", "b"), m.sequence_ratio_within(None)("a", "b"))) == [(1.0, difflib.SequenceMatcher(None, a, b).ratio())]
