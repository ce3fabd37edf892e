"""The experiment from pages to cells, with injected models: statuses, errors of one layout, resuming, trials, replay."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fieldloom import responses
from fieldloom.plans import workflow
from fieldloom.plans.experiment import Config

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
PAGE = '<html><body><article><h1 class="title">Head {k}</h1><p>Text of page {k} that goes on</p><a href="/{k}">more</a></article></body></html>'


@pytest.fixture(scope="module")
def study_(spark):
    pages = spark.createDataFrame([(f"d{x}", f"l{x}", f"article_{k:03}.html", PAGE.format(k=k)) for x in "ab" for k in range(7)], "domain string, layout_id string, page string, html string")
    fields = spark.createDataFrame([(f"l{x}", f, kind, metric, False, True, i) for x in "ab" for i, (f, kind, metric) in enumerate([("title", "text", "rouge"), ("more", "url", "jaccard")])], "layout_id string, field string, type string, metric string, merge boolean, required boolean, ord int")
    gt = spark.createDataFrame([(f"l{x}", f, r) for x in "ab" for f, r in (("title", "h1"), ("more", "article a"))], "layout_id string, field string, rule string")
    return pages, fields, gt


def knows(call):
    assert call["fields"] == ["title", "more"] and "{skeleton}" not in call["prompt"] and call["domain"] in call["prompt"]
    return {"raw": json.dumps({"title": "h1.title", "more": "article a"}), "finish": "stop", "tokens_in": 900, "tokens_out": 10}


def knows_one(call):
    if call["layout_id"] == "lb":
        raise ConnectionError("refused")
    return knows(call)


def test_run_keeps_errors_to_their_layout_and_resumes(spark, study_, tmp_path):
    runs, cells = workflow.run(*study_, Config(cleaning="whitelist"), knows_one, "m", str(tmp_path), "e")
    assert {r.layout_id: (r.status, r.error) for r in runs.collect()} == {"la": ("done", ""), "lb": ("error", "ConnectionError: refused")}
    assert cells.count() == 14 and {r.label for r in cells.collect()} == {"MATCH"} and {r.layout_id for r in cells.collect()} == {"la"}
    scope = study_[0].select(F.lit("e").alias("exp_id"), "layout_id").distinct()
    assert tuple(workflow.progress(runs, scope).first()) == ("e", 2, 1, 2, "done")
    runs, cells = workflow.run(*study_, Config(cleaning="whitelist"), knows, "m", str(tmp_path), "e")
    assert cells.count() == 28 and runs.count() == 3 and sum(r.is_sample for r in cells.collect()) == 4
    assert tuple(workflow.progress(runs, scope).first()) == ("e", 2, 0, 2, "done")
    assert workflow.progress(runs.where("false"), scope).first().status == "interrupted"


def test_quick_trial_takes_five_pages_of_one_layout(study_):
    runs, cells = workflow.quick(*study_, Config(cleaning="none", skeleton=None), knows, "m", "la")
    assert runs.count() == 1 and cells.count() == 10 and cells.agg(F.avg("score")).first()[0] == 1.0


def test_generated_expressions_and_truncated_input(study_):
    cut = lambda call: {**knows(call), "tokens_in": 1026}
    config = Config(lang="regexn", max_pages=3)
    runs, cells = workflow.quick(*study_, config, knows, "m", "lb")
    assert runs.first().verified == {"title": True, "more": True} and cells.count() == 6 and {r.label for r in cells.collect()} == {"MATCH"}
    runs, cells = workflow.quick(*study_, Config(), cut, "m", "lb")
    assert (runs.first().status, runs.first().error, runs.first().truncated) == ("error", "input truncated", True) and cells.count() == 0


def test_repair_and_answers_cut_at_the_limit(study_):
    slips = lambda call: {"raw": '{"title": "article title", "more": "article.a"}', "finish": "stop"}
    pages, fields, _ = study_
    config = Config(cleaning="whitelist")
    found = workflow.detect_rules(workflow.samples_of(pages, config, "t"), fields, config, slips, repair=True).first()
    assert found.rules == {"title": "article title", "more": "article a"}
    found = workflow.detect_rules(workflow.samples_of(pages, config, "t"), fields, config, lambda c: {"raw": '{"title": "h1', "finish": "length"}).first()
    assert (found.status, found.error) == ("error", "No JSON found (output limit reached)")


def test_replayed_model():
    model = workflow.replayed([{"model": "m", "domain": "d", "match": "blog", "lang": "css", "rules": {"title": "h1"}}, {"model": "m", "domain": "d", "lang": "css", "rules": {"title": "h2", "body": "p"}}])
    ask = lambda prompt, domain="d": responses.parse_response(model({"model": "m", "domain": domain, "prompt": prompt, "lang": "css", "fields": ["title", "body"]})["raw"], ["title", "body"])[0]
    assert ask("a blog") == {"title": "h1", "body": ""} and ask("a shop") == {"title": "h2", "body": "p"}
    with pytest.raises(LookupError):
        ask("x", "other")


def test_prompts():
    assert responses.user_prompt("d.example", "<p>{domain}</p>", "xpath") == "Analyze this HTML skeleton from d.example and return XPath expressions as JSON:\n\n<p>{domain}</p>\n\nReturn only the JSON object."
    assert "raw HTML" in responses.user_prompt("d", "x", "regex", False) and responses.user_prompt("d", "x", template="{domain}: {skeleton} {other}") == "d: x {other}"
    assert responses.class_names("<a class='x y'><b class = \"z\">") == {"x", "y", "z"}
    assert responses.parse_response('{"a": }', None)[1].startswith("JSON parse error: ")
