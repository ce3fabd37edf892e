"""Rules judged on pages, and what is built on it: scores and labels, validation, suggestions, blocks, agreement per field, the reference table, owned rows."""

import difflib

import pytest
from pyspark.sql import functions as F

from fieldloom import css, extract, scoring
from fieldloom.operators import agreement, groundtruth, rules, summaries

HTML = """<h1 class="a b">Head line</h1><div><p>one two</p><p>three</p></div><img data-src="/x.jpg"><img src="/y.jpg"><i></i><i></i><nav><a href="/1">One</a></nav>"""


@pytest.fixture(scope="module")
def page():
    return extract.Page(HTML)


@pytest.mark.parametrize(("rule", "gt", "options", "score", "label"), [
    (None, "h1", {}, 0.0, "NULL"), ("", "h1", {"optional": True}, -1.0, "OPT_NULL"), ("h1[", "h1", {}, 0.0, "INVALID"), ("h2", "h1", {}, 0.0, "MISS"), ("h2", "h1", {"optional": True}, -1.0, "OPT_MISS"), ("//h1[", "h1", {"lang": "xpath", "gt_lang": "css"}, 0.0, "MISS"),
    ("h1", None, {}, -1.0, "NO_GT"), ("h1", "h1[", {}, -1.0, "GT_ERROR"), ("h1", "h2", {}, -1.0, "GT_MISS"), ("h1", "h2, h3", {}, 0.0, "WRONG"), ("h1", "p, h1", {}, 1.0, "MATCH"), ("//h1", "h1", {"lang": "xpath", "gt_lang": "css"}, 1.0, "MATCH"), ("<h1[^>]*>(.*?)</h1>", "h1", {"lang": "regex", "gt_lang": "css"}, 1.0, "MATCH"),
    ("div", "p", {}, 0.4, "CONTAINER"), ("p", "h1", {}, 0.0, "CONTAINER"), ("a", "h1", {}, 0.0, "WRONG"), ("i", "i", {}, 1.0, "MATCH"), ("img", "img", {"field": "images"}, 1.0, "MATCH"), ("img[src]", "img", {"field": "images"}, 0.5, "CONTAINER"),
])
def test_selector_scores(page, rule, gt, options, score, label):
    found = scoring.selector_score(page, rule, gt, **options)
    assert found[1] == label and abs(found[0] - score) < 1e-9


def test_sequence_ratio_and_the_skeleton(page):
    a, b = "Head line", "one two three"
    assert scoring.selector_score(page, "p", "h1", metric="seq")[0] == difflib.SequenceMatcher(None, a, b).ratio()
    assert scoring.selector_score(page, "nothing", "h1", mode="enriched") == (0.0, "MISS")


def test_validation(page):
    asked = [("a", "css", False, "h3, h1", None), ("b", "xpath", False, "//h1[", None), ("c", "xpath", False, "//p", "p"), ("d", "regex", False, "(", None), ("e", "css", True, "p, h1", None), ("f", "regex", False, "<p>(t.*?)</p>", "p"), ("g", "css", False, None, None)]
    found = {r[0]: r[1:] for r in scoring.validate(page, asked)}
    assert found["a"][:4] == (True, 1, ["Head line"], "h1") and found["e"][:3] == (True, 3, ["one two", "three", "Head line"])
    assert found["b"][4] and found["d"][4] and not found["a"][4] and not found["g"][4] and not found["g"][0]
    assert found["c"][5:] == (2, True, True) and found["f"][5:] == (2, False, False)


def test_suggestions_and_rewritten_tests(page):
    assert scoring.suggest_xpath(page, "h1.a") == ("//h1[contains(@class, 'a')]", True)
    assert scoring.suggest_xpath(None, "h1.a")[1] is None and scoring.suggest_xpath(page, "a:hover") == (None, False)
    tight = extract.Page('<p class="ab">1</p><p class="a">2</p>')
    assert scoring.suggest_xpath(tight, "p.a", True) == (css.readable_xpath("p.a", strict=True), True)
    path = scoring.token_tests("//h1[@class='b a']/text()")
    assert page.values(path, "xpath") == ["Head line"] and scoring.token_tests("//h1[@id='x']") == "//h1[@id='x']" and scoring.token_tests(None) is None
    assert scoring.joined_value(page, "p", "body", True) == ["one two three"] and scoring.joined_value(page, "img", "images") == ["/x.jpg", "/y.jpg"] and scoring.joined_value(page, "", "body") == []


def test_rules_over_pages_sent_and_joined(spark, monkeypatch):
    pages = spark.createDataFrame([("l", "p1", "<h1>a</h1>"), ("l", "p2", None), ("k", "p3", "<h1>c</h1>"), (None, "p4", "<h1>d</h1>")], "layout_id string, page string, html string")
    asked = spark.createDataFrame([("l", "r1", "css", "text", None, "h1", "r2"), ("l", "r2", "regex", "text", False, "<h1>(.*?)</h1>", None)], "layout_id string, rule_id string, lang string, kind string, merge boolean, rule string, ref string")
    expected = [("p1", "r1", ["a"], ["a"]), ("p1", "r2", ["a"], None), ("p2", "r1", [], []), ("p2", "r2", [], None)]
    for most in (100_000, 1):
        monkeypatch.setattr(extract, "MAX_SENT", most)
        assert sorted(map(tuple, extract.rule_values(pages, asked, ["layout_id"], ["page"]).collect()), key=str) == sorted(expected, key=str)
    assert extract.rule_values(pages.where("false"), asked, ["layout_id"], ["page"]).collect() == []


def test_blocks(spark):
    df = spark.createDataFrame([("l", "images", '["a", {"css": "b"}, {"image": "c"}]', False, True, True), ("l", "images", '{"css": "d"}', False, True, False), ("l", "title", "", False, False, False)], "layout_id string, field string, value string, merge boolean, optional boolean, blocks boolean")
    assert sorted((r.key, r.rule) for r in rules.block_rules(df).collect()) == [("images", "d"), ("images[0]", "a"), ("images[1]", "b"), ("images[2]", "c")]
    rewritten = rules.token_tests(spark.createDataFrame([("xpath", "//a[@class='x']"), ("css", "[class='x']"), ("xpath", None)], "lang string, rule string")).collect()
    assert [r.rule for r in rewritten][1:] == ["[class='x']", ""] and "normalize-space" in rewritten[0].rule


def test_reference_table(spark):
    texts = spark.createDataFrame([("l", "p", "f", "x", 0, "rx", "a b c", "a b d"), ("l", "p", "f", "y", 1, "ry", "a b d", "a b d"), ("l", "p", "f", "z", 2, "rz", "", "a b d"), ("l", "p", "g", "x", 0, "rx", "one two", None), ("l", "p", "g", "y", 1, "ry", "one", None), ("l", "p", "h", "x", 0, "rx", "alone", None)], "layout_id string, page string, field string, user string, ord int, rule string, text string, gt string")
    found = {(r.field, r.user): r for r in agreement.against_reference(texts).collect()}
    assert set(found) == {("f", "x"), ("f", "y"), ("g", "x"), ("g", "y"), ("h", "x")}
    x = found["f", "x"]
    assert (x.em, round(x.jac, 6), round(x.r1, 6), round(x.r2, 6), round(x.rl, 6), x.suggested_user, x.suggested_rule) == (0, 0.5, 0.666667, 0.5, 0.666667, "y", "ry")
    assert found["g", "x"].em == 0 and found["g", "x"].suggested_user == "x" and found["h", "x"].rl == 1.0


def test_field_study(spark):
    values = spark.createDataFrame([(u, "l", f"p{k}", "t", "rouge", v) for k in range(3) for u, v in (("a", ["x y"]), ("b", ["x y"]), ("c", [f"z{k}"]))], "user string, layout_id string, page string, field string, metric string, vals array<string>")
    ruled = spark.createDataFrame([("l", "t", "a", "h1"), ("l", "t", "b", "h1"), ("l", "t", "c", "h2"), ("k", "t", "a", "h1"), ("k", "t", "b", "h1"), ("m", "t", "a", None)], "layout_id string, field string, user string, rule string")
    r = agreement.field_study(agreement.pair_similarities(values), values, ruled).first()
    po, pe = (1 / 3 + 1) / 2, (16 + 1) / 25
    assert (r.field, r.metric, r.layouts, r.rule_po, r.rule_kappa, r.rule_exact_share, r.content_similarity, r.content_units) == ("t", "rouge", 2, round(po, 3), round((po - pe) / (1 - pe), 3), 0.5, 0.333, 3)


def test_owned_rows_and_names(spark):
    table = spark.createDataFrame([("a", "u", "1"), ("b", "v", "2"), ("c", None, "3")], "id string, owner string, body string")
    changes = spark.createDataFrame([("a", "put", "x", "9"), ("b", "delete", None, None), ("d", "put", "z", "4"), ("e", "delete", None, None)], "id string, op string, owner string, body string")
    assert sorted(map(tuple, groundtruth.change_owned(table, changes, "id", "u").collect())) == [("a", "u", "9"), ("b", "v", "2"), ("c", None, "3"), ("d", "u", "4")]
    assert sorted(r.id for r in groundtruth.change_owned(table, changes, "id", "w", True).collect()) == ["a", "c", "d"]
    names = spark.createDataFrame([("a.html",), ("..",), ("a/b",), ("a\\b",), ("",), (None,), ("c:d",), ("x" * 256,), ("nul\0",)], "n string")
    assert [r[0] for r in names.select(groundtruth.safe_name(F.col("n"))).collect()] == [True] + [False] * 8
    params = spark.createDataFrame([({"url": "x", "api_key": "s", "Authorization": "t", "max_tokens": "5", "token": "q"},)], "p map<string,string>")
    assert params.select(groundtruth.backend_snapshot(F.col("p")).alias("p")).first().p == {"url": "x", "max_tokens": "5"}
    nested = spark.createDataFrame([(1, ("q", 2))], "id int, config struct<lang:string,n:int>")
    assert groundtruth.slim(nested, ["id", "config.lang"]).columns == ["id", "lang"]
    again = summaries.rescored(spark.createDataFrame([("a", 0.5), ("b", 0.4)], "exp_id string, mean double"), spark.createDataFrame([("a", 0.3), ("b", 0.6)], "exp_id string, mean double"))
    assert sorted((r.exp_id, r.change, r.same_place) for r in again.collect()) == [("a", -0.2, False), ("b", 0.2, False)]
