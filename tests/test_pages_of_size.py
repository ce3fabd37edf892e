"""What the driver's larger tables showed: cut references, addresses that several pages have."""

import re

import pandas as pd
import pytest
import twins

from fieldloom.queries import QUERIES, SQL

CUT = "Bleiner&amp;&amp;&amp; ores*** anndenti&amp;&amp;&amp"
LONG = "<p>word</p>" * 100


def tables(spark, folder, urls, htmls):
    rows = [(k + 1, u, h) for k, (u, h) in enumerate(zip(urls, htmls, strict=True))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    # DuckDB reads one file by the name of the table
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(f"{folder}/plain.parquet")
    return folder


def assert_twins(spark, folder, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{folder}/plain.parquet'")
    a, b = QUERIES[name](spark, str(folder)).toPandas(), c.sql(SQL[name]).df()
    columns = sorted(a.columns)
    assert len(a) and twins.rows(a, columns) == twins.rows(b, columns)


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    page = lambda x: f'<html><head><title>{x}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><article><h1>{x}</h1><p>one &amp; two</p></article><div class="ad">Buy &lt;now&gt;</div><footer>© {x}</footer></body></html>'
    return tables(spark, tmp_path_factory.mktemp("cut"), ["https://www.a.example/en/1", "https://b.example/de/2"], [page(CUT), page("plain &#39;title&#39;")])


@pytest.mark.parametrize("name", ["alternative_values", "css_values_long", "export_page_values", "html_to_text", "joined_values", "regex_values_long", "rule_validation", "selector_scores", "sql_rule_values", "weak_css_values_long", "xpath_values_long"])
def test_cut_references(spark, cut, name):
    assert_twins(spark, cut, name)


def test_pages_of_one_address(spark, tmp_path):
    urls = ["https://abcdefghij/en/x", "https://abcdefghij/en/x", "https://abcdefghij/en/y", "https://abcdefghij/en/x", "https://abcdefghij/en/x"]
    assert_twins(spark, tables(spark, tmp_path, urls, [LONG, "short", LONG + "<p>more</p>", LONG + "<p>three</p>", "<p>five</p>" * 300]), "fetched_pages")


def test_exported_pages_of_one_name(spark, tmp_path):
    """Names have six digits, so those of larger numbers are cut; before, the values of such pages met in one map."""
    page = lambda x: f'<html><head><title>{x}</title></head><body><nav><ul><li><a href="/{x}">a</a></li></ul></nav><article><h1>{x}</h1></article></body></html>'
    rows = [(1234561, "https://a.example/en/1", page("x")), (1234567, "https://a.example/en/2", page("y")), (123456, "https://b.example/de/3", page("z"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(f"{tmp_path}/plain.parquet")
    assert_twins(spark, tmp_path, "export_page_values")


def test_exported_values_do_not_shuffle(spark, sf):
    plan = QUERIES["export_page_values"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan and "Join" not in plan


def longest_common(p, q):
    row = [0] * (len(q) + 1)
    for w in p:
        row = [0, *(m := row)][: len(q) + 1]
        for j, v in enumerate(q, 1):
            row[j] = m[j - 1] + 1 if w == v else max(m[j], row[j - 1])
    return row[-1]


def test_common_subsequence_by_bits():
    import random

    from fieldloom.functions.bags import lcs_f1

    draw = random.Random(5)
    for _ in range(300):
        p, q = ([draw.choice("abcdefg") for _ in range(draw.randrange(1, 90))] for _ in range(2))
        p, q = p, q[: draw.randrange(1, 90)]
        assert lcs_f1(p, q) == 2 * longest_common(p, q) / (len(p) + len(q))
    assert (lcs_f1([], []), lcs_f1(["a"], []), lcs_f1(["a", "b"], ["c"])) == (1.0, 0.0, 0.0)


def test_scores_in_python_are_those_of_columns(spark):
    from pyspark.sql import functions as F

    from fieldloom.functions import metrics as m
    from fieldloom.functions.bags import score_of

    sides = [[], [""], ["a b", "B a"], ["A  b"], ["b\xa0a", "c"], ["bac"], ["b a", "c\x1c"], [" a b B a "], ["a b B a"]]
    rows = [(g, p, k) for g in sides for p in sides for k in ("rouge", "jaccard", "exact_match", None)]
    found = spark.createDataFrame(rows, "gt array<string>, pred array<string>, metric string").withColumn("raw", m.raw_score(F.col("gt"), F.col("pred"), F.col("metric"))).collect()
    assert [r["raw"] for r in found] == [score_of(r["gt"], r["pred"], r["metric"]) for r in found]


def test_results_leave_in_slices(spark, cut, monkeypatch):
    from fieldloom import extract

    whole = sorted(map(tuple, QUERIES["css_values_long"](spark, str(cut)).collect()))
    monkeypatch.setattr(extract, "HELD_CHARS", 1)
    assert sorted(map(tuple, QUERIES["css_values_long"](spark, str(cut)).collect())) == whole


@pytest.mark.parametrize("name", ["heat_map", "gap_quartiles", "label_histogram", "reference_support", "class_tests_rescored"])
def test_cells_are_scored_where_pages_are_read(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "word_f1" not in plan


@pytest.mark.parametrize("name", ["over_extraction", "coverage_reasons"])
def test_texts_of_counted_values_stay_in_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    made = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "n_pred#" in made and "pred#" not in made.replace("n_pred#", "") and "gt#" not in made.replace("n_gt#", "")


#: Their Python hands on numbers alone, page by page; before, the texts of all cells of a batch went out and came back to be scored.
SUMMARIES = ["layout_summary", "layouts_won", "leaderboard", "reference_points", "experiment_breakdown", "experiment_summary", "match_rate"]


@pytest.mark.parametrize("name", SUMMARIES)
def test_summaries_get_numbers_from_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(made) == 1 and "ArrowEvalPython" not in plan
    out = set(re.findall(r"(\w+)#", made[0][made[0].rindex("[") :]))
    assert out == {"layout_id", "page", "exp_id", "field", "metric", "n_gt", "n_pred", "raw"}


def test_cross_check_scores_only_pairs_after_the_shuffle(spark, sf):
    """Against the ground truth cells are scored where the page is read; before, those texts went to Python once more."""
    plan = QUERIES["cross_check_fields"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("MapInArrow") == 1 and plan.index("ArrowEvalPython") < plan.index("collect_list") < plan.index("MapInArrow")


def test_counts_stand_for_values(spark):
    from fieldloom.operators import summaries

    rows = [("e", "l", "p", "ad", [], ["x"]), ("e", "l", "q", "ad", ["y"], []), ("e", "l", "r", "ad", None, None), ("e", "l", "p", "title", ["t"], ["t"])]
    values = spark.createDataFrame(rows, "exp_id string, layout_id string, page string, field string, gt array<string>, pred array<string>")
    counts = values.selectExpr("exp_id", "layout_id", "page", "field", "if(gt is null, null, size(gt)) as n_gt", "if(pred is null, null, size(pred)) as n_pred")
    rules = spark.createDataFrame([("l", "ad")], "layout_id string, field string")
    for f in (summaries.coverage_reasons, summaries.over_extraction):
        assert sorted(map(tuple, f(values, rules).collect())) == sorted(map(tuple, f(counts, rules).collect()))
    assert sorted(map(tuple, summaries.coverage_reasons(counts, rules).collect())) == [("l", "ad", "no_page", 1), ("l", "ad", "rule_found_nothing", 1), ("l", "ad", "scored", 1), ("l", "title", "no_rule", 1)]


def test_comparison_reads_pages_once(spark, sf):
    assert QUERIES["compare_two"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_comparison_keeps_common_layouts(spark):
    from fieldloom.operators import summaries

    rows = [("a", "l", 0.5), ("b", "l", 0.75), ("a", "only a", 1.0), ("b", "only b", 1.0), ("a", "no mean", None), ("b", "no mean", 0.25), ("a", None, 1.0), ("b", None, 1.0), ("c", "l", 0.0)]
    cells = spark.createDataFrame([(e, x, "p", "f", s, True) for e, x, s in rows], "exp_id string, layout_id string, page string, field string, score double, is_sample boolean")
    assert [tuple(r) for r in summaries.compare(cells, "a", "b").select("layout_id", "mean_a", "mean_b", "delta").collect()] == [("l", 0.5, 0.75, 0.25), ("no mean", None, 0.25, None)]
    assert [tuple(r) for r in summaries.compare(cells, "a", "a").select("layout_id", "delta").collect()] == [("l", 0.0), ("only a", 0.0), ("no mean", None)]
