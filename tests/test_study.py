"""Readers, workflow, ground truth, maintenance, exports, streams and SQL functions on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom import sql, study
from fieldloom.functions import metrics as m
from fieldloom.operators import agreement, groundtruth, maintenance, summaries
from fieldloom.plans import experiment
from fieldloom.sinks import exports
from fieldloom.sources import study as sources
from fieldloom.streaming import incremental


def rows(df, *names):
    return sorted(map(tuple, (df.select(*names) if names else df).collect()), key=repr)


@pytest.mark.parametrize(("gt", "pred", "metric", "score", "label"), [
    (["a b"], ["a b"], "rouge", 1.0, "MATCH"), (["a b"], ["b c"], "rouge", 0.5, "PARTIAL"), (["a"], ["b"], "f1", 0.0, "WRONG"), ([], ["x"], "rouge", None, "NO_GT"), (["x"], [], "rouge", 0.0, "MISS"), (None, None, "rouge", None, "NO_GT"),
    (["a b", "c"], ["c", "ab"], "jaccard", 1.0, "MATCH"), (["a", "b"], ["b", "c"], "jaccard", 0.3333, "PARTIAL"), (["a  b"], ["a b"], "exact_match", 1.0, "MATCH"), (["A"], ["a"], "exact_match", 0.0, "WRONG"), (["a a"], ["a"], "rouge", 0.6667, "PARTIAL"),
])
def test_scores(spark, gt, pred, metric, score, label):
    df = spark.createDataFrame([(gt, pred, metric)], "gt array<string>, pred array<string>, metric string")
    out = summaries.score_cells(df).first()
    assert (out.score, out.label) == (score, label)


def test_three_conventions_for_nothing(spark):
    df = spark.createDataFrame([([], []), ([], ["x"]), (["x"], ["x"])], "a array<string>, b array<string>")
    raw = m.raw_score(F.col("a"), F.col("b"), F.lit("rouge"))
    out = df.select(m.jaccard(F.col("a"), F.col("b")), m.pair_agreement(raw, F.col("a"), F.col("b")), m.pair_similarity(raw, F.col("a"), F.col("b"))).collect()
    assert list(map(tuple, out)) == [(1.0, None, 1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        m.rouge_l(F.lit("a b c d"), F.lit("a x c d")).alias("l"), m.dates_match(F.lit("May 3, 2024"), F.lit("2024-05-03")).alias("d"), m.input_truncated(F.lit(9000), F.lit(2051)).alias("t"), m.input_truncated(F.lit(4000), F.lit(1500)).alias("u"),
        m.retry_wait(F.lit(None), F.lit(1)).alias("w"), m.retry_wait(F.lit(99), F.lit(0)).alias("x"), m.same_texts(F.array(F.lit("a b"), F.lit("c")), F.array(F.lit("c"), F.lit("ab"))).alias("s"), m.reduction_pct(F.lit(0), F.lit(0)).alias("r"),
        m.first_sentence(F.lit("Ab! c")).alias("f"), m.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("q"), m.image_label(F.array(F.lit("a")), F.array(F.lit("a")))["label"].alias("i"), m.utc(F.lit("2024-01-02T03:04:05")).cast("string").alias("z"),
    ).first()
    assert row.asDict() == {"l": 0.75, "d": True, "t": True, "u": False, "w": 20.0, "x": 60.0, "s": True, "r": 0.0, "f": "Ab!", "q": 0.75, "i": "PARTIAL", "z": "2024-01-02 03:04:05"}


def test_agreement_by_hand(spark):
    r = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "d"), (3, "e"), (4, "x"), (5, None)], "s int, c string")
    k = agreement.fleiss_kappa(r, ["s"], "c").first()
    assert (k.po, k.n_subjects) == (round((1 / 3 + 1 + 0) / 3, 6), 3) and k.pe == round((4 + 1 + 4 + 1 + 1) / 49, 6)
    assert agreement.fleiss_kappa(r.where("s = 1"), ["s"], "c").first().kappa is None and agreement.fleiss_kappa(r.where("s > 3"), ["s"], "c").collect() == []
    a = agreement.nominal_alpha(r.where("c is not null"), ["s"], "c").first()
    within = (2 * 2 / 2 + 0 + 2 * 1 / 1) / 7
    assert a.d_o == round(within, 6) and a.units == 3
    assert agreement.nominal_alpha(spark.createDataFrame([(1, "a"), (1, "a")], "s int, c string"), ["s"], "c").first().alpha == 1.0


def test_exclusive_quartiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 7.0, 11.0],)], "v array<double>")
    assert [df.select(summaries.exclusive_quantile(F.col("v"), p)).first()[0] for p in (0.25, 0.5, 0.75)] == [1.5, 4.0, 9.0]


def test_run_resumes(spark, sf, tmp_path):
    p = study.pages(spark, sf)
    gt = study.ruled(p, {"gt": ("css", study.GT)}, "owner").select("layout_id", "field", "rule")
    rules = study.ruled(p, study.MODELS, "exp_id")
    samples = experiment.sample_pages(p.select("domain", "layout_id", "page").withColumn("domain", F.lit("d")))
    path, html = str(tmp_path / "cells"), p.select("layout_id", "page", "html")
    first = experiment.run(html, study.fields(p), gt, rules.where("layout_id = 'layout-en'"), samples, path).count()
    whole = experiment.run(html, study.fields(p), gt, rules, samples, path)
    assert first < whole.count() == p.count() * len(study.FIELDS) * len(study.MODELS)
    assert experiment.run(html, study.fields(p), gt, rules, samples, path).count() == whole.count()
    assert rows(summaries.experiment_summary(whole)) == rows(summaries.experiment_summary(study.cells(spark, sf)))
    best = summaries.leaderboard(whole).where("is_best").first()
    assert best.mean == 1.0 and best.exp_id != "weak-css"


def test_random_samples_follow_the_seed(spark):
    scope = spark.createDataFrame([("d", "l", f"p{k}") for k in range(20)], "domain string, layout_id string, page string")
    import random

    expected = random.Random("7|d|l").choice(sorted(f"p{k}" for k in range(20)))
    assert experiment.sample_pages(scope, experiment.Config(sample="random", seed=7)).first().sample_page == expected
    with pytest.raises(ValueError):
        experiment.Config(lang="sql")


def test_group_status(spark):
    runs = spark.createDataFrame([("g", "done"), ("g", "queued"), ("h", "done"), ("h", "error")], "group_id string, status string")
    assert rows(experiment.status(runs), "group_id", "status") == [("g", "queued"), ("h", "error")]


def test_sources(spark, tmp_path):
    (tmp_path / "raw" / "a.example").mkdir(parents=True)
    (tmp_path / "raw" / "a.example" / "article_001.html").write_bytes(b"<p>caf\xe9 ok</p>")
    assert rows(sources.page_files(spark, str(tmp_path / "raw")), "domain", "page", "html") == [("a.example", "article_001.html", "<p>caf ok</p>")]
    (tmp_path / "s.json").write_text(json.dumps({"countries": [{"country": "X", "code": "XX", "language": "en", "sites": [{"name": "A", "url": "https://www.a.example/x"}]}]}))
    (tmp_path / "bad.json").write_text("{")
    listed = sources.documents(spark, str(tmp_path / "*.json"), sources.SITES)
    assert listed.count() == 1
    found = sources.sites(listed, spark.createDataFrame([("a.example",), ("b.example",)], "domain string"))
    assert rows(found, "domain", "name", "url", "language", "has_meta") == [("a.example", "A", "https://www.a.example/x", "en", True), ("b.example", "b.example", "https://b.example", "", False)]
    forms = spark.createDataFrame([("l", {"a": "h1", "b": '{"css": "x", "xpath": "//x"}', "c": '["p", null, "q"]', "d": "", "e": "[data-x]"})], "layout_id string, selectors map<string,string>")
    assert rows(sources.long_rules(forms, ["layout_id"]), "field", "lang", "rule") == [("a", "css", "h1"), ("b", "css", "x"), ("b", "xpath", "//x"), ("c", "css", "p, q"), ("e", "css", "[data-x]")]
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00  COMPILE  user=u  domain=d  layout=l"), (2, "x"), (3, "2024-01-02 00:00:00  COMPILE  by=v  domain=d  layout=l")], "line_no long, value string")
    entries = sources.audit_entries(log)
    assert [r.user for r in entries.collect()] == ["v", "u"] and str(sources.last_compilations(entries).first().compiled_at) == "2024-01-02 00:00:00"
    status = spark.createDataFrame([(True, 200, False), (True, 404, False), (True, 500, True), (False, 500, False)], "e boolean, s int, a boolean")
    assert [r[0] for r in status.select(sources.robots_decision(F.col("e"), F.col("s"), F.col("a"))).collect()] == [False, True, False, True]


def test_maintenance(spark):
    sites = spark.createDataFrame([("a", "X"), ("b", "Y")], "domain string, country string")
    assert rows(maintenance.upsert(sites, spark.createDataFrame([("a", "Z"), ("c", "Z")], "domain string, country string"), ["domain"])) == [("a", "Z"), ("b", "Y"), ("c", "Z")]
    pages = spark.createDataFrame([("a", f"article_{k:03}.html") for k in (1, 2, 4)] + [("b", "x.html"), ("c", "article_002.html")], "domain string, page string")
    assert rows(maintenance.next_number(pages, "article")) == [("a", 3), ("b", 1), ("c", 1)]
    assigned = spark.createDataFrame([("a", "p", "l"), ("a", "q", "k")], "domain string, page string, layout_id string")
    assert rows(maintenance.delete_layouts(assigned, spark.createDataFrame([("a", "l")], "domain string, layout_id string"))) == [("a", "p", None), ("a", "q", "k")]
    registered = spark.createDataFrame([("o", "m", False, True), ("o", "n", False, False), ("o", "h", True, False)], "backend string, model string, hidden boolean, is_default boolean")
    installed = spark.createDataFrame([("o", "m", True), ("o", "i", True)], "backend string, model string, reachable boolean")
    assert rows(maintenance.model_catalog(installed, registered), "model", "offered") == [("h", False), ("i", True), ("m", True), ("n", False)]
    both = maintenance.effective_parameters(spark.createDataFrame([("o", {"t": "0", "s": "1"})], "backend string, params map<string,string>"), spark.createDataFrame([("o", "m", {"t": "2"})], "backend string, model string, model_params map<string,string>"))
    assert both.first().params == {"s": "1", "t": "2"}


def test_ground_truth(spark):
    layouts = spark.createDataFrame([("d", "l", None, "", "article"), ("d", "k", "K", "other", "x"), ("d", "j", None, None, "none")], "domain string, layout_id string, name string, template_id string, page_type string")
    rules = spark.createDataFrame([("d", "l", "css", "h1"), ("d", "k", "css", ""), ("d", "j", "css", "h1")], "domain string, layout_id string, lang string, rule string")
    scope = spark.createDataFrame([("d", "l", "p"), ("d", "k", "q"), ("d", "j", "r")], "domain string, layout_id string, page string")
    templates = spark.createDataFrame([("article",), ("other",)], "template_id string")
    assert rows(groundtruth.eligible_layouts(layouts, rules, scope, templates), "layout_id", "name", "resolved", "template_inferred") == [("l", "l", "article", True)]
    left = spark.createDataFrame([("l", "a", ["u"]), ("l", "b", ["u"]), ("k", "a", ["u"])], "layout_id string, field string, annotators array<string>")
    assert rows(groundtruth.can_compile(left, spark.createDataFrame([("l", "a"), ("k", "a")], "layout_id string, field string"))) == [("k", True, []), ("l", False, ["b"])]
    gt = spark.createDataFrame([("d", "p", "l", False), ("d", "q", "l", False)], "domain string, page string, layout_id string, skipped boolean")
    mine = spark.createDataFrame([("d", "p", None, True)], "domain string, page string, layout_id string, skipped boolean")
    assert rows(groundtruth.effective_assignments(gt, mine)) == [("d", "p", None, True), ("d", "q", "l", False)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, -2.0), ("c_d", 0.9, 1.0), ("e", None, 3.0)], "name string, mean double, delta double")
    text = exports.render_table(df, {"mean": "max", "delta": "absmin"})
    assert "**0.9**" in text and "**1.0**" in text and "a\\|b" in text
    assert r"\textbf{0.9}" in exports.render_table(df, {"mean": "max"}, "latex") and r"c\_d" in exports.render_table(df, style="latex")
    assert exports.render_table(df, style="csv").splitlines()[3] == "e,,3.0"
    exports.write_csv(df, str(tmp_path / "c"))
    exports.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 3
    rules = spark.createDataFrame([("d", "l", "L", "article", "t", "title", "h1", "rouge", 2)], "domain string, layout_id string, layout_name string, page_type string, template_id string, field string, selector string, metric string, page_count long")
    doc = exports.layout_documents(rules, spark.createDataFrame([("d", "l", "p")], "domain string, layout_id string, page string")).first()
    assert doc.selectors == {"title": "h1"} and doc.n_pages == 1
    sites = spark.createDataFrame([("a", "X", "en / fr", 1, 4), ("b", "", "de", 0, 0)], "domain string, country string, language string, layouts long, gt_pages long")
    assert tuple(exports.card_counts(sites).first()) == (1, 1, 1, 4, 2) and "| X | en / fr | 1 | 4 |" in exports.dataset_card("n", sites, sites.select("domain"))
    made = [(r.part, json.loads(r.value)) for r in exports.manifest(df, {"x": "code"}, "t").collect()]
    assert [k for k, _ in made].count("experiment") == 3 and len(dict(made)["code"]["x"]) == 16


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    pages = spark.createDataFrame([(k, f"<h1>{k}</h1>") for k in range(6)], "page_id long, html string")
    pages.write.parquet(source)
    arriving = spark.readStream.schema(pages.schema).parquet(source)
    incremental.score_arrivals(arriving, lambda df: df.select("page_id", F.length("html").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    pages.limit(2).write.mode("append").parquet(source)
    incremental.score_arrivals(arriving, lambda df: df.select("page_id", F.length("html").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    requests = spark.createDataFrame([("h", 1, 0.0, None), ("h", 2, 0.5, 5.0), ("h", 3, 20.0, 99.0), ("i", 4, 1.0, None)], "host string, request_id long, at double, crawl_delay double")
    requests.write.parquet(str(tmp_path / "rq"))
    q = incremental.space_requests(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "rq")), 2.0).writeStream.format("memory").queryName("spaced").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("spaced"), "request_id", "go_at") == [(1, 0.0), (2, 5.0), (3, 35.0), (4, 1.0)]


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT word_f1('a b', 'b c') AS f, css_to_xpath('h1') AS x, normalize_rule('DIV>p') AS n, split_selectors('a, b') AS s").first().asDict() == {"f": 0.5, "x": "descendant-or-self::*/h1", "n": "div > p", "s": ["a", "b"]}
    out = spark.sql("SELECT p.id, e.text FROM VALUES (1, '<p>a<b>c</b></p>') AS p(id, html), LATERAL css_select(p.html, 'b') AS e").collect()
    assert list(map(tuple, out)) == [(1, "c")]
    assert spark.sql("SELECT d.tag, d.depth FROM VALUES ('<p>a<b>c</b></p>') AS p(html), LATERAL dom_nodes(p.html) AS d").count() == 2
