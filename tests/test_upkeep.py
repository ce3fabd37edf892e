"""Exact ranks, free numbers, the log of changes, rules as variants, and the SQL surface, against plain versions."""

import random
from dataclasses import fields as parts

import pytest
from pyspark.sql import functions as F

from fieldloom import sql as functions
from fieldloom.operators import agreement, changes, maintenance, selection, summaries
from fieldloom.sources import study as sources


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect() if names else df.collect()), key=str)


# --- ranks ---


@pytest.mark.parametrize(("few", "ranges"), [(10_000, 1024), (3, 8), (1, 2)])
def test_upper_median(spark, few, ranges):
    r = random.Random(few)
    made = [("same", 4.0)] * 50 + [("two", 1.0), ("two", 9.0), ("one", -3.5), (None, 2.0), (None, float("nan")), ("empty", None)]
    made += [("many", r.choice([r.gauss(0, 1), r.gauss(0, 1e-9), 1e300, -1e300, 5.0])) for _ in range(401)]
    df = spark.createDataFrame(made, "g string, v double").repartition(4)
    groups = {}
    for g, v in made:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    expected = sorted(((g, len(v), sorted(v)[len(v) // 2]) for g, v in groups.items()), key=str)
    assert rows(selection.upper_median(df, ["g"], "v", few=few, ranges=ranges), "g", "n", "median") == expected
    whole = sorted(v for x in groups.values() for v in x)
    assert rows(selection.nth(df, [], "v", F.lit(7), few=few, ranges=ranges), "n", "nth") == [(len(whole), whole[7])]
    assert selection.nth(df, ["g"], "v", F.lit(1000)).count() == 0


def test_timing(spark):
    df = spark.createDataFrame([("e", "a", 4.0), ("e", "b", 1.0), ("e", "c", 4.0), ("e", "d", 2.5)], "exp_id string, layout_id string, ms double")
    assert rows(summaries.timing(df)) == [("e", 2.88, 4.0, 4.0, "c")]


# --- numbers ---


@pytest.mark.parametrize("seed", [1, 2])
def test_free_numbers(spark, seed):
    r = random.Random(seed)
    taken = {d: set(r.sample(range(1, 40), n)) for d, n in (("a", 0), ("b", 1), ("c", 20), ("d", 39))} | {"e": {5000}, "f": {1, 2, 3}}
    pages = [(d, f"article_{n:03}.html") for d, ns in taken.items() for n in ns] + [("a", "listing_001.html"), ("a", "article_x.html"), ("c", "article_000.html"), ("b", "notes.html")]
    new = [(d, k, f"u{k}") for k, d in enumerate(r.choices("abcdefg", k=60))]
    expected = []
    for d, k, u in new:
        n = next(i for i in range(1, 99999) if i not in taken.setdefault(d, set()))
        taken[d].add(n)
        expected.append((d, k, u, f"article_{n:03}.html"))
    found = maintenance.free_numbers(spark.createDataFrame(pages + pages[:3], "domain string, page string"), spark.createDataFrame(new, "domain string, ord int, url string"), "article")
    assert rows(found) == sorted(expected, key=str)


def test_bulk_add(spark):
    pages = spark.createDataFrame([("a", "listing_002.html")], "domain string, page string")
    fetched = spark.createDataFrame([("a", 1, "u1", "<p>", "direct", None, "t"), ("a", 2, "u2", None, "failed", "no page", "t"), ("a", 3, "u3", "<p>1", "direct", None, "t"), ("a", 4, "u4", None, None, None, "t")], "domain string, ord int, url string, html string, method string, error string, at string")
    new, index, results = maintenance.added_pages(pages, fetched, "listing")
    assert rows(new) == [("a", "listing_001.html", "<p>"), ("a", "listing_003.html", "<p>1")]
    assert rows(index, "page", "url", "size") == [("listing_001.html", "u1", 3), ("listing_003.html", "u3", 4)]
    assert rows(results, "ord", "success", "page", "error") == [(1, True, "listing_001.html", None), (2, False, None, "no page"), (3, True, "listing_003.html", None), (4, False, None, "Download failed")]


# --- changes ---


class Study:
    """The tables in plain dictionaries, one change at a time."""

    def __init__(self):
        self.sites, self.codes, self.pages, self.assigned, self.index, self.downloads, self.excluded, self.refused = {}, {}, {}, {}, {}, [], set(), []

    def apply(self, c):
        key = (c["domain"], c["page"])
        if c["action"] == "site_put":
            country = (c["country"] or "").strip() or "Other"
            if country != "Other" and country not in self.codes:
                code = (c["code"] or "").strip().upper()
                if not code or code in self.codes.values():
                    self.refused.append((c["seq"], c["domain"]))
                    return
                self.codes[country] = code
            old = self.sites.get(c["domain"], (None, None, f"https://{c['domain']}", None))
            self.sites[c["domain"]] = (c["name"], c["notes"] or "", c["url"] or old[2], country)
        elif c["action"] == "page_add" or c["action"] == "page_redownload" and key in self.pages:
            self.pages[key] = c["html"]
            kind = c["page_type"] if c["action"] == "page_add" else self.index.get(key, (None, "article"))[1]
            self.index[key] = (c["url"], kind or "article", c["method"], len(c["html"]), c["at"])
            self.downloads.append((c["seq"], c["domain"], c["url"]))
            if c["action"] == "page_redownload":
                self.assigned.pop(key, None)
        elif c["action"] == "page_delete":
            self.pages.pop(key, None)
            self.assigned.pop(key, None)
        elif c["action"] == "assign":
            self.assigned[key] = c["layout_id"]
        elif c["action"] == "site_delete":
            for t in (self.pages, self.assigned, self.index):
                for k in [k for k in t if k[0] == c["domain"]]:
                    del t[k]
            self.downloads = [d for d in self.downloads if d[1] != c["domain"]]
            self.excluded.add(c["domain"])


def a_log(seed, n=250, start=0):
    r = random.Random(seed)
    out = []
    for k in range(start, start + n):
        action = r.choices(["site_put", "page_add", "page_redownload", "page_delete", "assign", "site_delete"], [3, 5, 4, 3, 4, 0.4])[0]
        out.append({"seq": k, "action": action, "domain": r.choice("abc"), "page": f"article_{r.randrange(5):03}.html", "url": r.choice(["", f"https://x/{k}"]) if action == "site_put" else f"https://x/{k}", "html": "x" * r.randrange(9), "page_type": r.choice(["article", "listing"]), "method": "direct", "layout_id": f"L{k % 3}", "name": f"n{k}", "notes": r.choice([None, "note"]), "country": r.choice(["X", "Y", "Z", "", None, "Other"]), "code": r.choice(["AA", "bb", "", None, "CC"]), "at": f"t{k}"})
    return out


def same(tables, study):
    assert rows(tables.sites) == sorted(((d, *v) for d, v in study.sites.items()), key=str)
    assert rows(tables.pages) == sorted(((*k, v) for k, v in study.pages.items()), key=str)
    assert rows(tables.assignments) == sorted(((*k, v) for k, v in study.assigned.items()), key=str)
    assert rows(tables.index) == sorted(((*k, *v) for k, v in study.index.items()), key=str)
    assert rows(tables.downloads, "seq", "domain", "url") == sorted(study.downloads, key=str)
    assert rows(tables.excluded) == sorted(((d,) for d in study.excluded), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_log_folds_to_what_its_changes_leave_one_by_one(spark, seed):
    log, study = a_log(seed), Study()
    frame = lambda cs: spark.createDataFrame(cs, changes.CHANGES).repartition(3)
    for c in log:
        study.apply(c)
    whole, counted, refused = changes.replay(changes.no_tables(spark), frame(log))
    same(whole, study)
    assert rows(refused, "seq", "domain") == sorted(study.refused, key=str) and study.refused
    per = {}
    for *_, country in study.sites.values():
        per[country] = per.get(country, 0) + 1
    assert rows(counted) == sorted(((c, study.codes.get(c), n) for c, n in per.items()), key=str)


def test_a_log_in_two_parts(spark):
    """The second part starts from the tables that the first has left; codes of countries that still have sites stay theirs."""
    log = [c for c in a_log(5) if c["action"] != "site_put"]
    study = Study()
    for c in log:
        study.apply(c)
    kept = changes.no_tables(spark)
    for part in (log[:70], log[70:]):
        out, _, _ = changes.replay(kept, spark.createDataFrame(part, changes.CHANGES))
        kept = changes.Tables(**{f.name: spark.createDataFrame(getattr(out, f.name).collect(), getattr(out, f.name).schema) for f in parts(out)})
    same(kept, study)
    assert study.pages and study.index
    none, _, refused = changes.replay(changes.no_tables(spark), spark.createDataFrame([], changes.CHANGES))
    assert all(getattr(none, f.name).count() == 0 for f in parts(none)) and refused.count() == 0


# --- variants ---


def test_rules_as_variants(spark):
    forms = {"a": "h1", "b": '["x", null, "y"]', "c": '{"css": "x", "xpath": "//x", "other": "z", "regex": ""}', "d": '{"css": ["p", "q"], "xpath": null}', "e": "[data-x]", "f": "", "g": None, "h": '{"css": "x"', "i": "[null]", "j": "{}", "k": '{"css": {"deep": 1}}', "l": '"quoted"', "m": "3"}
    df = spark.createDataFrame([("l", forms), ("none", {})], "layout_id string, selectors map<string,string>")
    found = {(f, lang): rule for _, f, lang, rule in rows(sources.variant_rules(df, ["layout_id"]))}
    assert found == {("a", "css"): "h1", ("b", "css"): "x, y", ("c", "css"): "x", ("c", "xpath"): "//x", ("d", "css"): "p, q", ("e", "css"): "[data-x]", ("h", "css"): '{"css": "x"', ("l", "css"): '"quoted"', ("m", "css"): "3"}


def test_metrics_documents(spark):
    docs = spark.createDataFrame([(1, '{"p1": {"title": {"score": 0.5, "label": "PARTIAL"}, "body": {"score": -1}}, "p2": {}}'), (2, "broken"), (3, None), (4, '{"p": {"x": 3, "y": {"label": "MISS", "score": "no"}}}')], "id int, metrics string")
    assert rows(sources.metrics_cells(docs, ["id"])) == sorted([(1, "p1", "title", 0.5, "PARTIAL"), (1, "p1", "body", -1.0, None), (4, "p", "y", None, "MISS")], key=str)


# --- SQL ---


def test_rule_values_in_sql(spark):
    functions.register(spark)
    rules = [("t", "css", "text", False, "h1"), ("l", "css", "url", True, "a"), ("x", "xpath", None, None, "//p"), ("bad", "css", "text", False, "")]
    pages = spark.createDataFrame([(1, "en", "<h1>A</h1><a href='/1'>x</a><p>P</p>", rules), (2, "de", None, rules), (3, "de", "<h1>B</h1>", None)], "page_id int, lang string, html string, rules array<struct<rule_id:string,lang:string,kind:string,merge:boolean,rule:string>>")
    for table in ("TABLE(SELECT * FROM {p})", "TABLE(SELECT * FROM {p}) PARTITION BY lang"):
        found = spark.sql(f"SELECT * FROM rule_values({table})", p=pages)
        assert found.columns == ["page_id", "lang", "rule_id", "vals"]
        assert [(a, c, v) for a, _, c, v in rows(found) if v] == [(1, "l", ["/1"]), (1, "t", ["A"]), (1, "x", ["P"])] and found.count() == 8
    with pytest.raises(Exception, match="TABLE argument with html and rules"):
        spark.sql("SELECT * FROM rule_values(TABLE(SELECT 1 AS a))").collect()


def test_agreement_in_sql(spark):
    r = random.Random(3)
    made = [(g, f"s{r.randrange(12)}", r.choice(["a", "b", "b", "", None])) for g in "xy" for _ in range(80)] + [("one", "s", "a"), ("one", "s", "a"), ("none", "s", "a")]
    df = spark.createDataFrame(made, "g string, subject string, category string")
    functions.register(spark)
    found = {g: (k, a) for g, k, a in rows(spark.sql("SELECT g, fleiss_kappa(subject, category), krippendorff_alpha(subject, category) FROM {d} GROUP BY g", d=df))}
    kappa = {x.g: x.kappa for x in agreement.fleiss_kappa(df, ["subject"], "category", ["g"]).collect()}
    for g in "xy":
        alpha = agreement.nominal_alpha(df.where((F.col("g") == g) & (F.coalesce("category", F.lit("")) != "")), ["subject"], "category").first().alpha
        assert found[g] == pytest.approx((kappa[g], alpha), abs=2e-6)
    assert found["one"][1] == 1.0 and all(x is None or x != x for x in (found["one"][0], *found["none"]))
