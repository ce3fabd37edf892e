"""Trees, selectors, XPath, regular expressions, cleaning, skeletons, answers: kernels on strings."""

import time

import pytest

from fieldloom import clean, css, dom, extract, regexgen, responses, rx, skeleton, xpath

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p class='x'></p>";</script></head><body>
<div style="display: none" class="cookie-bar">Hidden <b>banner</b></div>
<nav><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></nav>
<main><article id="m" class="story-main css-1x2y3z"><h1 class="title big">Head &amp; more</h1><p>First <b>bold</b>text.<p>Second</p>
<figure class="pic"><img src="/a.jpg" width="10"><figcaption>Cap</figcaption></figure><ul class="tags"><li>x</li><li>y</li></ul></article></main>
<!-- note --><footer><a href="/1">One</a></footer></body></html>"""


@pytest.fixture(scope="module")
def page():
    return extract.Page(PAGE)


def texts(page, rule, **options):
    return page.values(rule, "css", **options)


@pytest.mark.parametrize(("rule", "expected"), [
    ("h1", ["Head & more"]), (".title", ["Head & more"]), ("h1.title.big", ["Head & more"]), ("#m > h1", ["Head & more"]), ("nav > ul li a", ["One", "Two"]), ("article figure + ul", ["x y"]), ("h1 ~ p li:first-child", ["x"]),
    ("li:nth-child(2)", ["Two", "y"]), ("ul.tags li:not(:first-child)", ["y"]), (":is(h1, figcaption)", ["Head & more", "Cap"]), ("[class~=big]", ["Head & more"]), ("[class^='story']", ["Head & more First bold text. Second Cap x y"]),
    ("a[href$='2']", ["Two"]), ("a[href*='/2' i]", ["Two"]), ("h1[class|=title]", []), ("missing, h1", ["Head & more"]), ("h1::before", []), ("h1 >", []), ("li:nth-child(odd)", ["One Two", "x"]), ("article:has(figure) h1", ["Head & more"]),
])
def test_selectors(page, rule, expected):
    assert texts(page, rule) == expected


def test_alternatives_and_merging(page):
    assert texts(page, "figcaption, h1") == ["Cap"]
    assert texts(page, "figcaption, h1", merge=True) == ["Cap", "Head & more"]
    assert page.values("img", "css", "image") == ["/a.jpg"] and page.values("figure", "css", "image") == []
    assert page.values("nav a, footer a", "css", "url", True) == ["/1", "/2", "/1"]
    with pytest.raises(ValueError):
        page.values("x", "sql")


def test_flat_and_implied_trees():
    html = "<p>a<p>b<li>c<li>d</b>e"
    assert [dom.visible_text(n) for n in css.select(dom.parse(html), "p")] == ["a b c de", "b c de"]
    assert [dom.visible_text(n) for n in css.select(dom.parse(html, True), "p")] == ["a", "b c de"]
    assert css.select(dom.parse(html, True), "html > body > p")
    twice = dom.parse('<a class="x" CLASS="y z">t</a><br>u')
    assert css.select(twice, "a")[0].classes() == ["y", "z"] and twice.to_html() == '<a class="y z">t</a><br/>u'


@pytest.mark.parametrize(("path", "expected"), [
    ("//h1", ["Head & more"]), ("//h1/text()", ["Head & more"]), ("//a/@href", ["/1", "/2", "/1"]), ("//ul[@class='tags']/li[2]", ["y"]), ("(//a)[last()]", ["One"]), ("//li[position()=1]/a", ["One"]),
    ("//*[contains(concat(' ', normalize-space(@class), ' '), ' big ')]", ["Head & more"]), ("//figure/following-sibling::ul/li[1]", ["x"]), ("//figcaption/parent::figure/img/@src", ["/a.jpg"]), ("//li[a/@href='/2']/a", ["Two"]),
    ("count(//a)", ["3"]), ("string(//h1)", ["Head & more"]), ("//h1 | //figcaption", ["Head & more", "Cap"]), ("//a[not(ancestor::nav)]", ["One"]), ("substring-before('a-b', '-')", ["a"]), ("//h1[", []), ("//nope", []), ("translate('abc','ab','x')", ["xc"]),
    ("//li[starts-with(., 'T')]", ["Two"]), ("//p[string-length() > 100]", []), ("1 + 2 * 3 div 2", ["4"]),
])
def test_xpath(page, path, expected):
    assert page.values(path, "xpath") == expected


def test_xpath_kinds(page):
    assert page.values("//figure", "xpath", "image") == ["/a.jpg"] and page.values("//nav//li", "xpath", "url") == ["/1", "/2"]
    assert page.values("//article/p/b", "xpath") == ["bold text."]  # what follows an element belongs to it


def test_regex_rules():
    assert rx.values("<H1 a>x <i>y</i></H1>", "<h1[^>]*>(.*?)</h1>", "text") == ["x y"]
    assert rx.values('src="a&amp;b"', 'src="([^"]*)"', "image") == ["a&b"]
    assert rx.find_all("ab cd", "(x)|(b)") == ["b"] and rx.find_all("ab", "(") == [] and rx.find_all("", "a") == []
    began = time.time()
    assert rx.find_all("a" * 40 + "b", "(a+)+c", 0.3) == [] and time.time() - began < 5
    assert rx.html_to_text("<script>x</script>a<b>b</b>c<!-- d -->&lt;&eacute;") == "a b c <é"


@pytest.mark.parametrize(("selector", "parts"), [("h1, h2", ["h1", "h2"]), (":is(h1, h2), a", [":is(h1, h2)", "a"]), ('[title="a, b"]', ['[title="a, b"]']), ("a\\,b, c", ["a\\,b", "c"]), (" , ", []), (None, [])])
def test_split(selector, parts):
    assert css.split_selectors(selector) == parts


@pytest.mark.parametrize(("rule", "normal"), [
    ("div>p", "div > p"), ("DIV.b.a#x", "div#x.a.b"), ("a[href='x']", 'a[href="x"]'), ("a[ HREF = x ]", 'a[href="x"]'), ("*.a", ".a"), ("h1,  h2", "h1, h2"), ("  ", None), ("a[x~='b>c']", 'a[x~="b>c"]'), ("li:nth-child( 2 )", "li:nth-child( 2 )"), ("a !b", "a !b"),
])
def test_normal_form(rule, normal):
    assert css.normalize_rule(rule) == normal


def test_normal_form_merge_and_languages():
    assert css.normalize_rule("b, a") == "b, a" and css.normalize_rule("b, a", merge=True) == "a, b"
    assert css.normalize_rule(" //a ", "xpath") == "//a" and css.normalize_rule(None) is None


@pytest.mark.parametrize(("rule", "path"), [
    ("div.body > p", "//div[contains(@class, 'body')]/p"), ("#x a[href]", "//*[@id='x']//a[@href]"), ("h1, h2", "//h1 | //h2"), ("a:hover", None), ("a + b", None), ("> a", None), ("[a^='b c'] d", "//*[starts-with(@a, 'b c')]//d"), ("", None), ("a\\:b", None), ("[a='x' i]", None), ("A.b#c", "//a[contains(@class, 'b')][@id='c']"), ("p:not(.x)", None), (None, None), ("h1, a + b", None),
])
def test_readable_xpath(rule, path):
    assert css.readable_xpath(rule) == path


@pytest.mark.parametrize("rule", ["h1", ".title", "nav > ul li a", "h1 ~ ul li:first-child", "#m > h1", "a[href$='2']", "article figure + ul", "li:nth-child(2)"])
def test_translated_rules_find_the_same(page, rule):
    assert sorted(dom.visible_text(x) for x in xpath.evaluate(page.tree(False), css.css_to_xpath(rule))) == sorted(texts(page, rule, merge=True))


def test_strict_and_partial_translations():
    assert css.readable_xpath("a.b", strict=True) == "//a[contains(concat(' ', normalize-space(@class), ' '), ' b ')]"
    assert css.css_to_xpath("h1, a:hover") == "descendant-or-self::*/h1" and css.css_to_xpath("a:hover") is None is css.css_to_xpath(" ")


def test_literals():
    assert css.xpath_literal("a") == "'a'" and css.xpath_literal("a'b") == '"a\'b"'
    assert xpath.evaluate(dom.parse("<a/>"), css.xpath_literal("a'b\"c")) == ["a'b\"c"]


@pytest.mark.parametrize("rule", ["h1", ".title", "nav a", "figcaption", "ul.tags", "article h1.big", "footer"])
def test_generated_regex_fits(page, rule):
    kind = "url" if rule == "nav a" else "text"
    made = regexgen.generate(rule, [PAGE], [page.values(rule, "css", kind, True)], kind)
    assert made["passed"] == made["total"] == 1
    assert regexgen.candidates("a + b") == [] == regexgen.candidates("a:hover")


def test_generated_regex_counts_nesting():
    html = '<div class="o"><div>a</div>b</div><div>c</div>'
    made = regexgen.generate("div.o", [html], [["a b"]])
    assert made["strategy"].startswith("nested") and rx.values(html, made["regex"], "text") == ["a b"]
    assert regexgen.Seen.on([dom.parse(html)], css.read("div.o")).depth == 1


@pytest.mark.parametrize(("rule", "html", "values"), [
    (".x", "<p class='a x'>1</p><b data-q='class=x'>2</b><span class=x>3</span>", ["1", "3"]), ("[data-k$='9']", '<i data-k="a9">1</i><i data-k="9a">2</i>', ["1"]), ("p[lang|=en]", "<p lang='en-GB'>1</p><p lang='eng'>2</p>", ["1"]),
    ("h2, .t b", "<h2>1</h2><div class='t'><b>2</b></div><b>3</b>", ["1", "2"]), ("ul li", "<li>0</li><ul><li>1</li><li>2</li></ul>", ["1", "2"]), ("a[title]", '<a href="x"title="t">1</a><a href=title>2</a>', ["1"]),
])
def test_generated_regex_reads_attributes(rule, html, values):
    made = regexgen.generate(rule, [html], [values])
    assert made["passed"] == 1 and rx.values(html, made["regex"], "text") == values


def test_regex_of_links_in_several_ancestors():
    html = '<a href="/0">n</a><nav><a class="k" href=/1>1</a><a href=\'/2\'>2</a></nav><a href="/3">3</a>'
    made = regexgen.generate("nav a", [html], [["/1", "/2"]], "url")
    assert made["passed"] == 1 and rx.values(html, made["regex"], "url") == ["/1", "/2"]
    assert regexgen.generate("a:hover", [html], [[]]) is None is regexgen.generate("", [html], [[]])


def test_cleaning():
    for strategy in clean.STRATEGIES:
        out = clean.clean(PAGE, strategy)
        assert len(out) <= len(PAGE) + 200 and (strategy == "none" or "<script" not in out and "<style" not in out)
        assert strategy in ("none", "raw_regex") or "Hidden" not in out
    assert "<nav" not in clean.clean(PAGE, "whitelist") and "<footer" not in clean.clean(PAGE, "whitelist") and "<footer" in clean.clean(PAGE, "raw_regex")
    assert clean.clean("<div>aaaa aaaa aaaa aaaa aaaa aaaa</div>", "entropy") == "<div>[CONTENT]</div>"
    assert "class" not in clean.clean('<custom class="a">x</custom>', "hybrid") and clean.clean('<custom class="a">x</custom>', "whitelist") == "x"
    with pytest.raises(ValueError):
        clean.clean("", "other")


@pytest.mark.parametrize(("token", "kept"), [
    ("article-body", "article-body"), ("Paragraph_wrapper__6w7GG", "Paragraph_wrapper"), ("box--margin-none", None), ("c-detail__date", "c-detail__date"), ("w-100", "w-100"), ("border-b", "border-b"), ("article-xQoVi", "*article*"), ("story-xQoVi", None),
    ("ssrcss", None), ("hy4hp", None), ("n3_meta_posted", "n3_meta_posted"), ("_abc", None), ("layout--bg", None), ("card--active", "card--active"), ("main-qq", "*main-qq*"),
])
def test_class_tokens(token, kept):
    assert skeleton.class_token(token) == kept


def test_skeleton():
    s = skeleton.skeleton(PAGE, "enriched")
    assert "<h1" in s.text and "Head & more" in s.text and "<nav" not in s.text and "Hidden" not in s.text and 'width="10"' in s.text
    bare = skeleton.skeleton(PAGE)
    assert "Head" not in bare.text and bare.node_count > 3
    many = skeleton.skeleton("<main>" + "<div class='card'>x</div>" * 6 + "</main>", "enriched")
    assert many.pruned_siblings == 4
    deep = skeleton.skeleton("<div>" * 30 + "x" + "</div>" * 30, "text_included")
    assert deep.pruned_depth == 1
    assert "<!-- contains: span -->" in skeleton.skeleton("<div class='wrapper'><span></span></div>").text


@pytest.mark.parametrize(("rule", "fixed"), [
    ("div.wysiwyg wysiwyg--all-content p", "div.wysiwyg.wysiwyg--all-content p"), ("div.c-detail__category.a", "div.c-detail__category a"), ("div.c-detail__date span", "span.c-detail__date"), ("p.text-[40px]", 'p[class*="text-[40px]"]'), ("h1.headline, h2 big", "h1.headline, h2.big"), ("h1.title", "h1 title"), ("", ""),
])
def test_repair(rule, fixed):
    assert responses.repair_selector(rule) == fixed


def test_repair_knows_classes_and_the_body():
    assert responses.repair_selector("div.meta", known={"meta"}) == "div.meta" and responses.repair_selector("div.meta") == "div meta"
    assert responses.repair_selector("main#content div p", "body") == "main#content"
    assert responses.body_from_skeleton("div p", '<main id="c">') == "main#c" and responses.body_from_skeleton("div.x", '<main id="c">') == "div.x" and responses.body_from_skeleton(None, "<article>") == "article"


def test_answers_and_prompts():
    assert responses.parse_response('x {"a": " b "} y', ["a", "c"]) == ({"a": "b"}, "")
    assert responses.parse_response("", None)[1] == "Empty response" and responses.parse_response("{", None)[1] == "No JSON found" and responses.parse_response("{x}", None)[1].startswith("JSON parse error")
    text = responses.system_prompt("Article", "news", [{"name": "title", "description": "Headline", "required": True}, {"name": "body"}])
    assert "- title: Headline (required)\n- body" in text and '{"title": "<css selector>", "body": "<css selector>"}' in text
    assert responses.check_prompt("{skeleton} {x}") == ["unknown placeholder: {x}"] and responses.check_prompt("") == ["{skeleton} is missing"]
