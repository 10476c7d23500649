import html
import re

from lotscope.llm import html_text, queries
from tests.llm.helpers import table

COSTS = {"html": 6.0, "body": 6.0, "h1": 0.01, "p": 0.01, "b": 0.01}


def brute(page):
    """Blocks of the marked article, for the simple markup of the test pages."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = (re.sub(r"</?b>", "", re.sub("<br>", " ", b)) for b in re.split(r"</?(?:h1|p)>", inside))
    return "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in parts)))


def test_query_on_all_pages(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op2_html(spark, "/root/testdata/sf0.001").collect()}
    want = {r.page_id: brute(r.html) for r in table(spark, "pages").collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_parts_that_are_no_article():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h2>Some site name</h2></header>
    <div id="cookie-notice">We use cookies on all of our many pages, accept them now</div>
    <nav><ul><li><a href=/>Home</a><li><a href=/>News</a></ul></nav><div class=content><h1>Big &amp; title</h1>
    <p>One  two\n<b>th</b>ree <a href="x>y">link</a>.<script>if (a<b) "</p>"</script><div class="ad-slot"><div>buy</div> now</div>
    <p hidden>secret<p>Last words here<!-- <p>no --><ul><li>item one</ul></div>
    <section id=comments><article class=comment><p>I liked this really a lot and more</p></article></section>
    <form><label>Name</label></form><aside>Side bar text</aside><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page, COSTS) == "Big & title\nOne two three link.\nLast words here\nitem one"


def test_odd_pages():
    for page in ("", "<", "<p", "<!-- x", "<script>x", "a < b", "<p>" * 3000, "</div>" * 50):
        html_text.main_text(page, COSTS)
    assert html_text.main_text("<article><p>a &lt b &#x41;&am</article>", COSTS) == "a < b A&am"
    assert html_text.main_text("plain text", {}) == "plain text" and html_text.main_text("<nav>a</nav>", {}) == ""
    long = "<p>word</p>" * 20_000
    assert html_text.main_text(f"<article>{long}</article>", COSTS).count("\n") == 19_999


def test_menu_of_links_outside_of_navigation():
    links = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(30))
    assert html_text.main_text(f"<body>{links}<div><p>{'word ' * 20}</p></div></body>", COSTS) == ("word " * 20).strip()


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "z"), (1, None, "z"), (None, "<p>x</p>", None)], "page_id long, html string, text string")
    got = html_text.extract(rows, {})
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0)]
    assert html_text.extract(rows.limit(0), {}).count() == 0 and html_text.tag_costs(rows.limit(0)) == {}


def test_omitted_end_tags():
    rest = "article text of many words that go on and on here"
    for page in (f"<table><tr><td class=sidebar>menu<td><p>{rest}</table><p>more",
                 f"<ul><li class=share>Share<li>{rest}</ul><p>more", f"<dl><dt class=ad>Ad<dd>{rest}</dl><p>more",
                 f"<table><tr class=ad><td>Ad<tr><th>{rest}</table><p>more", f"<div><aside><p>menu</div><p>{rest}<p>more",
                 f"<div><div class=ad>buy</div><section><div class=ad>buy</section><p>{rest}</div><p>more",
                 f"<ul><li class=share><ul><li>Share</ul></li><li>{rest}</ul><p>more", f"<p><span hidden>x<p>{rest}<p>more",
                 f"<table><tr><td class=ad><table><tr><td>buy<td>now</table>it<td>{rest}</table><p>more"):
        assert html_text.main_text(page, COSTS) == rest + "\nmore", page
    assert html_text.main_text("<table><tr><td><nav>a</div></td></table><p>b", COSTS) == "b"
    for part in ("<li>", "<td>", "<b>", "</b>", "<table><td>", "<div class=ad>", "<b></div>", "<table><td><b></div></li>"):  # linear on hostile pages
        html_text.main_text(part * 50_000, COSTS)


def test_names_and_forms_are_overruled_by_the_text():
    body = f"<h1>Big title</h1><p>{'word ' * 40}</p><p>end <math><mi>x</mi></math> of it</p>"
    want = "Big title\n" + ("word " * 40).strip() + "\nend x of it"
    extra = "<div class=comments><p>I liked this really a lot and more</p></div><div>Some short line</div>"
    for before, after in (("<article class='post comments-open'>", "</article>"), ("<article class='post category-legal tag-social'>", "</article>"),
                          ("<div id=content class=has-sidebar>", "</div>"), ("<main class=share-enabled>", "</main>"), ("<form><div>", "</div></form>"),
                          ("<form class=search-form><div class='widget nav'><article>", "</article></div></form>"), ("<div role=search>", "</div>")):
        for rest in ("", extra):
            got = html_text.main_text(f"<html><body>{before}{body}{after}{rest}</body></html>", COSTS)
            assert got.startswith(want) and "liked" not in got, (before, rest, got)
    parts = "".join(f"<div class=widget><p>{i} {'word ' * 20}</p></div>" for i in range(5))
    assert html_text.main_text(f"<div><h2>Title</h2>{parts}<div class=ad>buy now</div></div>", COSTS).count("word") == 100
    assert html_text.main_text("<p>a b c d e f <span class=share>tell</span> g</p><div class=ad>x</div>", COSTS) == "a b c d e f g"


def test_costs_of_doubts_are_learned(spark):
    page = f"<div class=share>{'word ' * 100}</div><article><p>text <div class=widget>{'word ' * 100}</div></article>"
    costs = html_text.tag_costs(spark.createDataFrame([(page,)], "html string"))
    assert costs["#share"] == html_text.MOST_DOUBT_COST and costs["#widget"] == html_text.LEAST_COST


def test_hostile_pages_take_linear_time():
    import time

    for part in ("<a", "<a ", "</a ", "<a \"", "<a '>", "<a \">\"", "<a '\"", "<!--", "<![", "<p class=\"", "<p class='x", "<", "</", "<div>", "<b><p>", "<li", "&lt", "<title>"):
        for page in (part * (1_000_000 // len(part)), part * (300_000 // len(part)) + ">" + "<p>the end"):
            began = time.process_time()
            html_text.main_text(page, {})
            assert time.process_time() - began < 20, (part, time.process_time() - began)


def test_tags_of_odd_pages():
    tags = lambda page: [tuple(t) for t in iter(lambda at=[0], g=html_text._Tags(page): (lambda t: (at.__setitem__(0, t.end) if t else None, t)[1])(g.next(at[0])), None)]
    assert [(t[2], t[3], t[4]) for t in tags("<a href='x>y' b=\"<>\">t</A x><br/><!x><?y?></ z><3>")] == [
        ("a", " href='x>y' b=\"<>\"", ""), ("", "", "A"), ("br", "/", ""), ("", "", ""), ("", "", ""), ("", "", "")]
    assert [(t[0], t[1], t[2]) for t in tags("<a title=\"open>x<b>y")] == [(0, 15, "a"), (16, 19, "b")]
    assert tags("a < b, <c <d") == [] and [t[5] for t in tags("<a <!-- x")] == [True]
