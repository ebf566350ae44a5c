import html
import re
import time

import pytest

from glosswork.llm import page_text

LOREM = "The committee met on Tuesday to consider the plan for the harbour and its bridges, as well as the cost of both. "
ARTICLE = [LOREM * 3, LOREM * 2 + "It agreed.", "Short end & more.", LOREM * 4]
MENU = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12))


def page(inside, around="{}"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) x='</p>';</script></head><body>{around.format(inside)}</body></html>"


PARAGRAPHS = "".join(f"<p>{html.escape(p)}</p>\n" for p in ARTICLE)
WANT = " ".join(" ".join(ARTICLE).split())


@pytest.mark.parametrize("around", [
    "<nav><ul>" + MENU + "</ul></nav><article>{}</article><footer>&copy; me</footer>",
    "<div id='page'><div class='main-nav'><ul>" + MENU + "</ul></div><div id='story'>{}</div><div class='site-footer footer'>Imprint " + LOREM + "</div></div>",
    "<header><a href='/'>Home</a><h2>Site</h2></header><main><div>{}</div></main><aside><p>" + LOREM * 9 + "</p></aside>",
    "<div class='cookie-notice'><p>" + LOREM * 3 + "</p></div><table><tr><td><ul>" + MENU + "</ul><td>{}</table>",
    "<form><p>Name <input name=a> <textarea>x</textarea></form><div class=content>{}</div><section id=comments><article><p>" + LOREM * 8 + "</p></article></section>",
    "<div role=navigation>" + MENU + "</div><div>{}</div><div class='ad'>" + LOREM * 2 + "</div><script>document.write('<p>x</p>')</script>",
    "<div class='layout with sidebar'><ul>" + MENU + "</ul><div>{}</div></div><!-- <p>no</p> -->",
    "<ul>" + MENU + "</ul><div><div><div>{}</div></div></div><p hidden>" + LOREM + "</p>",
])
def test_article_without_the_rest(around):
    assert page_text.main_text(page(PARAGRAPHS, around)) == WANT


@pytest.mark.parametrize("around", [
    "<form action='/x'><div class='nav'>" + MENU + "</div><div>{}</div></form>",
    "<form><div role=navigation>" + MENU + "</div><article>{}</article><p>" + LOREM * 9 + "</p><div class=promo>" + LOREM + "</div></form>",
    "<div class='post comments-open'>{}</div><div class='comments'>" + LOREM + "</div>",
    "<ul>" + MENU + "</ul><article class='hentry comments-open'>{}</article>",
    "<div class='related'><div>{}</div></div>", "<article class='newsletter promo'>{}</article><nav>" + MENU * 9 + "</nav>",
])
def test_a_name_or_a_form_around_the_article(around):
    text = page_text.main_text(page(PARAGRAPHS, around))
    assert WANT in text and "Item" not in text and len(text) < len(WANT) + 10 * len(LOREM)


def test_main_with_unnamed_blocks_around_the_article():
    teasers = "".join(f"<div><a href='/{i}'><h3>Teaser {i}</h3>Read on</a> <span>by</span> <i>me</i></div>" for i in range(9))
    for inner in ("<article><h1>Title</h1>{}</article>", "<header><h1>Title</h1></header><div>{}</div>"):
        around = f"<main>{inner}<section>{teasers}</section><div><ul>{MENU}</ul></div></main>"
        assert page_text.main_text(page(PARAGRAPHS, around)) == "Title " + WANT


def test_several_articles():
    parts = [f"<article><h2>Part {i}</h2>{PARAGRAPHS * n}</article>" for i, n in ((1, 1), (2, 2), (3, 1))]
    want = " ".join(f"Part {i} " + " ".join([WANT] * n) for i, n in ((1, 1), (2, 2), (3, 1)))
    assert page_text.main_text(page("".join(parts), f"<ul>{MENU}</ul>{{}}")) == want
    assert page_text.main_text(page("".join(parts), f"<main>{{}}<div><ul>{MENU}</ul></div></main>")) == want


def test_inline_markup_and_white_space():
    inside = "<article><h1>A  title</h1><p>One <b>two</b>three<br>four\n\tfive&nbsp;&eacute;&#233;&lt;p&gt;<p>six<ul><li>a<li>b</ul></article>"
    assert page_text.main_text(page(inside)) == "A title One twothree four five éé<p> six a b"


@pytest.mark.parametrize("text", [None, "", " \n", "<", "<p", "<!-- ", "<html><body></body></html>", "<script>x", "</p></div>", "<nav>a</nav>"])
def test_nothing(text):
    assert page_text.main_text(text) in ("", "<", "<p")


def test_plain_text_and_broken_markup():
    assert page_text.main_text("just words & more") == "just words & more"
    assert page_text.main_text("<p>one<div>two</b></i></span><p>three") == "one two three"
    assert page_text.main_text("a < b and <b title='x>y'>c</b> \"<i>d") == 'a < b and c "d'


def test_deep_and_long_pages():
    assert page_text.main_text("<div>" * 20_000 + LOREM + "</div>" * 20_000) == LOREM.strip()
    assert len(page_text.main_text(page("<article>" + "<p>x y</p>" * 100_000 + "</article>"))) == 400_000 - 1
    assert page_text.main_text("<a \"" * 3_000) is not None


@pytest.mark.parametrize("broken", ["<div><p>word and word</p>" * 8_000, "<div>" * 8_000 + "</em>" * 8_000 + LOREM,
                                    "<ul><li>" * 4_000 + LOREM, "<div><p>a</p></b></div>" * 8_000])
def test_depth_costs_no_squares(broken):
    start = time.process_time()
    assert page_text.main_text(broken)
    assert time.process_time() - start < 2  # once 3 to 17 seconds


def test_query_and_edge_rows(spark, make, sf):
    from glosswork.llm import queries
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"</?(?:p|h1|br)>", " ", inner)
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", blocks)).split())
    got = queries.QUERIES["op5_text_density"](spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    rows = [(1, None, "t", "h"), (2, "", "t", "h"), (2, "", "t", "h"), (None, "<p>a b", "t", "h")]
    df = page_text.extract(make(rows, "page_id long, html string, text string, _html string"))
    assert sorted((str(r["page_id"]), r["text"], r["_html"]) for r in df.collect()) == [("1", "", "h"), ("2", "", "h"), ("2", "", "h"), ("None", "a b", "h")]
    assert page_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
