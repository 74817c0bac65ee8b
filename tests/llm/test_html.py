import itertools
import time

import numpy as np
import pytest

from halcyon.llm import html

SITE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header class="top"><a href="/">Site</a> slogan of the site</header>
<nav><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></nav><div class="cookie-notice"><p>We store small files. Agree to it, please.</p></div>
<%s><h1>Head &amp; line %d</h1><p>Some first paragraph, number %d, has   many
words&nbsp;in it; it goes on. <b>Bold words<p>The second paragraph was not closed before, and <a href="x">a link</a> is in it.<div class="ad">Buy now. Cheap.</div>
<p>Third one, with a number of sentences. They end here. Really.</p></%s>
<section id="comments"><h2>Comments</h2><p>I liked it very much, dear author, thanks a lot.</p></section><form><label>Mail</label><input></form>
<footer>&copy; owner, all rights reserved</footer></body></html>"""


def site(k, name="article"):
    return SITE % (name, k, k, name.split()[0])


def text(k):
    return (f"Head & line {k}\nSome first paragraph, number {k}, has many words in it; it goes on. Bold words\n"
            "The second paragraph was not closed before, and a link is in it.\nThird one, with a number of sentences. They end here. Really.")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"u{i}", site(i)) for i in range(60)] + [(100, "v", site(100, 'div class="post-body"')), (101, None, None), (102, "w", ""), (103, "x", "only plain text, nothing else"),
                                                      (None, "y", site(5)), (5, "z", site(5)), (104, "q", "<p>a <b>unclosed <i>tags & &lt;entities&gt; <")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string").repartition(3)


def test_main_text_of_every_page(pages):
    got = html.main_texts(pages).collect()
    assert len(got) == 67
    for r in got:
        if r.page_id in range(60):
            assert r.text == text(r.page_id)
        assert r.n_chars == len(r.text)
    texts = {r.page_id: r.text for r in got}
    # another name for the article, seen in rearranged pages only
    assert "Third one, with a number" in texts[100] and not any(x in texts[100] for x in ("Buy now", "Site", "liked", "Agree", "rights"))
    assert texts[101] == texts[102] == "" and texts[103] == "only plain text, nothing else"
    assert html.main_texts(pages.limit(0)).count() == 0


def test_without_marked_pages(spark):
    df = spark.createDataFrame([(1, "u", "<nav>menu</nav><p>body text</p>")], "page_id long, url string, html string")
    assert html.main_texts(df).first().text == "body text"


def test_parser_repairs():
    leaves = lambda p: [n.text for n in html.parse(p) if n.text]
    assert leaves("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert leaves("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert leaves("x<br>y </b> z<style>p{}</style><!-- c -->w") == ["x y zw"] or leaves("x<br>y </b> z<style>p{}</style><!-- c -->w") == ["x y z w"]
    assert leaves('<p title="a > b">1 < 2</p><script>"</p>"</script><div>z') == ["1 < 2", "z"]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(60):
        nodes = [html.Node("html", -1)]
        for k in range(1, 8):
            nodes.append(html.Node("div", int(rng.integers(0, k)), (), f"t{k}" if k > 2 else None))
        z = rng.normal(0, 2, 7)
        best, choice = -np.inf, None
        for keep in itertools.product([0, 1], repeat=7):
            if all(keep[k - 1] <= (1 if nodes[k].parent == 0 else keep[nodes[k].parent - 1]) for k in range(1, 8)):
                value = sum(-np.logaddexp(0, -s) if c else -np.logaddexp(0, s) for c, s in zip(keep, z))
                if value > best:
                    best, choice = value, keep
        assert html.decode(nodes, z) == "\n".join(f"t{k}" for k in range(3, 8) if choice[k - 1])


def test_head_without_an_end_tag_and_math():
    leaves = lambda p: [n.text for n in html.parse(p) if n.text]
    assert leaves("<html><head><title>t</title><body><article><p>text") == ["text"]
    assert leaves('<head><meta charset="x"><link href="y"><script>no()</script><p>a<p>b') == ["a", "b"]
    assert leaves("<html><head><title>t</title>\n<noscript>no</noscript> words <b>more</b>") == ["words more"]
    assert leaves("<html><head><title>t</title></head><body><p>text</p></body></html>") == ["text"]
    assert leaves("<p>as <math><mi>x</mi><mo>=</mo><mn>2</mn></math> shows</p>") == ["as x=2 shows"]
    assert html.extract(["<html><head><title>t</title><body><article><p>text"], None) == ["text"]


def shown(page):
    return [n.text for n in html.parse(page) if n.text is not None]


@pytest.mark.parametrize("page, texts", [
    ("<p>a<b c='it's'>bold</b> end</p>", ["abold end"]),
    ('<p>a<b c="x>y" d=\'z>\'>bold</b></p>', ["abold"]),
    ('<p>x <a href="open>link</a> y</p><p>next', ["x link y", "next"]),
    ("<article><p>one <svg><path d='x'><p>two</p><p>three</article>", ["one", "two", "three"]),
    ("<article><p>one</p><select><option>A<option>B<p>two</p></article>", ["one", "two"]),
    ("<p>one <select><option>A</option></select> rest</p>", ["one rest"]),
    ("<p>one <button>press <p>two</p> three", ["one press", "two", "three"]),
    ("<p>one <button>press</button> two</p>", ["one two"]),
    ("<svg><foreignObject><p>label</p></foreignObject></svg><p>one", ["one"]),
    ("<div><b>one</div>two</b> three", ["one", "two three"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
    ("<table><tr><td>a<td><p>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>one</b></i></div> two", ["one two"]),
])
def test_repairs(page, texts):
    assert shown(page) == texts


@pytest.mark.parametrize("bad", ["<x b ", "<b>", "<div>", "<p>", "</div>", "<td>", '<a b="', "<a b='\"", "<svg>", "<select>", "<button>", "<li><dt>", "<script", "<!-", "<", "&#", "<b></p>"])
def test_a_megabyte_of_anything_is_read_in_time(bad):
    half = 500_000 // len(bad)
    for page in (bad * half + '"' + "<p>text " * 60_000, ("<p>text " * 60_000) + bad * half, (bad + "<p>") * (half // 2) + "</div>" * 60_000):
        at = time.perf_counter()
        html.parse(page)
        assert time.perf_counter() - at < 6            # about 1 s alone; quadratic work takes minutes
