import time

import numpy as np

from weirlog.llm import dom, extraction


def test_held_out_pages():
    model = extraction.train()
    pages = extraction.labelled(80, seed=4321)
    got = extraction.extract([h for h, _ in pages], model)
    hit = miss = extra = 0
    for text, (_, want) in zip(got, pages, strict=True):
        a, b = set(text.split("\n\n")), set(want.split("\n\n"))
        hit, miss, extra = hit + len(a & b), miss + len(b - a), extra + len(a - b)
    assert hit / (hit + miss) > 0.95
    assert hit / (hit + extra) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class=x><header><a href=/>Site name</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-banner">We use cookies, please accept them all.<button>OK</button></div><article><h1>A  title &amp; more</h1><p>First paragraph of the text,
with <b>bold</b>ness &lt;here&gt;.<p>Second paragraph<br>after a break, and it is long enough to be read.<script>var x="</p>";</script></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Some other story</a></ul></aside><section class="comments"><h2>Comments</h2><div class=comment><p>I disagree with it.</p></div></section>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site. All rights reserved.</footer></body></html>"""


def test_a_page():
    text = extraction.extract([PAGE], extraction.train())[0]
    assert text == "A title & more\n\nFirst paragraph of the text, with boldness <here>.\n\nSecond paragraph after a break, and it is long enough to be read."


def test_broken_html():
    odd = ["", "plain words only", "<p>a<p>b</div></article><b>c", "<a <b <c", "<" * 500, "<p>" + "x " * 100_000, "<div>" * 3000 + "deep", "&am &amp &#x41;&#0; &bogus;", "<!-- never closed", "<script>never closed", "<p>tail <b"]
    out = extraction.extract(odd, extraction.train())
    assert len(out) == len(odd)
    assert out[0] == ""
    assert "x x" in out[5] or out[5] == ""
    nodes, runs, rows = dom.nodes_of("<p>a<p>b</div><b>c")
    assert [t for _, t in runs] == ["a", "bc"] or [t for _, t in runs] == ["a", "b", "c"]
    assert all(len(r) == dom.N_FEATURES for r in rows)
    assert len(nodes) == len(rows)


def test_hostile_pages_take_linear_time():
    model = extraction.train()
    for piece in ("<a ", "<div>", "</p>", '<a "', "<a '\">", '<a b="c>', "<p>", "<li><div>", "<!x", "<p class=", "<table><tr><td>", "&amp;"):
        html = piece * (1_000_000 // len(piece))
        began = time.process_time()
        extraction.extract([html], model)
        assert time.process_time() - began < 10, piece
    late = "<div>" * 20_000 + "<li>x</li>" * 20_000
    began = time.process_time()
    extraction.extract([late], model)
    assert time.process_time() - began < 5


def test_unclosed_quotes_and_tags():
    text = lambda html: [run for _, run, _ in dom.parse(html)[1]]
    assert text("<p>one<p title='a>b'>two") == ["one", "two"]
    assert text('<p>one<a href="x>link</a><p>two') == ["onelink", "two"]
    assert text("<p>a < b and c > d<p>e<3") == ["a < b and c > d", "e<3"]
    assert text("<p>x<!-- <p>y --><p>z<!-- open <p>no") == ["x", "z"]
    assert text("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert text("<table><tr><td>a<p>b<td>c<tr><td>d</table>e") == ["a", "b", "c", "d", "e"]


NEWS = """<html lang=en><head><meta charset=utf-8><title>Harbour reopens</title></head><body>
<div id="top-bar"><a href="/">Daily Coast</a> | <a href="/login">Sign in</a> | <a href="/subscribe">Subscribe</a></div>
<div class="wrap"><div class="navigation"><a href="/world">World</a> <a href="/sport">Sport</a> <a href="/culture">Culture</a></div>
<div class="article-body"><h1>Harbour reopens after storm</h1>
<p>The harbour opened again on Tuesday, two weeks after a storm had torn away part of its outer wall and closed the town to ships.</p>
<p>Engineers said the repairs would hold through the winter, but a new wall, which the council wants to build next year, was still needed.</p>
<blockquote>We were lucky that nobody stood there that night, the harbour master said, and he thanked the crews for their work.</blockquote>
<p>Fishing boats left at dawn; the first ferry is expected on Friday, when the pier's lights have been tested.</p></div>
<div class="sidebar"><h4>Most read</h4><ul><li><a href="/1">Ten walks by the sea</a></li><li><a href="/2">A new mayor</a></li></ul></div></div>
<div class="footer"><p>Copyright Daily Coast</p><a href="/terms">Terms</a></div></body></html>"""
HOWTO = """<body><nav class="breadcrumb"><a href=/>Home</a> &gt; <a href=/garden>Garden</a></nav><main><article class="post-content"><h1>Growing beans</h1>
<p>Beans want warm soil, so wait until the nights are mild before you sow them, and soak the seeds for some hours first.</p>
<h2>Sowing</h2><p>Press four seeds into the earth around each pole, about as deep as a thumb is wide, and water them well.</p>
<p>When the plants have climbed to the top, pinch out their tips; they will then put their strength into pods, not leaves.</p></article>
<div id="comments"><h3>3 replies</h3><div class="comment"><p>Mine were eaten by snails, every single one of them!</p></div></div></main>
<form class="newsletter"><label>Your mail address</label><input type=email><button>Subscribe</button></form><footer><p>All rights reserved</p></footer></body>"""


def test_pages_written_by_hand():
    """Pages that the maker did not write: whole articles come out, and nothing around them."""
    news, howto = (t.split("\n\n") for t in extraction.extract([NEWS, HOWTO], extraction.train()))
    for part in ("Harbour reopens after storm", "The harbour opened again", "Engineers said", "We were lucky", "Fishing boats left"):
        assert any(b.startswith(part) for b in news), part
    for part in ("Growing beans", "Beans want", "Sowing", "Press four", "When the plants"):
        assert any(b.startswith(part) for b in howto), part
    assert not any(w in b for b in news + howto for w in ("Sign in", "Sport", "Most read", "Copyright", "Terms", "Home", "snails", "mail address", "rights reserved"))


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    for html, _ in extraction.labelled(5, seed=8):
        nodes, _, _ = dom.nodes_of(html)
        kept = extraction.decode(nodes, rng.normal(scale=3, size=len(nodes)))
        assert all(n.parent is None or id(n.parent) in kept for n in nodes if id(n) in kept)


def test_rows(spark, clash):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", PAGE), (3, "u", PAGE)]
    got = extraction.extract_text(clash(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted(((r["page_id"], len(r["text"])) for r in got), key=repr) == sorted([(1, 0), (2, 0)] + [(k, len(extraction.extract([PAGE], extraction.train())[0])) for k in (None, 3, 3)], key=repr)
    assert extraction.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
