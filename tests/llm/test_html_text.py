import re
import time
from html import unescape

from shiftscope.llm.html_text import extract, main_text

LONG = "This is a long enough sentence, with commas, that a reader would take for the article's own words."


def test_plain_rules():
    assert main_text(None) == "" and main_text("") == ""
    assert main_text("<p>Tom &amp; Jerry&nbsp;&#233;&eacute; x &lt;b&gt;</p>") == "Tom & Jerry éé x <b>"
    assert main_text("<article><h1>T</h1><p>a<br>b <b>c</b>d\n\n e</article>") == "T\na b cd e"
    assert main_text("<p>a < b and 1<2") == "a < b and 1<2"
    assert main_text("<style>p{}</style><script>var t='</p>';</script><p>x</p><!-- c <p>no</p> -->") == "x"


def test_furniture_goes():
    page = f"""<html><head><title>t</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">{LONG}</div>
    <div class="sidebar"><p>{LONG}</p></div><div><p>{LONG}</p><p>Second &mdash; {LONG}</p><p>ok.</p></div>
    <form><label>mail</label><p>{LONG}</p></form><section class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>
    <ul class="menu"><li><a href=x>one</a><li><a href=y>two</a></ul><footer>{LONG}</footer></body></html>"""
    assert main_text(page) == f"{LONG}\nSecond — {LONG}\nok."


def test_names_of_content_and_furniture():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(3))
    want = "\n".join(f"{LONG} {i}" for i in range(3))
    page = lambda inner: f"<body><div class=site><div class='post-content'>{body}</div>{inner}</div></body>"
    for name in ("post-comments", "commentList", "page-header", "related-posts", "main-nav", "sidebar content", "article-ad", "cookieBanner", "newsletter-signup"):
        assert main_text(page(f'<div class="{name}"><p>{LONG}</p><p>{LONG}</p></div>')) == want, name
    assert main_text(f'<article><div class="entry-header"><h1>Title</h1></div>{body}<div class="post-meta">By A</div></article>') == f"Title\n{want}\nBy A"
    for tag in ("nav", "aside", "footer", "form", "header"):
        assert main_text(f"<body><main>{body}</main><{tag}><p>{LONG}</p></{tag}></body>") == want, tag
    for attrs in ("hidden", 'role="complementary"', 'aria-hidden="true"', 'style="display: none"'):
        assert main_text(page(f"<div {attrs}><p>{LONG}</p></div>")) == want, attrs


def test_cut_off_page_and_nested():
    assert main_text(f"<article><p>{LONG}<p>{LONG[:30]}</article><foo") == f"{LONG}\n{LONG[:30]}"
    deep = "<div>" * 5000 + f"<p>{LONG}</p>"
    assert main_text(deep) == LONG
    assert main_text("<ul><li><a href=1>a</a><li><a href=2>b</a></ul>" + f"<div><p>{LONG}</p></div>") == LONG


LINKS = "<ul><li><a href=1>First source</a><li><a href=2>Second source</a><li><a href=3>Third source</a></ul>"


def test_pages_without_article_or_main():
    page = f"""<body><div id=top><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div class=site><h1>Title</h1><div><p>{LONG}</p><h3>Part</h3>
    <pre>x = 1</pre><ul><li>one<li>two</ul><p>{LONG}</p><h2>Sources</h2>{LINKS}</div><div><a href=1>More</a> <a href=2>Other</a> <a href=3>Next</a></div></div></body>"""
    assert main_text(page) == f"Title\n{LONG}\nPart\nx = 1\none\ntwo\n{LONG}\nSources\nFirst source\nSecond source\nThird source"
    # the text in several containers: what stands between them stays
    parts = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(f"<body><div>{LINKS}</div><div><h1>T</h1>{parts}<h3>Middle</h3><pre>code</pre><ul><li>item</ul>{parts}</div></body>") == "\n".join(["T", LONG, LONG, "Middle", "code", "item", LONG, LONG])


def test_lists_of_links_in_an_article():
    assert main_text(f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><h2>Sources</h2>{LINKS}</article>") == f"T\n{LONG}\n{LONG}\nSources\nFirst source\nSecond source\nThird source"
    inner = f"<div><p>{LONG}</p><p>{LONG}</p>{LINKS}</div>"
    assert main_text(f"<article><h1>T</h1>{inner}<p>By A</p>{LINKS}</article>") == f"T\n{LONG}\n{LONG}\nFirst source\nSecond source\nThird source\nBy A"


def test_the_score_decides_between_containers():
    best = f"<div><p>{LONG} {LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    teaser = f"<article><p>{LONG[:40]}</p></article>"
    assert main_text(f"<body>{teaser}{teaser}<section>{best}</section></body>") == f"{LONG} {LONG}\n{LONG}\n{LONG}"
    links = "<div>" + "".join(f"<p><a href={i}>{LONG}</a></p>" for i in range(9)) + "</div>"
    assert main_text(f"<body>{links}<section>{best}</section></body>") == f"{LONG} {LONG}\n{LONG}\n{LONG}"


def test_hostile_pages_take_time_in_proportion():
    n = 100_000
    for page in ("<div>" * n + f"<p>{LONG}</p>", f"<div><p>{LONG}" * n, "<div>" * n + "<li>x</li>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<pre>" * n, "<div>" * n + "</section>" * n, "<div><span>" * n + LONG, f"<p>{LONG}</p>" + LINKS * (n // 10)):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 15, page[:40]


def brute(page):
    """The synthetic pages' articles, cut out with patterns."""
    m = re.search(r"<article>(.*?)(</article>|<footer|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1|ul|li|div|article)\b[^>]*>", m[1])
    lines = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", re.sub("<br>", " ", re.sub(r"<[^>]*\Z", "", p)))).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def test_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extract(pages).collect()}
    bad = [k for k in want if want[k] != got[k]]
    assert not bad, (bad[:3], want[bad[0]][:300], got[bad[0]][:300])


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "y"), (None, None, "<p>a", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(pages).collect()) == [(0, "a", 1), (1, "", 0), (1, "a", 1)]
    assert extract(pages.limit(0)).count() == 0
