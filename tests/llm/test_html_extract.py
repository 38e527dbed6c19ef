import html
import re

import duckdb

from tickloom.llm import html_extract as H
from tickloom.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><div id="menu"><a href=x>A</a></div>
<div class="wrap"><div class="story"><h2>T &amp; U</h2><p>One <i>two</i>
 three.<!-- x > y --></p><p>Four<br>five &lt;b&gt; %s</p><div class="ad-box">buy</div><form><p>mail</p></form><ul><li>x<li>y</ul></div>
<div class="comments"><p>first! long long long long long long long long long long long long</p></div><aside>side</aside></div>
<div class="cookie-notice"><p>We use</p></div><footer>f</footer></body></html>"""


def test_article_without_article_tag(spark):
    pages = [(k, f"http://a.example/{k}", PAGE % f"end {k}") for k in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in H.extract_main_text(frame).collect():
        assert r["text"] == f"T & U\nOne two three.\nFour\nfive <b> end {r['page_id']}\nx\ny"


def test_what_is_no_article(spark):
    page = """<body class="has-sidebar"><main><article class="post with-sidebar"><div class="post-header"><h1>T</h1></div><header><p>by x</p><h2>S</h2></header>
<p>A</p><p style="display: none">h</p><section id="comments"><article class="comment"><p>c</p></article></section><p class="notice">n</p>
<div role="alert">r</div><div class="no-comments"><p>B</p></div><aside>s</aside></article><article class="related"><p>more more more more</p></article></main></body>"""
    assert H.main_text(page, None) == "T\nS\nA\nB"
    import json

    assert H.main_text(page, json.dumps(H.reading_of(H.page_wrapper(H.parse(page))))) == "T\nS\nA\nB"


def test_wrapper_is_union_free():
    a, b = (H.wrapper_of(H.parse(x)) for x in ("<ul><li>a<li>b</ul><p>x</p>", "<ul><li>c</ul><h2>t</h2><p>y</p><p>z</p>"))
    both = H.merged(a, b)
    assert H.as_pattern(both) == "<#root>(<ul>(<li>(#)+) <h2>(#)? <p>(#)+)"
    assert H.as_pattern(H.merged(both, a)) == H.as_pattern(both)


def test_whole_articles(spark, sf):
    got = {r["page_id"]: r for r in queries.main_texts(spark, sf).collect()}
    rows = duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, page in rows:
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1])
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", article))
        assert got[i]["text"] == "\n".join(b for b in blocks if b)
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    odd = [None, "", "plain", "<p>", "</p></p>x<", "<article><p>a<article><p>b</article>", deep, "<!-- open", "<script>x", "a < b && c > d", "<a" * 50]
    rows = [(k, None if k % 2 else "http://h/x", x) for k, x in enumerate(odd)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as page", "'z' as wrapper")
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(frame).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 5, 6, 7, 8)] == ["", "", "plain", "", "a\nb", "text", "", ""]
    assert got[9] == "a < b && c > d"
    assert H.extract_main_text(frame).count() == len(rows) and H.extract_main_text(frame.where("false")).count() == 0


def test_articles_below_the_limit(spark):
    deep = lambda levels, inner: "<div>" * levels + inner + "</div>" * levels
    teaser, body = "<section><p>short teaser</p></section>", "<p>a long text of %d</p><p>and its end</p>"
    inner = {
        "tag": f"<article><h2>T</h2>{deep(30, body)}</article><nav>n</nav>",
        "main": f"<main><p>by x</p><div><article>{body}</article></div></main>",
        "plain": body,
    }
    for levels in (H.DEEPEST - 3, H.DEEPEST, 40, 3000):
        for kind, page in inner.items():
            rows = [(k, "http://d.example/", f"<body>{teaser}{deep(levels, page % k)}</body>") for k in range(3)]
            frame = spark.createDataFrame(rows, "page_id long, url string, html string")
            head = "T\n" if kind == "tag" else ""
            got = {r["page_id"]: r["text"] for r in H.extract_main_text(frame).collect()}
            assert got == {k: f"{head}a long text of {k}\nand its end" for k in range(3)}, (levels, kind)


def read(spark, pages):
    frame = spark.createDataFrame([(k, "http://n.example/x", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in H.extract_main_text(frame).collect()}


NEUTRAL = """<body><div class="q0"><div class="r"><a href=a>Home</a></div><div class="r"><a href=b>All of it</a></div><div class="r"><a href=c>More</a></div></div>
<div class="q2"><div class="k1">Read this journal every day, it is free and it always will be free, say its makers.</div><h2>Title {n}</h2><p>Text {n} one.</p><p>Text {n} <a href=z>two</a>.</p>
<div class="k2"><ul><li><a href=1>next {m}</a><li><a href=2>other {n}</a><li><a href=3>third {m}</a></ul></div><p class="w">{n} more</p></div>
<div class="q7"><p>All rights are ours, and nobody else may have any of them without a letter from us, signed and stamped.</p></div></body>"""


def test_template_and_menus_by_slots_alone(spark):
    pages = [NEUTRAL.format(n=f"n{k}", m=f"m{k * 7}") for k in range(6)]
    got = read(spark, pages)
    assert got == {k: f"Title n{k}\nText n{k} one.\nText n{k} two.\nn{k} more" for k in range(6)}
    assert "every day" in H.main_text(pages[0], None)  # without the wrapper nothing tells the line from the article


def test_a_line_on_every_page_between_paragraphs(spark):
    page = "<{tag}><p>Sign up for our letter.</p><p>Own {k}.</p><p>Second of {k}.</p><p>Thanks for reading.</p></{tag}>"
    whole = {k: f"Sign up for our letter.\nOwn {k}.\nSecond of {k}.\nThanks for reading." for k in range(6)}
    assert read(spark, [page.format(k=k, tag="article") for k in range(6)]) == whole  # what a tag calls the article is whole
    pages = [page.format(k=k, tag="div") for k in range(6)]
    assert read(spark, pages) == {k: f"Own {k}.\nSecond of {k}." for k in range(6)}
    # Four different pages prove nothing, nor do copies of one page.
    assert "Sign up" in read(spark, pages[:4])[0] and "Thanks" in read(spark, pages[:1] * 9)[3]
    assert "Sign up" in read(spark, pages[:1] * 9 + pages[1:2])[0]


def test_an_article_after_many_siblings(spark):
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(200)]
    divs = "".join(f"<div class='z{n}'>teaser {n} with some words</div>" for n in names)
    article = "<article><p>" + "the article itself {k} " * 20 + "</p></article>"
    pages = [f"<body>{divs}{article.replace('{k}', str(k))}{divs}</body>" for k in range(3)]
    assert read(spark, pages) == {k: (f"the article itself {k} " * 20).strip() for k in range(3)}
    inner = [f"<body>{divs}<div class='last'>{article.replace('{k}', str(k))}</div></body>" for k in range(3)]
    assert read(spark, inner) == {k: (f"the article itself {k} " * 20).strip() for k in range(3)}


def test_numbers_in_classes_that_differ_by_page(spark):
    pages = [f"<body><div class='top'><a href=x>a</a></div><div id='post-{k}' class='c{k % 2}'><p>body of {k}</p><p>end {k}</p></div></body>" for k in range(5)]
    assert read(spark, pages) == {k: f"body of {k}\nend {k}" for k in range(5)}


def test_broken_pages_take_linear_time():
    import time

    broken = [
        "<svg " * 50_000, "<a b='" * 50_000, "<a \"" * 50_001 + ">", "<div>" * 50_000 + "</p></span>" * 50_000, "<!-- " * 50_000, "<script>" * 50_000, "<" * 300_000,
        "<p><b>" * 50_000, "<ul><li>" * 50_000, "<!x " * 50_000, "<td>" * 50_000, "<a x=\"y' z='w\">" * 20_000,
    ]
    for page in broken:
        start = time.perf_counter()
        H.parse(page)
        assert time.perf_counter() - start < 3, page[:20]
