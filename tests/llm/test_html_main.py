import html
import re

from stmtflow.llm import html_main as hm


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, host string, token int")


def result(df):
    return {r.page_id: (r.text, r.n_chars) for r in df.collect()}


def test_query_equals_the_articles(spark, sf_small):
    from stmtflow.llm.catalog import QUERIES

    got = result(QUERIES["op3_html_main"](spark, sf_small))
    rows = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = r.html[r.html.index("<article>"):r.html.index("</article>")]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert got[r.page_id] == (text, len(text))


def test_template_without_article_elements(spark):
    def page(i):
        body = " ".join(f"word{i}x{j}" for j in range(60))
        return (f'<html><body><div class="top"><div class="logo">Our Site</div></div><div class="wrap">'
                f'<div class="left-sidebar"><ul><li>Latest {i}</li></ul></div>'
                f'<div class="story"><p>Published by the desk</p><p>{body}</p><p>A &lt;b&gt; &amp;&nbsp;c {i}</p></div>'
                f'<div class="comments"><p>reader {i} says no</p></div></div><div class="site-footer">&copy; us</div></body></html>')

    rows = [(i, f"http://h.example/{i}", page(i), "x", "y", 1) for i in range(8)]
    for i, (text, _) in result(hm.extract(pages(spark, rows))).items():
        # The line in every story is in the class of the story's own element: template, not content.
        assert text == " ".join(f"word{i}x{j}" for j in range(60)) + f" A <b> & c {i}"


def test_template_within_article_elements(spark):
    def page(i, body):
        return (f'<html><body><nav>menu</nav><article><h1>Title {i}</h1><p class="desk">Published by the desk</p><p>{body}</p>'
                f'<p>last</p><p>last</p></article><div class="site-footer">&copy; us</div></body></html>')

    words = [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(8)]
    rows = [(i, f"http://h.example/{i}", page(i, words[i]), "x", "y", 1) for i in range(8)]
    # A host whose pages are copies keeps their text, and so does a group of copies among other pages.
    rows += [(100 + i, f"http://copies.example/{i}", page(0, words[0]), "x", "y", 1) for i in range(8)]
    rows += [(200 + i, f"http://some.example/{i}", f"<article><p>{i} {words[i % 8]}</p></article>", "x", "y", 1) for i in range(12)]
    rows += [(300 + i, f"http://some.example/c{i}", f"<article><table><tr><td>{words[0]}</table></article>", "x", "y", 1) for i in range(4)]
    got = result(hm.extract(pages(spark, rows)))
    for i in range(8):
        assert got[i][0] == f"Title {i} {words[i]} last last"
        assert got[100 + i][0] == f"Title 0 Published by the desk {words[0]} last last"
    assert all(got[300 + i][0] == words[0] for i in range(4))


def test_parts_of_one_page():
    take = lambda h: hm.main_text(h, None, frozenset())
    assert take("a<b>b</b>c<br>d<p>e") == "abc d e"
    assert take("<nav>menu</nav><article><header><h1>T</h1></header><p>x</p><aside>y</aside><form>z</form></article><p>after") == "T x"
    assert take("<body><header>site</header><div id=cookie-notice>ok?</div><div class='ad'>buy</div><p>text</p></body>") == "text"
    assert take("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style>yes<!-- no --><!-- open") == "yes"
    assert take("<p title='a > b'>x &eacute; &#x41;&amp;lt;</p>") == "x é A&lt;"
    assert take("1 < 2 <> & 3") == "1 < 2 <> & 3"
    assert take("<article>a<section class=comments>b") == "a"
    assert take("<div class='content with-sidebar'>x</div>") == "x"
    assert take("<p" * 20000) == "" and take("<p>" * 3000 + "x") == "x"


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, None), (2, "http://a/", "", None, None, None), (None, None, "<p>x</p>", None, None, None),
            (3, "not a url", "<article>y</article>", None, None, None), (3, "not a url", "<article>y</article>", None, None, None)]
    got = hm.extract(pages(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == sorted(
        [(1, "", "", 0), (2, "http://a/", "", 0), (0, "", "x", 1), (3, "not a url", "y", 1), (3, "not a url", "y", 1)])
    assert hm.extract(pages(spark, [])).count() == 0


def test_hosts():
    assert hm.host_of("https://User@WWW.example.com:80/x?y") == "www.example.com"
    assert hm.host_of("/x") is None and hm.host_of(None) is None


def test_names_within_an_article_take_nothing_away():
    body = ('<h2 id="discussion">Head</h2><section id="discussion"><p>One</p></section><div class="search-results">Two</div>'
            '<p class="copyright-law">Three</p><p>E = <math><mi>m</mi><mo>c</mo></math></p><video src=v>Four<p class="notice">Five</p>')
    apart = '<div class="ad-box">advert</div><div class="comments"><p>reader</p></div><div class="share-links">share</div><ul class="related">more</ul>'
    page = f'<body><div id="search">find</div><article>{body}{apart}</article></body>'
    assert hm.main_text(page, None, frozenset()) == "Head One Two Three E = mc Four Five"
    outside = '<div class="search-results">a</div><div id="discussion">b</div><p>Text.</p>'
    assert hm.main_text(outside, None, frozenset()) == "Text."


def test_stray_tags_take_linear_time():
    import time

    def spent(page):
        t = time.process_time()
        hm.main_text(page, None, frozenset())
        return time.process_time() - t

    for part, stray in (("<div>", "</section>"), ("<i>", "</p>"), ("<i>", "<h2>")):
        spent(part * 500 + stray * 500)
        assert spent(part * 16_000 + stray * 16_000) < 40 * max(spent(part * 2_000 + stray * 2_000), 0.02)


def test_templates_beyond_the_broadcast_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.com/{i}", f"<body><h1>Site</h1><div><p>Text {i} of the page.</p></div><p>All rights</p></body>", "x", "y")
                                   for i in range(12)], "page_id bigint, url string, html string, host string, texts string")
    few = sorted(map(tuple, hm.extract(pages).collect()))
    monkeypatch.setattr(hm, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, hm.extract(pages).collect())) == few and all("All rights" not in r[2] for r in few)
