import time

import pytest

from stmtflow.functions.html import to_markdown
from stmtflow.operators.text import html_to_markdown

CASES = {
    "<ul><li>a<ul><li>b</li><li><p>c</p></li></ul></li><li>d<ol start=3><li>x<li>y</ol></ul>z": "- a\n  - b\n  - c\n- d\n  3. x\n  4. y\nz",
    "<ol><li>one<li>two</ol>": "1. one\n2. two",
    '<p>See <a href="/x?a=1&amp;b=2">the <b>page</b></a>, <a>no address</a>.</p>': "See [the page](/x?a=1&b=2), no address.",
    "<a href='a b(c)'> x\ny </a><a href=z></a>": "[x y](a%20b(c%29)",
    '<a href="1">one<a href="2">two': "[one](1)[two](2)",
    "&eacute;&frac12;&NotEqual; &copy &hearts;&notanentity; &#x41;&#66;": "é½≠ © ♥¬anentity; AB",
    "<pre>\n a &lt;\n\n\n  <b>b</b>\n</pre>c": "```\n a <\n\n\n  b\n```\nc",
    "<code>x</code> and <pre><code>y\n</code></pre>": "`x` and \n\n```\ny\n```",
    "<table><tr><th>A|B<th>C\\D<tr><td><p>q</p>r<td>e</table>": "|A\\|B|C\\\\D|\n|---|---|\n|q r|e|",
    "<table><tr><td>o<table><tr><td>in</td><td>ner</td></tr></table></td><td>x</td></tr></table>": "|o in ner|x|\n|---|---|",
    "<table><caption>t</caption><tr></tr><tr><td>1</td></tr></table>": "t\n\n|1|\n|---|",
    '<p title="a > b">t</p><p title="open>u': "t\n\nu",
    "a<hr>b": "a\n\n* * *\n\nb",
    '<img src="i.png" alt="a cat"><img src="x">': "![a cat](i.png)",
    "<nav>a<nav>b</nav><script>'</nav>'</script>c</nav>d": "d",
    "<head><title>t</title><body>b": "b",
    "<template><p>x</p></template>y<noscript>z": "y",
    "x < y <3 </ p> <!DOCTYPE html>": "x < y <3 </ p> ",
    "a<b": "a<b",
    "\x02<pre>x</pre>": "```\nx\n```",
    "</table></td></a></pre></ul>t<td>u": "t u",
    "<pre>a<pre>b</pre>c": "```\na\nb\n```\nc",
    "<p>a</p><ul><li><p>b</p><ul><li>c</ul><li>d</ul>": "a\n\n- b\n  - c\n- d",
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_structures(html):
    assert to_markdown(html) == CASES[html]


def test_columns_stay_and_null_is_null(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "k"), (2, None, "k")], "page_id int, html string, key string")
    assert sorted(map(tuple, html_to_markdown(df).collect())) == [(1, "<p>a</p>", "k", "a"), (2, None, "k", None)]


@pytest.mark.parametrize("part", ['<div>', '<a "', "<a '\"", "<nav>", "<a href=x>", "<ul><li>", "<script>", "<!--", "<table><tr><td>", "<pre>"])
def test_time_is_linear_in_the_page(part):
    def spent(n):
        t = time.process_time()
        to_markdown(part * n + "</section></a></td>" * n)
        return time.process_time() - t

    spent(1000)
    assert spent(16_000) < 40 * max(spent(2_000), 0.01)


def test_a_plain_tag_is_found_in_one_step(monkeypatch):
    from stmtflow.functions import html

    class Unused:
        def __getattr__(self, name):
            raise AssertionError("a tag without quotes is searched for its end")

    monkeypatch.setattr(html, "STOP", Unused())
    page = "<table><tr><th>A</th><td id=1>b|c</td></tr></table><blink>x<br/>y</blink>"
    assert html.to_markdown(page) == "|A|b\\|c|\n|---|---|\nx\ny"
    monkeypatch.undo()
    assert html.to_markdown("<p title='a>b'>x</p><a href=\"u>v\">t</a>") == "x\n[t](u>v)"
