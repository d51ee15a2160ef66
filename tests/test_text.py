from pyspark.sql import functions as F

from stmtflow.functions.text import DATE_FORMATS, format_money, is_blank, normalize_account, normalize_date, parse_money, py_strip
from stmtflow.operators import text as tx

TRICKY = ["", " ", "\t\n", "\x0b\x0c", "\x1c\x1d\x1e\x1f", "\x85", "\xa0", "\u1680", "\u2000\u200a",
          "\u2028\u2029", "\u202f\u205f\u3000", "\u200b", "a", " a ", "\ufeff"]


def test_is_blank_matches_python_strip(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TRICKY)] + [(99, None)], "i int, s string")
    got = {r.i: r.b for r in df.select("i", is_blank("s").alias("b")).collect()}
    for i, s in enumerate(TRICKY):
        assert got[i] == (not s.strip()), repr(s)
    assert got[99] is True


def test_py_strip(spark):
    df = spark.createDataFrame([("\u3000 x y\x85\n",)], "s string")
    assert df.select(py_strip("s")).first()[0] == "x y"


def test_money_and_dates(spark):
    df = spark.createDataFrame([("$1,234.56", "March 7, 2018", -198.92)], "m string, d string, x double")
    r = df.select(parse_money("m").cast("string").alias("m"), F.date_format(normalize_date("d"), "yyyy-MM-dd").alias("d"),
                  format_money("x").alias("f"), normalize_date(F.lit("Mar 7, 2018")).alias("d2"),
                  normalize_date(F.lit("2018-03-07")).alias("d3"), normalize_date(F.lit("7 March 2018")).alias("bad"),
                  normalize_account(F.lit("10 101 010 10")).alias("a")).first()
    assert (r.m, r.d, r.f, r.a) == ("1234.56", "2018-03-07", "-$198.92", "1010101010")
    assert str(r.d2) == str(r.d3) == "2018-03-07" and r.bad is None


def test_text_measure_counts_code_points(spark):
    df = spark.createDataFrame([(1, "é😀a")], "doc_id long, text string")
    assert tx.text_measure(df).first().n_chars_measured == 3


def test_context_budget(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, "y" * 25)], "doc_id long, text string")
    out = {r.doc_id: r for r in tx.context_budget(df, max_tokens=5).collect()}
    assert out[1].approx_tokens == 3 and not out[1].over_budget and out[1].text == "x" * 10
    assert out[2].approx_tokens == 7 and out[2].over_budget and out[2].text == "y" * 25  # flagged, never cut


def test_strict_money_and_dotted_months(spark):
    money = {"$1,234.56": "1234.56", "-$198.92": "-198.92", "1 2 3": None, "1,2,3": None, "$1,23.00": None, "12": "12.00",
             "$12.5": "12.50", "": None, "$": None, "1.2.3": None, "$1,234,567.00": "1234567.00"}
    dates = {"Mar. 7, 2018": "2018-03-07", "Sept 7, 2018": "2018-09-07", "Sept. 7, 2018": "2018-09-07", "May. 1, 2020": "2020-05-01",
             "September 7, 2018": "2018-09-07", "Foo 7, 2018": None}
    rows = spark.createDataFrame([(k,) for k in money], "s string").select("s", parse_money("s").cast("string").alias("v")).collect()
    assert {r.s: r.v for r in rows} == money
    rows = spark.createDataFrame([(k,) for k in dates], "s string").select("s", normalize_date("s").cast("string").alias("v")).collect()
    assert {r.s: r.v for r in rows} == dates


def test_filter_blank_content(spark):
    df = spark.createDataFrame([(1, " \u3000"), (2, "x"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in tx.filter_blank_content(df).collect()] == [2]
    flags = {r.doc_id: r.is_blank for r in tx.filter_blank_content(df, mode="flag").collect()}
    assert flags == {1: True, 2: False, 3: True}


def test_assemble_parts_orders_and_drops_blank(spark):
    parts = spark.createDataFrame(
        [(1, 2, "second"), (1, 0, "first"), (1, 1, "  "), (1, 3, None), (2, 0, "\n")],
        "doc_id long, pos int, text string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    out = {r.doc_id: r.text for r in tx.assemble_parts(parts, documents=docs).collect()}
    assert out == {1: "first\n\nsecond", 2: None, 3: None}


def test_render_prompt(spark):
    df = spark.createDataFrame([(7, "BODY")], "doc_id long, text string")
    rows = tx.prompt_messages(df).orderBy("seq").collect()
    assert [r.role for r in rows] == ["system", "user"]
    assert "BODY" in rows[1].content and "account_number" in rows[1].content


def test_html_to_markdown(spark):
    html = ('<html><head><title>T</title><style>p{}</style></head><body><nav><a>skip</a></nav>'
            '<h1>Head &amp; more</h1><p>One&middot;two</p><!-- c --><ul><li>a</li><li>b</li></ul>'
            '<script>var x="</p>";</script><footer>f</footer></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    md = tx.html_to_markdown(df).first().markdown
    assert md == "# Head & more\n\nOne·two\n\n- a\n- b"


def test_html_structures(spark):
    cases = {
        "<h2>Two</h2><h6>Six</h6>x": "## Two\n\n###### Six\n\nx".replace("\n\n#", "\n\n#").replace("Six\n\nx", "Six\nx"),
        "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>": "|A|B|\n|---|---|\n|1|2|",
        "<p>a &lt;b&gt;&nbsp;c &#39;d&#x27; &amp;lt;</p>": "a <b> c 'd' &lt;",
        "<nav>x<script>y</script>z</nav>keep": "keep",
        "<head><title>t</title></head>b<footer>f</footer>": "b",
        "1 < 2 &#0; &#x1F600;": "1 < 2 \ufffd \U0001f600",
        "<!-- open": "",
        "<div>a</div><div>b</div>": "a\n\nb",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = {r.html: r.markdown for r in tx.html_to_markdown(df).collect()}
    for html, markdown in cases.items():
        assert got[html] == markdown, html
    kept = tx.html_to_markdown(spark.createDataFrame([(1, "<nav>menu</nav>a<footer>end</footer>")], "page_id long, html string"), keep_frame=True)
    assert kept.first().markdown == "menua" + "end"


def test_assemble_parts_is_one_grouping(spark):
    parts = spark.createDataFrame([(1, 0, "a"), (2, 0, " ")], "doc_id long, pos int, text string")
    out = tx.assemble_parts(parts)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a", 2: None}
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_date_is_read_by_one_format_only(spark):
    """A format that cannot read a value costs an exception, so only one is tried; the values are those of all formats in turn."""
    tried = ["March 7, 2018", "Mar 7, 2018", "Mar. 7, 2018", "may 7, 2018", "May. 7, 2018", "Sept 7, 2018", "SEPT. 17,  2018", "September 7, 2018",
             "2018-03-07", " 2018-03-07 ", "+12018-03-07", "-2018-03-07", "2018-3-7", "", " ", "7 March 2018", "Marc 7, 2018", "Mar", "Mar ",
             "Mai 7, 2018", "March 32, 2018", "Feb 30, 2018", "n/a x", "2018", "March  7, 2018", "M\u00e4r 7, 2018", None]
    c = F.regexp_replace(F.trim("v"), r"[ \t]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"^([A-Za-z]{3,4})\.", "$1"), r"(?i)^sept ", "Sep ")
    in_turn = F.coalesce(*[F.try_to_date(c, fmt) for fmt in DATE_FORMATS])
    df = spark.createDataFrame([(v,) for v in tried], "v string")
    rows = df.select("v", normalize_date("v").cast("string").alias("one"), in_turn.cast("string").alias("all")).collect()
    assert [(r.v, r.one) for r in rows] == [(r.v, r["all"]) for r in rows]
    assert sum(r.one is not None for r in rows) >= 11
    plan = df.select(normalize_date("v"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "coalesce" not in plan


def test_money_is_cleaned_without_a_pattern(spark):
    df = spark.createDataFrame([(v,) for v in ["$1,234.56", "-$198.92", "\t1234.5\n", "\x0b$ 7\f\r", "1 2 3", "1,2,3", "", None]], "v string")
    assert [r[0] for r in df.select(parse_money("v").cast("string")).collect()] == ["1234.56", "-198.92", "1234.50", "7.00", None, None, None, None]
    assert "regexp_replace" not in df.select(parse_money("v"))._jdf.queryExecution().optimizedPlan().toString().lower()
