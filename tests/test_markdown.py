from stmtflow.operators import markdown as md

DOC = "# First\n\nalpha\n|a|b|\n|---|---|\n|1|2|\n---\nbeta line\n# Second\n\ngamma\n---\n# Third\ndelta"


def _doc(spark, text=DOC):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_split_pages_ignores_table_separators(spark):
    pages = md.split_pages(_doc(spark)).orderBy("page").collect()
    assert [p.page for p in pages] == [1, 2, 3]
    assert "|---|---|" in pages[0].page_text and pages[1].page_text.startswith("beta line")


def test_heading_sections_carry_across_pages(spark):
    rows = md.heading_sections(_doc(spark)).collect()
    heading = {r.line_text: r.heading for r in rows}
    assert heading["alpha"] == "First"
    assert heading["beta line"] == "First"  # page 2 starts without a heading
    assert heading["gamma"] == "Second" and heading["delta"] == "Third"
    # the document's lines are all kept, none invented
    assert sorted(r.line_text for r in rows) == sorted(DOC.replace("\n---\n", "\n").split("\n"))


def test_table_cells(spark):
    cells = md.table_cells(_doc(spark)).orderBy("line", "col").collect()
    assert [(c.col, c.cell) for c in cells] == [(1, "a"), (2, "b"), (1, "1"), (2, "2")]


def test_heading_carry_over_many_pages(spark):
    text = "none\n---\n# A\n---\nx\n---\ny\n---\n# B\n---\nz"
    rows = {r.line_text: r.heading for r in md.heading_sections(_doc(spark, text)).collect()}
    assert rows["none"] is None and rows["x"] == rows["y"] == "A" and rows["z"] == "B"
    pages = "\n---\n".join(["# H"] + ["p"] * 20_000)
    assert md.heading_sections(_doc(spark, pages)).where("heading = 'H'").count() == 20_001


def test_wide_separator_rows(spark):
    wide = "|a" * 20_000 + "|\n" + "|---" * 20_000 + "|"
    assert md.table_cells(_doc(spark, wide)).count() == 20_000


def test_marked_bars_and_backslashes(spark):
    rows = {r"|a\|b|c|": ["a|b", "c"], r"|a\\|b|": ["a\\", "b"], r"|x\|": ["x|"], r"| C:\dir |\|": ["C:\\dir", "|"], "|a|b": ["a", "b"],
            r"|a\\\|b|": ["a\\|b"], "||": [""], "|a||c|": ["a", "", "c"], r"|\\|": ["\\"]}
    df = spark.createDataFrame([(i, line) for i, line in enumerate(rows)], "doc_id long, text string")
    got = {}
    for c in md.table_cells(df).orderBy("doc_id", "col").collect():
        got.setdefault(c.doc_id, []).append(c.cell)
    assert got == dict(enumerate(rows.values()))
    long = "|" + r"\|x" * 50_000 + "|"
    assert md.table_cells(_doc(spark, long)).first().cell == "|x" * 50_000


def test_cells_survive_html_and_markdown(spark):
    from stmtflow.operators.text import html_to_markdown

    cells = ["a|b", "c", "\\", "x\\|y", "", "é & <b>", "1 2", "tail\\"]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    html = "<table><tr>" + "".join(f"<td>{escape(c)}</td>" for c in cells) + "</tr><tr><td>n</td></tr></table>"
    pages = html_to_markdown(spark.createDataFrame([(1, html)], "doc_id long, html string"), out_col="text")
    got = [c.cell for c in md.table_cells(pages).orderBy("line", "col").collect()]
    assert got == [*cells, "n"]
