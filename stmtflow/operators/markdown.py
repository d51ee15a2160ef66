"""Markdown structure operators: pages, lines, heading sections, table cells.

All of them are map-only: a document is one row, and its pages, sections and lines
are produced with ``split`` + ``posexplode`` inside that row. No shuffle of the text
is needed, so the cost is linear in the corpus and partitions stay where the scan
put them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAGE_BREAK_RE, col_of

HEADING_START_RE = r"(?m)^(?=#{1,6}[ \t])"
HEADING_RE = r"^#{1,6}[ \t]+([^\n]*?)[ \t]*$"
LAST_HEADING_RE = r"(?s).*(?:^|\n)#{1,6}[ \t]+([^\n]*?)[ \t]*(?:\n|$)"
# The repeated cell is possessive, which matches by a loop however many cells there are.
SEPARATOR_ROW_RE = r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)++\s*:?-*:?\s*\|?\s*$"


def _trim_newlines(c):
    return F.regexp_replace(c, r"^\n+|\n+$", "")


def page_array(text="text"):
    """Array of page texts, split at lines holding only ``---``."""
    return F.transform(F.split(col_of(text), PAGE_BREAK_RE), _trim_newlines)


def split_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per page: ``(id, page, page_text)``, pages numbered from 1.

    A table separator such as ``|---|---|`` is not a page break.
    """
    return (df.select(F.col(id_col), F.posexplode(page_array(text_col)).alias("pos", "page_text"))
              .select(id_col, (F.col("pos") + 1).alias("page"), "page_text"))


def split_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``(id, page, line, line_text)``, both numbered from 1."""
    pages = split_pages(df, id_col, text_col)
    return (pages.select(id_col, "page", F.posexplode(F.split("page_text", "\n")).alias("pos", "line_text"))
                 .select(id_col, "page", (F.col("pos") + 1).alias("line"), "line_text"))


def heading_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tag every line with the latest heading before it, carried across page breaks.

    Output ``(id, page, section, line, heading, line_text)``; ``section`` counts the
    heading blocks within the page (0 = lines before the page's first heading, which
    inherit the last heading of an earlier page). Computed inside each document row,
    so no window or shuffle over lines is needed.
    """
    pages = page_array(text_col)
    with_pages = df.select(F.col(id_col), pages.alias("_pages"))
    # Each heading that ends a page is carried over the pages up to the next such page: the carried
    # headings of all pages are runs of one heading each, written out one after another.
    carried = F.expr("""concat(
        array_repeat(CAST(NULL AS string), IF(size(_heads) = 0, size(_pages), get(_heads, 0).i + 1)),
        flatten(zip_with(_heads, slice(_heads, 2, size(_heads)),
                         (a, b) -> array_repeat(a.h, coalesce(b.i, size(_pages) - 1) - a.i))))""")
    paged = (with_pages.withColumn("_heads", F.filter(
                 F.transform("_pages", lambda p, i: F.struct(F.regexp_extract(p, LAST_HEADING_RE, 1).alias("h"), i.alias("i"))),
                 lambda x: x["h"] != ""))
             .select(id_col, F.posexplode(F.arrays_zip(F.col("_pages").alias("t"), carried.alias("c"))).alias("_p", "_pg")))
    sections = paged.select(
        id_col, (F.col("_p") + 1).alias("page"), F.col("_pg.c").alias("_carry"),
        F.posexplode(F.split(F.col("_pg.t"), HEADING_START_RE)).alias("section", "_sec"))
    own = F.regexp_extract(F.col("_sec"), r"^#{1,6}[ \t]+([^\n]*?)[ \t]*(?:\n|$)", 1)
    starts_with_heading = F.col("_sec").rlike(r"^#{1,6}[ \t]")
    tagged = sections.select(
        id_col, "page", "section",
        F.when(starts_with_heading, own).otherwise(F.col("_carry")).alias("heading"),
        # The newline that ends a section's last line is not a line of its own.
        F.posexplode(F.split(F.regexp_replace(F.col("_sec"), r"\n\z", ""), "\n")).alias("_l", "line_text"))
    # Lines are numbered within the section; (page, section, line) orders the document.
    return tagged.select(id_col, "page", F.col("section").cast("int").alias("section"),
                         (F.col("_l") + 1).alias("line"), "heading", "line_text")


# A cell and the bar after it; a backslash keeps the character after it from being one. All repeats are possessive.
CELL_RE = r"((?:[^|\\]++|\\[\s\S])*+)\|"


def row_cells(line) -> Column:
    """Cells of a pipe row, trimmed, with marked bars and backslashes as they were meant."""
    inner = F.regexp_replace(F.trim(col_of(line)), r"^\|", "")
    escapes = inner.contains("\\")
    # The last bar closes the row, unless it is marked as a character of the last cell.
    closed = F.when(escapes, inner.rlike(r"(?<!\\)(?:\\\\)*+\|$")).otherwise(inner.endswith("|"))
    inner = F.when(closed, inner).otherwise(F.concat(inner, F.lit("|")))
    bars = F.split(inner, r"\|")
    marked = F.transform(F.regexp_extract_all(inner, F.lit(CELL_RE), F.lit(1)), lambda c: F.regexp_replace(c, r"\\([|\\])", "$1"))
    return F.transform(F.when(escapes, marked).otherwise(F.slice(bars, 1, F.size(bars) - 1)), lambda c: F.trim(c))


def table_cells(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pipe-table rows as cells: ``(id, page, line, col, cell)``; separator rows dropped.

    A bar marked by a backslash belongs to its cell, and a marked backslash is one.
    """
    lines = split_lines(df, id_col, text_col)
    rows = lines.where(F.col("line_text").startswith("|") & ~F.col("line_text").rlike(SEPARATOR_ROW_RE))
    return (rows.select(id_col, "page", "line", F.posexplode(row_cells("line_text")).alias("_c", "cell"))
                .select(id_col, "page", "line", (F.col("_c") + 1).alias("col"), "cell"))
