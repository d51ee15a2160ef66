"""Document text operators: blank filter, length, context budget, prompts, part
assembly and HTML-to-Markdown. Native expressions but for ``html_to_markdown``; only
``assemble_parts`` shuffles (it groups parts by document)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import to_markdown
from ..functions.text import char_length, is_blank
from ..schemas import BILL_RECORD, CONTEXT_MAX_TOKENS, DEFAULT_DOCUMENT_TYPE, PART_SEPARATOR, RecordSchema

CHARS_PER_TOKEN = 4  # rough token estimate when no tokenizer is used (our choice)


def filter_blank_content(df: DataFrame, text_col: str = "text", mode: str = "drop") -> DataFrame:
    """``drop`` rows whose text is NULL, empty or whitespace, or ``flag`` them (``is_blank``)."""
    blank = is_blank(F.col(text_col))
    if mode == "flag":
        return df.withColumn("is_blank", blank)
    return df.where(~blank)


def text_measure(df: DataFrame, text_col: str = "text", out_col: str = "n_chars_measured") -> DataFrame:
    """Length in code points (what the reference logs when it has no tokenizer)."""
    return df.withColumn(out_col, char_length(text_col))


def context_budget(df: DataFrame, text_col: str = "text", max_tokens: int = CONTEXT_MAX_TOKENS,
                   chars_per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """Estimate tokens and flag text over the budget. The text itself is never cut."""
    approx = F.ceil(char_length(text_col) / F.lit(chars_per_token)).cast("long")
    return df.withColumn("approx_tokens", approx).withColumn("over_budget", approx > F.lit(max_tokens))


# Prompt wording is our own, built from the schema's field names.
def system_prompt(schema: RecordSchema = BILL_RECORD, doc_type: str = DEFAULT_DOCUMENT_TYPE) -> str:
    return (f"You turn {doc_type} documents into JSON. Answer with a single JSON object that follows "
            f"the {schema.name} schema; write dates as YYYY-MM-DD. The document is Markdown.")


def user_prompt_parts(schema: RecordSchema = BILL_RECORD) -> tuple[str, str]:
    fields = ", ".join(schema.names)
    head = f"Fields to extract: {fields}.\nDocument:\n<<<\n"
    tail = "\n>>>\nAnswer with the JSON object only."
    return head, tail


def render_prompt(df: DataFrame, text_col: str = "text", schema: RecordSchema = BILL_RECORD,
                  doc_type: str = DEFAULT_DOCUMENT_TYPE) -> DataFrame:
    """Add ``messages array<struct<role, content>>``: a system and a user message."""
    head, tail = user_prompt_parts(schema)
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt(schema, doc_type)).alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(F.lit(head), F.col(text_col), F.lit(tail)).alias("content")))
    return df.withColumn("messages", messages)


def prompt_messages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Flat prompt rows ``(id, seq, role, content)``."""
    return (render_prompt(df.select(id_col, text_col), text_col, **kw)
            .select(id_col, F.posexplode("messages").alias("seq", "m"))
            .select(id_col, (F.col("seq") + 1).alias("seq"), "m.role", "m.content"))


def assemble_parts(parts: DataFrame, id_col: str = "doc_id", pos_col: str = "pos",
                   text_col: str = "text", documents: DataFrame | None = None,
                   out_col: str = "text") -> DataFrame:
    """Join each document's non-blank parts in order with a blank line between them.

    One grouping by document, which also keeps documents without a usable part (NULL
    text): blank parts count for the group but are not collected. A group's buffer is the
    document's own text. ``documents`` adds documents that have no part at all.
    """
    part = F.when(~is_blank(F.col(text_col)), F.struct(F.col(pos_col).alias("p"), F.col(text_col).alias("t")))
    joined = (parts.groupBy(id_col).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
              .select(id_col, F.when(F.size("_parts") > 0, F.array_join(
                  F.transform("_parts", lambda x: x["t"]), PART_SEPARATOR)).alias(out_col)))
    if documents is not None:
        return documents.select(id_col).join(joined, id_col, "left")
    return joined


def html_to_markdown(df: DataFrame, html_col: str = "html", out_col: str = "markdown",
                     keep_frame: bool = False) -> DataFrame:
    """Raw HTML -> Markdown, by one pass over the tags of each page (``functions.html``).

    Headings ``h1`` to ``h6`` become ``#`` lines; list items ``- `` or numbered lines, two spaces deeper for each
    list around theirs; links ``[text](address)``; ``pre`` fenced blocks, unchanged within; table rows pipe rows with a
    separator below the first, whose cells have bars and backslashes marked by a backslash (``table_cells`` reads
    them back); other block elements line breaks. Comments and the elements of ``functions.html.DROPPED`` go with their
    content, ``nav`` and ``footer`` too unless ``keep_frame``. All character references are decoded, also named ones.

    Elements nest, which no composition of built-in functions can follow; pages go through Arrow batches, one column
    each way, and the other columns stay where they are.
    """
    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: to_markdown(html, keep_frame), na_action="ignore")

    return df.withColumn(out_col, convert(F.col(html_col).cast("string")))
