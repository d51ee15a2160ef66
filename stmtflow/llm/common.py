"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root

# Fixed value: the white space that separates words (space, tab to carriage return).
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through the shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row; null reads as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters, without building them.

    A word starts at a non-space character that follows white space, so after every
    non-space run shrinks to one mark the marks are counted.
    """
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD_PATTERN, "x"), r"[^x]+", "")).cast("bigint")


def released() -> None:
    """Give memory that a task no longer holds back to the system: Python workers live on for later stages."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trimmed()


def trimmed() -> None:
    """Give memory that the C library holds free back to the system."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows as one struct ``row`` beside working columns, whose names then clash with none of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[column.alias(name) for name, column in columns.items()])
