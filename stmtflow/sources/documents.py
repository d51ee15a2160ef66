"""Document and work-item sources.

Documents come as files (one Markdown/text file per document, or any binary file)
or as a table with a text column. Work items are JSON objects
``{document_path, document_type_hint}``; the hint defaults only when its key is
absent, while an explicit ``null`` stays NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEFAULT_DOCUMENT_TYPE
from .files import known_store, list_files, read_files


def read_text_documents(spark: SparkSession, path: str, path_glob: str | None = None) -> DataFrame:
    """One row per file, empty files too: ``(document_path, text)``.

    Each file is read whole as bytes and decoded as UTF-8; bytes that are not UTF-8 become
    replacement characters, so one bad file does not end the job. Files are listed and read by tasks
    (``sources.files``); in a store that only Spark can open its own reader is used, which passes over empty files.
    """
    df = read_files(list_files(spark, path, path_glob)) if known_store(path) else read_binary_documents(spark, path, path_glob)
    return df.select(F.col("path").alias("document_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_binary_documents(spark: SparkSession, path: str, path_glob: str | None = None) -> DataFrame:
    """One row per file: ``(path, modificationTime, length, content)`` (raw bytes), by Spark's own reader,
    which also streams; ``sources.files`` has the form that reads empty files too."""
    reader = spark.read.format("binaryFile")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    return reader.load(path)


def read_text_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                    path_cols: tuple[str, ...] = ("source",)) -> DataFrame:
    """A Parquet table of documents -> ``(doc_id, document_path, text)``.

    The path is ``<source>/<doc_id>.md`` when a source column exists. Only the three
    needed columns are read (column pruning reaches the scan).
    """
    df = spark.read.parquet(path)
    present = [c for c in path_cols if c in df.columns]
    doc_path = (F.concat_ws("/", *[F.col(c) for c in present], F.concat(F.col(id_col).cast("string"), F.lit(".md")))
                if present else F.concat(F.col(id_col).cast("string"), F.lit(".md")))
    return df.select(F.col(id_col).alias("doc_id"), doc_path.alias("document_path"),
                     F.col(text_col).alias("text"))


def scan_documents(spark: SparkSession, path: str, fmt: str = "table", **kw) -> DataFrame:
    """Dispatch on the storage form: ``table`` (Parquet with text), ``text`` files, ``files`` (bytes, empty
    files too), ``binary`` (bytes by Spark's own reader)."""
    if fmt == "table":
        return read_text_table(spark, path, **kw)
    if fmt == "text":
        return read_text_documents(spark, path, **kw)
    if fmt == "files":
        return read_files(list_files(spark, path, **kw))
    if fmt == "binary":
        return read_binary_documents(spark, path, **kw)
    raise ValueError(f"unknown document format: {fmt}")


def parse_workitems(df: DataFrame, json_col: str = "item",
                    default_type: str = DEFAULT_DOCUMENT_TYPE) -> DataFrame:
    """Work-item JSON text -> ``document_path``, ``document_type_hint``.

    A missing hint key takes the default; an explicit JSON null stays NULL (a plain
    ``coalesce`` would wrongly default both).
    """
    v = F.try_parse_json(F.col(json_col))
    hint_v = F.try_variant_get(v, "$.document_type_hint", "variant")
    hint = F.when(hint_v.isNull(), F.lit(default_type)).otherwise(F.try_variant_get(hint_v, "$", "string"))
    return (df.withColumn("document_path", F.try_variant_get(v, "$.document_path", "string"))
              .withColumn("document_type_hint", hint))


def scan_workitems(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read work items from JSON-lines files (one object per line) or a Parquet table
    with an ``item`` JSON column, keeping missing and null keys apart."""
    if fmt == "json":
        df = spark.read.text(path).withColumnRenamed("value", "item")
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown work-item format: {fmt}")
    return parse_workitems(df, "item")
